"""Patterns with the word edges and classes of SQL."""

from cohortia.plans import transcripts as tr


def test_word_edges_of_behaviour_flags_are_ascii(spark):
    rows = [("a", "ungé, x", "the é the"), ("b", "junge", "the\nthe"), ("c", "éung\n", "the\r the")]
    c = spark.createDataFrame(rows, "episode string, input string, reasoning string")
    got = tr.behaviour_flags(c, {"edge": r"ung\b"}, {"twice": r"\bthe\b.*\bthe\b"}).collect()
    assert {tuple(r) for r in got} == {("a", True, True), ("b", False, False), ("c", True, True)}


def test_default_family_ends_at_a_letter_outside_ascii(spark):
    c = spark.createDataFrame([("a", "oraß", ""), ("b", "orange", "")], "episode string, input string, reasoning string")
    assert {r["episode"]: r["used_pathway_analysis"] for r in tr.behaviour_flags(c).collect()} == {"a": True, "b": False}


def test_audit_edges_words_and_blanks_are_ascii(spark):
    rows = [("e", 0, "harness", "xä  lungß y"), ("e", 1, "echoed", "results/ü/g2"), ("e", 2, "echoed", "g2 é é é s1"), ("e", 3, "echoed", "misleadü")]
    t = spark.createDataFrame(rows, "episode string, msg_ix int, author string, text string")
    lab = spark.createDataFrame([("e", "q", "g2", "luad", None, "s1")], "episode string, label string, arm string, cohort string, planted string, seed string")
    syn = spark.createDataFrame([("luad", r"\blung\b")], "cohort string, pattern string")
    got = {(r["kind"], r["snippet"]) for r in tr.blinding_audit(t, lab, syn).collect()}
    assert got == {("TRUE COHORT", "xä  lungß y"), ("ARM TOKEN", "results/ü/g2"), ("MISLEAD KEYWORD", "misleadü")}
