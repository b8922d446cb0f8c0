"""Automata over pattern lists against plain string search."""

import itertools
import random

from cohortia.functions import patterns as pt
from cohortia.functions import text as tx
from cohortia.plans import transcripts as tr


def test_occurrences_equal_plain_search_at_any_number_of_shards(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abü ") for _ in range(n))
    pats = [word(rnd.randint(1, 6)) for _ in range(60)] + ["", None]
    docs = [word(rnd.randint(0, 80)) for _ in range(40)] + ["", None, "ab" * 5000]
    p = spark.createDataFrame([(x, 1) for x in pats + pats[:5]], "p string, text int")
    d = spark.createDataFrame(list(enumerate(docs)) + [(0, docs[0])], "id int, body string")
    want = {(i, x) for (i, y), x in itertools.product(enumerate(docs), pats) if x and y and x in y}
    for chars in (40, 1_000_000):
        got = [tuple(r) for r in pt.occurring(d, "id", "body", p, "p", chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pt.occurring(d, "id", "body", p.where("p IS NULL"), "p").count() == 0
    assert pt.occurring(d.limit(0), "id", "body", p, "p").count() == 0


def test_replacement_at_any_number_of_shards(spark):
    m = spark.createDataFrame([("g1", "TP53"), ("g12", "KRAS"), ("g1 x", "g1"), ("g1", "ZZZ"), (None, "n"), ("", "e"), ("q", None)], "t string, r string")
    docs = ["g1, g12 and g1 x; ag1 g1_ g1", "g12g1 (g12)", "", None, "q none é-g1"]
    want = ["TP53, KRAS and g1; ag1 g1_ TP53", "g12g1 (KRAS)", "", None, "q none é-TP53"]
    d = spark.createDataFrame([(i, x, [i]) for i, x in enumerate(docs)] + [(None, "g1", None)], "id int, text string, _spans array<int>")
    for chars in (3, 1_000_000):
        got = [tuple(r) for r in pt.replaced(d, "text", m, "t", "r", chars=chars).collect()]
        assert sorted(got, key=str) == sorted([(i, x, [i]) for i, x in enumerate(want)] + [(None, "TP53", None)], key=str)
        got = {r["id"]: r["text"] for r in pt.replaced(d, "text", m, "t", "r", r"g\d\b", chars).collect()}
        assert got[0] == "TP53, g12 and TP53 x; aTP53 g1_ TP53" and got[1] == "g12TP53 (g12)"
    assert pt.replaced(d, "text", m.limit(0), "t", "r").count() == len(docs) + 1


def test_names_match_in_either_direction(spark):
    names = ["Wnt signalling", "wnt", "apoptosis extra", "none", "", None, "p53_path"]
    sets = ["WNT_SIGNALLING_PATHWAY", "APOPTOSIS", "wnt", "P53 path", None]
    for more in ([], [""]):
        a = spark.createDataFrame([(x,) for x in names], "name string")
        b = spark.createDataFrame([(x,) for x in sets + more], "set_name string")
        norm = lambda x: x.strip().upper().replace(" ", "_")
        want = {}
        for x in names:
            hit = [y for y in sets + more if x is not None and y is not None and (norm(x) in norm(y) or norm(y) in norm(x))]
            if hit:
                want[x] = min(hit)
        assert {r["name"]: r["set_name"] for r in tx.matched_names(a, b).collect()} == want


def test_no_nested_loop_join(spark, capsys):
    i = spark.createDataFrame([(1, "ab"), (2, "b c d")], "item int, text string")
    d = spark.createDataFrame([(1, "xab"), (2, "b c d e")], "doc int, text string")
    tx.contained_in(i, d, "item", "doc").explain()
    tx.matched_names(i.select("text").toDF("name"), d.select("text").toDF("set_name")).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Cartesian" not in plan


def test_every_audit_rule_and_its_context(spark):
    rows = [("e", 0, "harness", "run g2_brca_s1 now"), ("e", 1, "echoed", "see results/x/g2.csv"), ("e", 2, "echoed", "Mislead"), ("e", 3, "echoed", "misleading"),
            ("e", 4, "harness", "Breast   tumours and lung"), ("e", 5, "echoed", "breast"), ("e", 6, "echoed", None), ("f", 0, "harness", "breast, lung g2")]
    t = spark.createDataFrame(rows, "episode string, msg_ix int, author string, text string")
    lab = spark.createDataFrame([("e", "g2_brca_s1", "g2", "brca", "luad", "s1"), ("f", None, None, "brca", "luad", None)], "episode string, label string, arm string, cohort string, planted string, seed string")
    syn = spark.createDataFrame([("brca", "breast"), ("luad", r"\blung\b")], "cohort string, pattern string")
    got = {(r["episode"], r["kind"]): (r["n_hits"], r["snippet"]) for r in tr.blinding_audit(t, lab, syn, 5).collect()}
    assert got == {("e", "EPISODE LABEL"): (1, "run g2_brca_s1 now"), ("e", "IDENTITY-BEARING PATH"): (1, "see results/x/g2.csv"), ("e", "MISLEAD KEYWORD"): (1, "Mislead"),
                   ("e", "ARM TOKEN"): (2, "run g2_brca_"), ("e", "ARM+SEED"): (1, "run g2_brca_s1 now"), ("e", "TRUE COHORT"): (1, "Breast tu"), ("e", "PLANTED COHORT"): (1, "and lung")}
