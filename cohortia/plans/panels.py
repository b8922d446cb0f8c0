"""Rating panels: agreement, consensus, cross-tabs and outcome tests.

votes(episode, arm, model, pass, field, value) is the common long table; scores(episode, arm, ..., outcome).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.tails import fisher2
from cohortia.operators.aggregates import majority
from cohortia.operators.ordered import quantiles
from cohortia.operators.stats import mann_whitney, spearman
from cohortia.session import cut_lineage


def agreement(votes: DataFrame, a, b, by: Sequence[str] = ("model",)) -> DataFrame:
    """Agreement of two passes per field: both sides land in one row per (episode, field) by aggregation, no self-join."""
    w = votes.groupBy(*by, "episode", "field").agg(F.max(F.when(F.col("pass") == F.lit(a), F.col("value"))).alias("va"),
                                                  F.max(F.when(F.col("pass") == F.lit(b), F.col("value"))).alias("vb"))
    both = w.where("va IS NOT NULL AND vb IS NOT NULL")
    return both.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("va") == F.col("vb")).alias("agree"),
                                          F.avg((F.col("va") == F.col("vb")).cast("double")).alias("rate"))


def disagreements(votes: DataFrame, a, b) -> DataFrame:
    """Counts of differing answer pairs per field."""
    w = votes.groupBy("episode", "field").agg(F.max(F.when(F.col("pass") == F.lit(a), F.col("value"))).alias("va"),
                                              F.max(F.when(F.col("pass") == F.lit(b), F.col("value"))).alias("vb"))
    return w.where("va <> vb").groupBy("field", "va", "vb").agg(F.count(F.lit(1)).alias("n"))


def panel_summary(votes: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """N-pass panel per field: episodes judged by all passes, unanimity, pairwise agreement, episodes without a majority.

    Pairwise agreement follows from the vote counts c_v of an episode: sum c_v (c_v - 1) over n (n - 1).
    """
    n_pass = votes.select("pass").distinct().count()
    c = votes.groupBy(*by, "episode", "field", "value").agg(F.count(F.lit(1)).alias("c"))
    e = c.groupBy(*by, "episode", "field").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"),
                                               F.array_sort(F.collect_list("c")).alias("all")).where(F.col("n") == n_pass)
    tied = F.size(F.filter("all", lambda x: x == F.col("top"))) > 1
    return e.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("n_episodes"), F.count_if(F.col("top") == F.col("n")).alias("unanimous"),
                                       (F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1))).alias("pairwise"), F.count_if(tied).alias("no_majority"))


def rate_spread(votes: DataFrame, field: str, value: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Consensus rate of one answer beside the range of the single-pass rates."""
    v = votes.where(F.col("field") == field)
    p = v.groupBy(*by, "pass").agg(F.avg((F.col("value") == value).cast("double")).alias("r")).groupBy(*by).agg(
        F.min("r").alias("min_rate"), F.max("r").alias("max_rate"), (F.max("r") - F.min("r")).alias("spread"))
    m = majority(v, [*by, "episode"])
    c = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("consensus", F.lit("")) == value).cast("double")).alias("consensus_rate"),
                           F.count_if(F.col("consensus").isNull()).alias("unresolved"))
    return c.join(p, list(by))


def coverage_evenness(votes: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Episodes per pass and whether all passes cover the same number."""
    n = votes.select(*by, "pass", "episode").distinct().groupBy(*by, "pass").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("passes"), F.min("n").alias("fewest"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("even"))


def distributions(votes: DataFrame, values: Sequence[str], by: Sequence[str] = ("model", "arm", "field")) -> DataFrame:
    """Counts per answer side by side."""
    return votes.groupBy(*by).pivot("value", list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def cross_tab(df: DataFrame, row: str, col: str, values: Sequence[str], arm: str = "arm") -> DataFrame:
    """row x col counts per arm and pooled (arm is null), with the row share within each arm."""
    counts = [F.count_if(F.col(col) == v).alias(v) for v in values]
    g = df.rollup(row, arm).agg(*counts, F.count(F.lit(1)).alias("n"), F.grouping(arm).alias("pooled")).where(F.col(row).isNotNull())
    tot = df.rollup(arm).agg(F.count(F.lit(1)).alias("_t"))
    return g.join(F.broadcast(tot.withColumnRenamed(arm, "_a")), F.col(arm).eqNullSafe(F.col("_a"))).withColumn(
        "share", F.col("n") / F.col("_t")).drop("_a", "_t")


def process_vs_correct(df: DataFrame, explore: Column, outcome: str, cutoff: float | None = None) -> DataFrame:
    """2x2 counts process x correctness per arm and in total; correct means outcome >= cut-off (median by default)."""
    ok = cut_lineage(df.where(F.col(outcome).isNotNull()).select("arm", explore.alias("_e"), F.col(outcome).alias("_o")))
    if cutoff is None:
        m = quantiles(ok.withColumn("_g", F.lit(0)), ["_g"], "_o", {"cutoff": 0.5}).select("cutoff")
        ok = ok.join(F.broadcast(m), on=F.lit(True))
    else:
        ok = ok.withColumn("cutoff", F.lit(float(cutoff)))
    c = F.col("_o") >= F.col("cutoff")
    e = F.col("_e")
    return ok.rollup("arm").agg(F.count_if(e & c).alias("derived_correct"), F.count_if(~e & c).alias("recalled_correct"),
                                F.count_if(e & ~c).alias("derived_wrong"), F.count_if(~e & ~c).alias("recalled_wrong"), F.count(F.lit(1)).alias("n"))


def rate_shift(df: DataFrame, field: str, hit: Column, low: str, high: str) -> DataFrame:
    """Rate of a condition in two arms and the difference, per field."""
    r = df.groupBy(field).agg(F.avg(F.when(F.col("arm") == low, hit.cast("double"))).alias("rate_low"), F.avg(F.when(F.col("arm") == high, hit.cast("double"))).alias("rate_high"))
    return r.withColumn("shift", F.col("rate_high") - F.col("rate_low"))


def ordinal_score(levels: DataFrame, points: dict[str, float], weights: dict[str, float], key: Sequence[str] = ("episode",)) -> DataFrame:
    """Weighted points of ordinal answers. levels(episode, decision, level)."""
    p = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return levels.groupBy(*key).agg(F.sum(F.coalesce(F.try_element_at(p, F.col("level")), F.lit(0.0)) * F.coalesce(F.try_element_at(w, F.col("decision")), F.lit(0.0))).alias("score"))


def outcome_by_derivation(scores: DataFrame, answer: str, outcome: str, first: str, ranks: dict[str, int]) -> dict[str, DataFrame]:
    """Does the outcome differ between derived and other answers? Group means, Mann-Whitney, ordinal rank correlation."""
    s = cut_lineage(scores)
    g = s.groupBy(answer).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.stddev_pop(outcome).alias("sd"))
    two = s.where(F.col(answer).isin(first, *[k for k, v in ranks.items() if v == min(ranks.values())]))
    rk = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    r = s.withColumn("_r", F.try_element_at(rk, F.col(answer)).cast("double"))
    return {"groups": g, "mann_whitney": mann_whitney(two, [], outcome, answer, first), "ordinal": spearman(r, [], "_r", outcome)}


def within_arm_difference(scores: DataFrame, derived: Column, outcome: str, by: Sequence[str], min_n: int = 3) -> DataFrame:
    """Mean outcome of derived against not derived inside each arm (guards against a pooling artefact)."""
    d, o = F.when(derived, F.col(outcome)), F.when(~derived, F.col(outcome))
    return scores.groupBy(*by).agg(F.count(d).alias("n_derived"), F.count(o).alias("n_not"), F.avg(d).alias("derived"), F.avg(o).alias("not_derived"),
                                   (F.avg(d) - F.avg(o)).alias("delta")).where((F.col("n_derived") >= min_n) & (F.col("n_not") >= min_n))


def fooled_by_derivation(scores: DataFrame, derived: Column, verdict: str = "verdict", fooled: str = "mislead_cohort", error: str = "error",
                         by: Sequence[str] = ()) -> DataFrame:
    """2x2 of fooled against derived with Fisher p. Failed gates are excluded and counted, never taken as 'not fooled'."""
    ok = F.col(verdict) != error
    f = F.col(verdict) == fooled
    t = scores.groupBy(*by).agg(F.count_if(ok & derived & f).alias("a"), F.count_if(ok & derived & ~f).alias("b"), F.count_if(ok & ~derived & f).alias("c"),
                                F.count_if(ok & ~derived & ~f).alias("d"), F.count_if(~ok).alias("excluded_errors"))
    return t.withColumn("p", fisher2("a", "b", "c", "d")).withColumn("odds_ratio", F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), F.lit(0)))


def gate_tally(scores: DataFrame, verdicts: Sequence[str], error: str = "error", by: Sequence[str] = ("arm",)) -> DataFrame:
    """Verdict counts per arm; failed gates are shown and left out of the rate."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts],
                                   F.count_if(F.col("verdict") == error).alias("errored"),
                                   F.avg(F.when(F.col("verdict") != error, (F.col("verdict") == verdicts[0]).cast("double"))).alias("rate"))


def verdict_problems(records: DataFrame, domains: DataFrame, required: Sequence[str]) -> DataFrame:
    """(episode, pass, problem): required fields missing or empty, and values outside the field's domain.

    records(episode, pass, fields map<string,string>), domains(field, value).
    """
    need = F.array(*[F.lit(f) for f in required])
    miss = records.select("episode", "pass", F.explode(F.filter(need, lambda f: F.coalesce(F.try_element_at("fields", f), F.lit("")) == "")).alias("f")).select(
        "episode", "pass", F.concat(F.lit("missing "), F.col("f")).alias("problem"))
    vals = records.select("episode", "pass", F.explode("fields").alias("field", "value")).where("value <> ''")
    known = domains.select("field").distinct()
    bad = vals.join(known, "field", "left_semi").join(domains, ["field", "value"], "left_anti").select(
        "episode", "pass", F.concat(F.lit("illegal "), F.col("field"), F.lit("="), F.col("value")).alias("problem"))
    return miss.union(bad)


def judge_coverage(records: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per pass: episodes judged, and missing from the full list."""
    n = episodes.agg(F.count(F.lit(1)).alias("n_episodes"))
    j = records.select("episode", "pass").distinct().groupBy("pass").agg(F.count(F.lit(1)).alias("judged"))
    return j.join(F.broadcast(n), on=F.lit(True)).withColumn("missing", F.col("n_episodes") - F.col("judged"))


def shortcut_report(eps: DataFrame) -> DataFrame:
    """Per arm: derived, grounded, shortcut counts and rate, mean outcome. eps(arm, derived, grounded, count_leak, path_cited, outcome)."""
    any_ = F.col("count_leak") | F.col("path_cited")
    return eps.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("derived").alias("derived"), F.count_if("grounded").alias("grounded"),
                                  F.count_if("count_leak").alias("count_leak"), F.count_if("path_cited").alias("path_cited"),
                                  F.count_if(any_).alias("any_shortcut"), F.avg(any_.cast("double")).alias("shortcut_rate"), F.avg("outcome").alias("outcome"))


def shortcut_vs_outcome(report: DataFrame) -> DataFrame:
    return spearman(report, [], "shortcut_rate", "outcome", min_n=3)


def ablation_deltas(metrics: DataFrame, key: str, side: str, left, right, cols: Sequence[str]) -> DataFrame:
    """Metric differences left - right per key, from one aggregation."""
    def at(c, v):
        return F.max(F.when(F.col(side) == F.lit(v), F.col(c)))
    return metrics.groupBy(key).agg(*[x for c in cols for x in (at(c, left).alias(f"{c}_{left}"), at(c, right).alias(f"{c}_{right}"), (at(c, left) - at(c, right)).alias(f"{c}_delta"))])


def component_means(scores: DataFrame, by: Sequence[str], below: float = 0.75) -> DataFrame:
    """Mean per (by, component), the best peer's mean, and a flag for notably-below-peer."""
    m = cut_lineage(scores.groupBy(*by, "component").agg(F.avg("raw").alias("mean"), F.count("raw").alias("n")))
    best = m.groupBy("component").agg(F.max("mean").alias("best"))
    return m.join(best, "component").withColumn("below_peers", F.col("mean") < below * F.col("best"))


def volume_vs_grounding(eps: DataFrame, volume: DataFrame) -> DataFrame:
    """Literature volume beside the grounding rate per cohort. eps(cohort, grounded), volume(cohort, papers)."""
    g = eps.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("grounded").cast("double")).alias("grounded_rate"))
    return g.join(volume, "cohort", "left")


def probe_agreement(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected against observed answers per field: agreement, count, mismatching probes. Both (probe, field, value)."""
    j = expected.join(observed.withColumnRenamed("value", "_got"), ["probe", "field"], "left")
    same = F.col("value").eqNullSafe(F.col("_got"))
    return j.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree"), F.avg(same.cast("double")).alias("rate"))


def probe_mismatches(expected: DataFrame, observed: DataFrame) -> DataFrame:
    j = expected.join(observed.withColumnRenamed("value", "got"), ["probe", "field"], "left")
    return j.where(~F.col("value").eqNullSafe(F.col("got")))


def any_vote(votes: DataFrame, by: Sequence[str] = ("model", "field")) -> DataFrame:
    """Episodes in which at least one pass gave each answer."""
    return votes.select(*by, "value", "episode").distinct().groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n_episodes"))
