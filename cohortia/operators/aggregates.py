"""Aggregations, set operations and joins that recur across the cohort tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortia.operators.ordered import draw_order, quantiles, running_by
from cohortia.session import cut_lineage, distinct_values


def quantile_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, p5, p10, p50, p90, p95, mean, population sd per key."""
    q = quantiles(df, by, value, {"p5": 0.05, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p95": 0.95})
    m = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return q.join(m, list(by)) if by else q.join(F.broadcast(m), on=F.lit(True))


def group_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, median, sd, min, max, n per key; the median is exact and spread over tasks."""
    q = quantiles(df, by, value, {"median": 0.5}).drop("n")
    m = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"),
                            F.stddev_pop(value).alias("sd_pop"), F.min(value).alias("min"), F.max(value).alias("max"))
    return m.join(q, list(by), "left")


def distinct_samples(df: DataFrame, key: Sequence[str], sample: str = "sample_id", approximate: bool = False) -> DataFrame:
    """Distinct samples per key. Exact form deduplicates on (key, sample) first, so a hot key is spread by sample."""
    if approximate:
        return df.groupBy(*key).agg(F.approx_count_distinct(sample).alias("n_samples"))
    return df.select(*key, sample).where(F.col(sample).isNotNull()).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_samples"))


def joined_names(df: DataFrame, key: Sequence[str], col: str, out: str, sep: str = "; ") -> DataFrame:
    """Distinct trimmed values per key, sorted and joined into one string (values are deduplicated before collecting)."""
    d = df.select(*key, F.trim(col).alias("_v")).where("_v <> ''").distinct()
    return d.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(out))


def any_by_group(df: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """bool_or of each condition per key."""
    return df.groupBy(*by).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()])


def value_counts(df: DataFrame, cols: Sequence[str], top: int | None = None) -> DataFrame:
    """Frequencies, most frequent first (ties by value)."""
    c = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), *cols).limit(top) if top else c


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def share_of_group(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Share of each row's count in its group (the input is already a small count table)."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(W.partitionBy(*by)))


def alteration_frequency(calls: DataFrame, n_samples: DataFrame | None = None) -> DataFrame:
    """Share of samples with a non-zero value per feature."""
    return calls.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") != 0).cast("double")).alias("frequency"))


def coverage(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples with any non-zero value, and their share."""
    s = calls.groupBy(*by, "sample_id").agg(F.bool_or(F.col("value") != 0).alias("covered"))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.count(F.when(F.col("covered"), 1)).alias("n_covered"),
                              F.avg(F.col("covered").cast("double")).alias("coverage"))


def majority(votes: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Most voted value per key; a tie at the top is unresolved (null)."""
    c = votes.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    m = c.groupBy(*key).agg(F.sum("_n").alias("n_votes"), F.max("_n").alias("top_votes"),
                            F.max_by(value, F.struct("_n", F.col(value))).alias("_v"),
                            F.array_sort(F.collect_list("_n")).alias("_all"))
    tie = F.size(F.filter("_all", lambda x: x == F.col("top_votes"))) > 1
    return m.select(*key, "n_votes", "top_votes", F.when(~tie, F.col("_v")).alias("consensus"))


def rollup_report(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Detail, subtotal and grand total rows with their grouping level."""
    return df.rollup(*keys).agg(F.grouping_id().alias("level"), *aggs)


def burden(events: DataFrame) -> DataFrame:
    """Events per sample."""
    return events.groupBy("sample_id").agg(F.count(F.lit(1)).alias("burden"))


def co_occurrence(events: DataFrame, genes: DataFrame) -> DataFrame:
    """Samples that carry both genes of each pair of a short gene list. The list bounds the per-sample array."""
    packed = events.join(genes.select("gene").distinct(), "gene", "left_semi").groupBy("sample_id").agg(
        F.array_sort(F.collect_set("gene")).alias("g"))
    left = packed.select("g", F.posexplode("g").alias("i", "a"))
    return left.select("a", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("b")).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"))


# ---- joins -------------------------------------------------------------------------------------------------------

def common_samples(*views: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples present in every view: a chain of semi joins on distinct keys."""
    first, *rest = [v.select(key).distinct() for v in views]
    return reduce(lambda a, b: a.join(b, key, "left_semi"), rest, first)


def align(view: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Left re-index a per-sample table to a cohort: absent samples get nulls."""
    return samples.select(key).distinct().join(view, key, "left")


def left_with_defaults(left: DataFrame, right: DataFrame, key: Sequence[str], defaults: dict) -> DataFrame:
    return left.join(right, list(key), "left").na.fill(defaults)


def stack_inner(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack long cohorts and keep the features that every cohort has."""
    u = reduce(DataFrame.unionByName, [f.withColumn("cohort", F.lit(n)) for n, f in frames.items()])
    full = u.select("cohort", "feature").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == len(frames))
    return u.join(full, "feature", "left_semi")


def stack_outer(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack cohorts with whatever columns each has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [f.withColumn("cohort", F.lit(n)) for n, f in frames.items()])


def label_by_either_id(samples: DataFrame, id_map: DataFrame, truth: DataFrame) -> DataFrame:
    """Attach a reference label through the original id, else through the given id; empty labels drop.

    samples(sample_id, label), id_map(original, anon), truth(id, truth).
    """
    via = samples.join(id_map.select(F.col("anon").alias("sample_id"), "original"), "sample_id", "left")
    a = via.join(truth.select(F.col("id").alias("original"), F.nullif("truth", F.lit("")).alias("_t1")), "original", "left")
    b = a.join(truth.select(F.col("id").alias("sample_id"), F.nullif("truth", F.lit("")).alias("_t2")), "sample_id", "left")
    return b.withColumn("truth", F.coalesce("_t1", "_t2")).where("truth IS NOT NULL").select("sample_id", "label", "truth")


def complete_grid(values: DataFrame, features: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Samples x features with a fill value, on request only. Built by exploding the (size-checked) feature list."""
    names = F.array(*[F.lit(f) for f in distinct_values(features, "feature", 20000)])
    grid = values.select("sample_id").distinct().select("sample_id", F.explode(names).alias("feature"))
    out = grid.join(values, ["sample_id", "feature"], "left")
    return out.na.fill({"value": fill}) if fill is not None else out


# ---- sets --------------------------------------------------------------------------------------------------------

def universe(sources: Sequence[DataFrame], col: str = "gene") -> DataFrame:
    """Union of the names of all sources without blanks."""
    u = reduce(DataFrame.union, [s.select(F.trim(col).alias(col)) for s in sources])
    return u.where(f"{col} IS NOT NULL AND {col} <> ''").distinct()


def overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Sizes of both sets and of their intersection, in one pass over the tagged union."""
    t = a.select(col).distinct().withColumn("_s", F.lit(1)).union(b.select(col).distinct().withColumn("_s", F.lit(2)))
    g = t.groupBy(col).agg(F.sum("_s").alias("_s"))
    return g.agg(F.count(F.when(F.col("_s") != 2, 1)).alias("n_a"), F.count(F.when(F.col("_s") != 1, 1)).alias("n_b"),
                 F.count(F.when(F.col("_s") == 3, 1)).alias("n_both"))


def only_in_first(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).distinct().join(b.select(col).distinct(), col, "left_anti")


def overlap_fraction(items: DataFrame, reference: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of listed items that are in a reference list."""
    r = reference.select(col).distinct().withColumn("_in", F.lit(1.0))
    return items.join(r, col, "left").groupBy(*by).agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("fraction"))


def leaked_ids(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Identifiers that are not in anonymised form."""
    return df.select(col).where(~F.col(col).startswith(prefix)).distinct()


# ---- windows over event logs -------------------------------------------------------------------------------------

def nth_event_gate(log: DataFrame, key: str, order: str, is_event: Column, n: int) -> DataFrame:
    """Rows of each key at or after its n-th qualifying event."""
    x = cut_lineage(log.withColumn("_e", is_event.cast("long")))
    g = running_by(x, [key], [order], {"_seen": ("sum", "_e")})
    return g.where(F.col("_seen") >= n).drop("_e", "_seen")


def pick_n(df: DataFrame, by: Sequence[str], seed: int, keys: Sequence[str], n: int) -> DataFrame:
    """Random fixed-size pick without replacement per key, in the portable md5 order."""
    return draw_order(df, by, seed, keys).where(F.col("rn") <= n)
