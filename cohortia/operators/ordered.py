"""Order-dependent work (ranks, running totals, quantiles, BH) that never puts one key into one task.

A plain ``Window.partitionBy(key).orderBy(v)`` sorts a whole key in a single task, so a key holding a third of
the table becomes the bottleneck. Here the order column is cut into equi-depth *buckets* that are global to the
table. Any (key, bucket) group is then at most ~1/n_buckets of all rows, whatever the key skew is. Running values
inside a bucket come from a window over (key, bucket); the carry-in of each bucket comes from a second window over
the bucket totals, which has at most n_buckets rows per key.

Ties are collapsed first by a partial aggregation into *cells* (key, value, n), so a value repeated a billion
times is one row before anything is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortia.session import cut_lineage

# Rows that a (key, bucket) group of a random order has on average where one key holds the whole table.
RANDOM_ROWS = 100_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def bucket_edges(df: DataFrame, col: str, n_buckets: int | None = None) -> list[float]:
    """Distinct inner edges of equi-depth buckets of a numeric column (one pass, at most n_buckets numbers).

    Any edges give right results; they only steer balance. So take them from the smallest table that has the
    column, and reuse them for every operator over it.
    """
    n = n_buckets or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    got = df.select(F.col(col).cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.5 / n)
    return sorted({e for e in got if e is not None and math.isfinite(e)})


def with_bucket(df: DataFrame, col: str, edges: Sequence[float], out: str = "_b") -> DataFrame:
    """Bucket number of ``col`` (binary search over literal edges, so the same row always gets the same bucket)."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    d = df.withColumn("_bv", F.col(col).cast("double"))
    b = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_bv", outputCol=out, handleInvalid="keep")
    # an integer key: grouping by a double would hide the existing partitioning from Catalyst
    return b.transform(d).drop("_bv").withColumn(out, F.col(out).cast("int"))


def running(
    cells: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, str]],
    bucket: str = "_b",
    descending: bool = False,
    totals: dict[str, str] | None = None,
    strict: bool = False,
    peers: dict[str, str] | None = None,
    totals_from: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` inside each ``by`` key.

    ``aggs`` maps output -> (sum|min|max, column). Rows with equal order values are peers and all get the value
    including every peer (SQL RANGE semantics); ``strict`` leaves the peers out (sums only). ``peers`` maps
    output -> column for sums over the peers alone.
    ``totals`` maps output -> column for whole-key sums, taken from the bucket totals. ``totals_from`` may name a
    finer table with the same columns to take bucket totals from, when that saves recomputing ``cells``.
    """
    by = list(by)
    totals, peers = totals or {}, peers or {}
    part = [F.col(c) for c in by] or [F.lit(0)]
    sums = sorted({c for f, c in aggs.values() if f == "sum"} | set(totals.values()))
    pre = [F.sum(c).alias(f"_t_sum_{c}") for c in sums]
    pre += [_AGG[f](c).alias(f"_t_{f}_{c}") for f, c in sorted(set(aggs.values())) if f != "sum"]
    tot = (cells if totals_from is None else totals_from).groupBy(*by, bucket).agg(*pre)
    border = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = W.partitionBy(*part).orderBy(border).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*part)
    carry = tot.select(
        *by,
        F.col(bucket),
        *[_AGG[f](f"_t_{f}_{c}").over(before).alias(f"_c_{o}") for o, (f, c) in aggs.items()],
        *[F.sum(f"_t_sum_{c}").over(whole).alias(o) for o, c in totals.items()],
    )
    oc = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = W.partitionBy(*by, bucket).orderBy(*oc).rangeBetween(W.unboundedPreceding, W.currentRow)
    tied = W.partitionBy(*by, bucket, *order)
    loc = cells.select(
        "*",
        *[_AGG[f](c).over(inside).alias(f"_l_{o}") for o, (f, c) in aggs.items()],
        *([F.sum(c).over(tied).alias(f"_p_{o}") for o, (f, c) in aggs.items()] if strict else []),
        *[F.sum(c).over(tied).alias(o) for o, c in peers.items()],
    )
    joined = loc.join(carry, [*by, bucket])

    def merged(o: str, f: str) -> Column:
        if f == "sum":
            v = F.col(f"_l_{o}") + F.coalesce(F.col(f"_c_{o}"), F.lit(0))
            return v - F.col(f"_p_{o}") if strict else v
        return (F.least if f == "min" else F.greatest)(F.col(f"_l_{o}"), F.col(f"_c_{o}"))

    return joined.select(
        *[F.col(c) for c in cells.columns],
        *[merged(o, f).alias(o) for o, (f, _) in aggs.items()],
        *[F.col(o) for o in (*totals, *peers)],
    )


def running_by(cells: DataFrame, by: Sequence[str], order: Sequence[str], aggs: dict[str, tuple[str, str]], **kw) -> DataFrame:
    """``running`` over a stored table, in buckets of ``order[0]``."""
    return running(with_bucket(cells, order[0], bucket_edges(cells, order[0])), by, order, aggs, **kw).drop("_b")


def ranked_cells(cells: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Average-tie rank for weighted cells (several cells may share a value): adds ``rank``, ``ties``, ``n_total``.

    ``cells`` must be cheap to read twice (a stored table).
    """
    out = running_by(cells, by, [value], {"_cum": ("sum", n)}, totals={"n_total": n}, peers={"ties": n})
    return out.withColumn("rank", F.col("_cum") - (F.col("ties") - 1) / 2.0).drop("_cum")


def rank_table(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct (by, value): ``rank`` (average of ties), ``ties``, ``n_total``."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    cells = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n")))
    return ranked_cells(cells, by, value, "_n").select(*by, value, "rank", "ties", "n_total")


def add_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Attach the average-tie rank of ``value`` within ``by`` to every row (nulls dropped). ``df`` is read twice."""
    rt = rank_table(df, by, value).select(*by, value, F.col("rank").alias(out))
    return df.join(rt, [*by, value])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
              weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key (``probs`` maps output name -> probability), plus ``n``."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    cells = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n")))
    run = running_by(cells, by, [value], {"_cum": ("sum", "_n")}, totals={"_tot": "_n"})

    def at(pos: Column) -> Column:
        hit = (F.col("_cum") > pos) & (F.col("_cum") - F.col("_n") <= pos)
        return F.max(F.when(hit, F.col(value).cast("double")))

    aggs, outs = [F.max("_tot").alias("n")], [F.col("n")]
    for name, p in probs.items():
        h = (F.col("_tot") - 1) * F.lit(float(p))
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
        g = (F.col("n") - 1) * F.lit(float(p))
        frac = g - F.floor(g)
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac).alias(name))
    return run.groupBy(*by).agg(*aggs).select(*by, *outs)


def draw_key(seed: int, *parts: Column | str) -> Column:
    """Portable random order: md5 of seed and keys. The same in every engine, safe under task retries."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw_order(df: DataFrame, by: Sequence[str], seed: int, keys: Sequence[str], out: str = "rn") -> DataFrame:
    """1-based position of each row in md5 order within ``by``. Rows must be unique on (by, keys).

    The first hex digits of the md5 are uniform and order-preserving, so they serve as buckets; their number follows
    the counted rows.
    """
    d = df.withColumn("_k", draw_key(seed, *by, *keys)).withColumn("_one", F.lit(1))
    d = cut_lineage(d)
    digits = max(1, math.ceil(math.log(max(1, d.count()) / RANDOM_ROWS, 16)))  # footers only: the table is stored
    d = d.withColumn("_b", F.substring("_k", 1, digits))
    return running(d, by, ["_k", *keys], {out: ("sum", "_one")}).drop("_k", "_one", "_b")


def bh_fdr(df: DataFrame, family: Sequence[str], p: str = "p", out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within each family; null or out-of-range p stay in the output with null FDR and do
    not count towards the family size."""
    df = cut_lineage(df)  # one row per test: write it once instead of running the screen for every branch below
    good = F.coalesce(F.col(p).between(0.0, 1.0) & ~F.isnan(p), F.lit(False))
    ok = df.where(good)
    cells = cut_lineage(ok.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n")))
    up = running(with_bucket(cells, p, bucket_edges(cells, p)), family, [p], {"_r": ("sum", "_n")}, totals={"_m": "_n"})
    raw = cut_lineage(up.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r")))
    adj = running(raw, family, [p], {"_adj": ("min", "_q")}, descending=True)
    adj = adj.select(*family, F.col(p), F.least(F.col("_adj"), F.lit(1.0)).alias(out))
    return df.join(adj, [*family, p], "left").select(*df.columns, out)


def quantile_bins(df: DataFrame, by: Sequence[str], value: str, k: int, out: str = "bin") -> DataFrame:
    """Edge-based k-quantile bins 0..k-1, right-closed like a quantile cut; nulls keep a null bin."""
    names = {f"_q{i}": i / k for i in range(1, k)}
    q = quantiles(df, by, value, names).drop("n")
    b = F.lit(0)
    for name in names:
        b = b + F.when(F.col(value) > F.col(name), 1).otherwise(0)
    joined = df.join(q, list(by), "left") if by else df.join(F.broadcast(q), how="left", on=F.lit(True))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), b)).drop(*names)
