"""Shards of nearly equal size by a minimax contiguous partition of ordered atomic groups.

Equal texts are one group, which is never cut. The groups stand in the order of their text's MD5, so a shard is a range of
MD5 values: K - 1 cuts say where a text belongs, without a table to look it up in. The smallest capacity with which K
shards hold all groups is found by bisection; a capacity is tried by filling shard after shard as far as it goes. Each
filling step asks for the last group border at or under some byte position, which is a maximum over the border table;
a round of the search tries ``TRIES`` capacities in the same steps, so it narrows the range by that factor plus one.

Borders are stored in order, so Parquet skips what lies outside the positions that a step can reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortia.operators.ordered import bucket_edges, with_bucket
from cohortia.session import cut_lineage

#: Capacities tried in one round.
TRIES = 1000

#: Groups in a bucket of the running sum, about.
BUCKET_GROUPS = 20_000


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one; a null text has none), crc (of the bytes), key (MD5 of the text), _row (number of the row)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                       F.md5(text.cast("binary")).alias("key"), F.monotonically_increasing_id().alias("_row"))


def borders(rows: DataFrame) -> DataFrame:
    """key, bytes, at: for each group its bytes, and those of all groups up to and with it in the order of ``key``; stored in that order."""
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    # the first hex digits of a hash are buckets of equal depth
    digits = max(1, math.ceil(math.log(max(1, groups.count()) / BUCKET_GROUPS, 16)))
    groups = groups.withColumn("_b", F.substring("key", 1, digits))
    sums = groups.groupBy("_b").agg(F.sum("bytes").alias("t"))
    before = sums.select("_b", (F.sum("t").over(W.orderBy("_b")) - F.col("t")).alias("before"))
    inside = F.sum("bytes").over(W.partitionBy("_b").orderBy("key"))
    at = groups.withColumn("inside", inside).join(before, "_b").select("key", "bytes", (F.col("inside") + F.col("before")).alias("at"))
    return cut_lineage(at.repartitionByRange("key").sortWithinPartitions("key"))


def _last(at: DataFrame, limits: list[int], reach: int) -> list[int]:
    """For each limit the largest border at or under it (0 without one); ``reach`` is the size of the largest group."""
    edges = sorted({x + 1 for x in limits})
    near = at.where((F.col("at") > edges[0] - 1 - reach) & (F.col("at") < edges[-1]))
    got = dict(with_bucket(near, "at", edges).groupBy("_b").agg(F.max("at")).collect())  # a row for each limit at most
    largest, best = {}, 0
    for k, edge in enumerate(edges):
        best = largest[edge] = max(best, got.get(k, 0))
    return [largest[x + 1] for x in limits]


def smallest_capacity(at: DataFrame, shards: int, total: int, largest: int) -> int:
    """The smallest capacity with which ``shards`` contiguous shards hold all groups."""
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # the second one always does
    while low < high:
        step = max(1, -(-(high - low) // (TRIES + 1)))
        tries = list(range(low, high, step))[:TRIES]
        ends = [0] * len(tries)
        for _ in range(shards - 1):
            ends = _last(at, [e + c for e, c in zip(ends, tries, strict=True)], largest)
        fits = [e + c >= total for e, c in zip(ends, tries, strict=True)]
        # what is under a capacity that doesn't do doesn't either
        first = fits.index(True) if True in fits else len(tries)
        high = tries[first] if first < len(tries) else high
        low = tries[first - 1] + 1 if first else low
    return low


def cut_points(at: DataFrame, shards: int, total: int, capacity: int, largest: int) -> list[int]:
    """Byte positions of the cuts: no shard is over ``capacity``, and each takes its part of what is left as nearly as that allows.

    Filling every shard to the capacity would leave the last ones short, or empty where one group alone sets it. Filling from
    the end gives the earliest place of every cut; from there to the capacity, a cut is the border that is nearest to an
    even part of the rest (the lower one of two that are equally near), and after the cut before it wherever there is one.
    """
    earliest, end = [], total
    for _ in range(shards - 1):
        end = at.where((F.col("at") >= end - capacity) & (F.col("at") <= end)).agg(F.min("at")).first()[0] if end > capacity else 0
        earliest.append(end)
    earliest.reverse()
    cuts, done = [], 0
    for i, least in enumerate(earliest):
        goal = done + (total - done) // (shards - i)
        near = at.where((F.col("at") > done) & (F.col("at") >= least) & (F.col("at") <= done + capacity))
        lower, upper = near.agg(F.max(F.when(F.col("at") <= goal, F.col("at"))), F.min(F.when(F.col("at") > goal, F.col("at")))).first()
        found = [v for v in (lower, upper) if v is not None]
        done = min(found, key=lambda v: abs(v - goal)) if found else done
        cuts.append(done)
    return cuts


def shard_cuts(rows: DataFrame, shards: int) -> list[str]:
    """The last MD5 of every shard but the last one; a shard holds the texts over the cut before it, up to its own."""
    at = borders(rows)
    total, largest = at.agg(F.max("at"), F.max("bytes")).first()
    if total is None:
        return [""] * (shards - 1)
    cuts = cut_points(at, shards, total, smallest_capacity(at, shards, total, largest), largest)
    keys = {r["at"]: r["key"] for r in at.where(F.col("at").isin([c for c in cuts if c])).collect()} if any(cuts) else {}
    return [keys.get(c, "") for c in cuts]


def _numbered(rows: DataFrame) -> DataFrame:
    """``slot`` from 0 in every shard, by doc_id (nulls first), then in the order of the rows.

    Numbers come from counts of (shard, range of doc_id) and places inside. A range of one doc_id alone, or of null, may
    hold many rows and is told apart by the parts of the table that the rows come from.
    """
    # an edge after each edge: a doc_id that repeats so often that it is an edge has a range of its own
    edges = sorted({x for e in bucket_edges(rows, "doc_id") for x in (e, e + 1)})
    rows = with_bucket(rows, "doc_id", edges, "_b")
    rows = rows.withColumn("_b", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_b")))
    alone = [r["_b"] for r in rows.groupBy("_b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <=> hi").select("_b").collect()]
    rows = rows.withColumn("_p", F.when(F.col("_b").isin(alone), F.shiftright("_row", 33)).otherwise(0))
    counts = rows.groupBy("shard", "_b", "_p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "_b", "_p", (F.sum("n").over(W.partitionBy("shard").orderBy("_b", "_p")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "_b", "_p").orderBy("doc_id", "_row")) - 1
    return rows.withColumn("inside", inside).join(before, ["shard", "_b", "_p"]).withColumn("slot", F.col("inside") + F.col("before"))


def partition(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text; further columns are ignored).

    The largest shard is as small as contiguous shards of whole groups can be; see ``cut_points`` for the others. With
    fewer groups than shards some shards are empty. A null text counts as an empty one, in its group and with a size of 1.
    Rows with a null doc_id come first in their shard; repeated rows have slots of their own. An empty table gives an
    empty result.
    """
    assert shards >= 1
    rows = cut_lineage(measured(docs))
    shard: Column = F.lit(0)
    for cut in shard_cuts(rows, shards):
        shard = shard + (F.col("key") > cut).cast("int")
    out = _numbered(rows.withColumn("shard", shard))
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
