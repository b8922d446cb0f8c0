"""Connected components over an edge table of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.session import cut_lineage

#: Nodes that one union-find holds before it hands on what it has; a larger number only means fewer rows shuffled.
LOCAL_NODES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find with path halving over the edges of one partition; gives each node with its smallest known one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        if len(up) >= LOCAL_NODES:
            yield flush()
            up.clear()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) that has a smaller node in its component.

    Each partition first contracts its own edges by union-find. Large-star and small-star steps then join what the
    partitions found, until nothing changes: a node's neighbours are never gathered, only their minimum. Rows with a
    null end and loops are ignored; repeated edges do no harm; without edges the result is empty.
    """
    def local(e: DataFrame) -> DataFrame:
        return cut_lineage(e.mapInArrow(_contract, "a long, b long").distinct())

    e = local(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b")).where("a is not null and b is not null and a <> b"))
    while True:
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours are tied to the smallest
        large = large.where("a <> b").distinct()
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        new = local(small.where("a <> b"))
        # a forest of stars in which no root has a smaller neighbour is final
        open_ = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        many = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if open_.isEmpty() and many.isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = new
