"""Line dedup by a sharded minimal perfect hash with compact fingerprint and count arrays.

The distinct line keys are dealt into shards by their hash. A shard numbers its n keys 0 .. n-1 by a minimal perfect hash and
keeps, at those numbers, a 32-bit fingerprint, a saturating 8-bit count of documents, and for frequent keys the last holder. It
is one row of at most a few MB. Documents send the hashes of their lines (never the lines) to the shard, which streams
them past its arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm import mphf
from cohortia.llm.common import SPACE, UPPER, LOWER, shuffle_partitions
from cohortia.session import cut_lineage

#: Keys in a shard, about; its arrays then take under a megabyte.
SHARD_KEYS = 50_000

_FOLD = str.maketrans(UPPER, LOWER)
_LINES = "doc_id long, text_hash long, line_no int, h1 long, h2 long, first boolean"
_INDEX = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary, frequent binary, holders binary"


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key has at least ``min_chars`` code points: where it stands and its key's 128-bit hash.

    ``first`` marks the first line of a document with that key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(5)]
            digest = bytearray()
            for d, th, text in zip(ids, hashes, batch.column(2), strict=True):
                seen = set()
                for no, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(SPACE)
                    if len(key) < min_chars:
                        continue
                    h = xxhash.xxh3_128_digest(key.translate(_FOLD).encode("utf-8", "surrogatepass"))
                    for c, v in zip(cols, (d, th, no, None, h not in seen), strict=True):
                        c.append(v)
                    seen.add(h)
                    digest += h
                if len(cols[0]) >= 50_000:
                    yield rows(cols, digest)
                    cols, digest = [[] for _ in range(5)], bytearray()
            yield rows(cols, digest)

    def rows(cols: list[list], digest: bytearray) -> pa.RecordBatch:
        h = np.frombuffer(bytes(digest), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([
            pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(np.ascontiguousarray(h[:, 0])),
            pa.array(np.ascontiguousarray(h[:, 1])), pa.array(cols[4], pa.bool_())], names=["doc_id", "text_hash", "line_no", "h1", "h2", "first"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, _LINES)


def build_index(keys: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """One row for each shard of ``keys`` (h1, h2, n_docs, holder)."""
    def pack(h: np.ndarray, n: np.ndarray, holder: np.ndarray, shard: int) -> dict:
        h1, h2 = h[:, 0], h[:, 1]
        sizes, bits = mphf.build(h1, h2)
        at = mphf.Lookup(sizes, bits)(h1, h2)
        order = np.argsort(at)
        often = np.flatnonzero(n[order] >= min_docs).astype(np.int32)
        return {"shard": shard, "sizes": sizes, "bits": bits, "fingerprints": (h2[order] >> np.uint64(32)).astype(np.uint32).tobytes(),
                "counts": np.minimum(n[order], 255).astype(np.uint8).tobytes(), "frequent": often.tobytes(), "holders": holder[order][often].tobytes()}

    schema = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("bits", "fingerprints", "counts", "frequent", "holders")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None  # rows come sorted by shard

        def packed() -> pa.RecordBatch:
            c = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_pylist([pack(np.stack([c[0], c[1]], 1).view(np.uint64), c[2], c[3], own)], schema=schema)

        for batch in batches:
            col = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cuts = np.flatnonzero(np.diff(col[0])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(col[0])], strict=True):
                if hi <= lo:
                    continue
                if own is not None and col[0][lo] != own:
                    yield packed()
                    held.clear()
                own = int(col[0][lo])
                held.append([c[lo:hi] for c in col[1:]])
        if held:
            yield packed()

    dealt = keys.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "n_docs", F.coalesce("holder", F.lit(np.iinfo(np.int64).min)).alias("holder"))
    return dealt.repartition(shuffle_partitions(keys.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, _INDEX)


def probe(index: DataFrame, lines: DataFrame, shards: int, salts: dict[int, int], min_docs: int) -> DataFrame:
    """doc_id, text_hash, line_no of the lines that go: key in ``min_docs`` documents or more, document not its last holder.

    ``salts`` names the shards whose probes are dealt into several units; their arrays go to each of these.
    """
    spark = index.sparkSession

    def split(shard: Column) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv]), shard), F.lit(1)) if salts else F.lit(1)

    def none(name: str, kind: str) -> Column:
        return F.lit(None).cast(kind).alias(name)

    arrays = ["sizes", "bits", "fingerprints", "counts", "frequent", "holders"]
    left = index.select("shard", F.explode(F.sequence(F.lit(0), split(F.col("shard")) - 1)).alias("salt"), F.lit(0).alias("kind"), *arrays,
                        none("doc_id", "long"), none("text_hash", "long"), none("line_no", "int"), none("h1", "long"), none("h2", "long"))
    own = F.pmod("h1", F.lit(shards)).cast("int")
    types = dict(index.dtypes)
    right = lines.withColumn("shard", own).select("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "line_no"), split(F.col("shard"))).cast("int").alias("salt"), F.lit(1).alias("kind"),
                                                  *[none(c, types[c]) for c in arrays], "doc_id", "text_hash", "line_no", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, look, fp, counts, often, holders = None, None, None, None, None, None
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * (1 << 31) + batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (kind[1:] == 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if hi <= lo:
                    continue
                if kind[lo] == 0:  # the arrays of a unit come before its probes
                    unit = key[lo]
                    sizes, bits, *rest = (batch.column(3 + i)[lo].as_py() for i in range(6))
                    look = mphf.Lookup(sizes, bits)
                    fp, counts, often, holders = (np.frombuffer(b, t) for b, t in zip(rest, (np.uint32, np.uint8, np.int32, np.int64), strict=True))
                    lo += 1
                    if hi <= lo:
                        continue
                assert unit == key[lo]
                part = batch.slice(lo, hi - lo)
                h1, h2 = (part.column(i).to_numpy().view(np.uint64) for i in (12, 13))
                at = look(h1, h2)
                known = (at >= 0) & (fp[at] == (h2 >> np.uint64(32)).astype(np.uint32))
                hot = np.flatnonzero(known & (counts[at] >= min(min_docs, 255)))
                where = np.searchsorted(often, at[hot])
                ok = where < len(often)
                hot, where = hot[ok], where[ok]
                ok = often[where] == at[hot]
                hot, where = hot[ok], where[ok]
                ids = part.column(9).fill_null(np.iinfo(np.int64).min).to_numpy()
                gone = hot[ids[hot] != holders[where]]
                if len(gone):
                    take = pa.array(gone)
                    yield pa.RecordBatch.from_arrays([part.column(i).take(take) for i in (9, 10, 11)], names=["doc_id", "text_hash", "line_no"])

    both = left.unionByName(right).repartition(shuffle_partitions(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, "doc_id long, text_hash long, line_no int")


def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The text without its lines of these numbers; null without a text."""
    def one(t: str | None, numbers: np.ndarray) -> str | None:
        if t is None:
            return None
        drop = set(numbers.tolist())
        return "\n".join(line for no, line in enumerate(t.split("\n")) if no not in drop)

    return pd.Series([one(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with three columns more: ``n_lines`` (before), ``n_dropped``, ``kept_text``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that are
    found in at least ``min_docs`` documents lose all their lines, except in the largest doc_id that holds the key.

    A null or empty text is one empty line and stays empty. All rows of a doc_id are one document, and all rows with the largest
    doc_id keep the line. A row with a null doc_id is a document of its own and ranks below every other. Columns of ``docs`` named like the new ones are
    replaced; others pass through. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = cut_lineage(line_keys(docs, min_chars))
    # rows of one doc_id are one document; counted by key and document first, so that a hot key is spread
    by_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.sum(F.col("first").cast("long")).alias("rows"), F.count(F.lit(1)).alias("n"))
    keys = cut_lineage(by_doc.groupBy("h1", "h2").agg(
        F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("n_docs"), F.sum("n").alias("n"), F.max("doc_id").alias("holder")))
    # a unit holds about half of an average partition: a shard with more probes is split into several units
    units = 2 * shuffle_partitions(spark)
    shards = max(-(-keys.count() // SHARD_KEYS), units)
    load = keys.groupBy(F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n"))
    total = keys.agg(F.sum("n")).first()[0] or 0
    most = max(1, total // units)
    hot = load.where(F.col("n") > 2 * most).collect()  # at most units / 2 shards can be that full
    gone = probe(build_index(keys, shards, min_docs), lines, shards, {r["shard"]: -(-r["n"] // most) for r in hot}, min_docs)
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("__gone"))
    base = docs.drop("n_lines", "n_dropped", "kept_text").withColumn("__line_doc", F.col("doc_id").cast("long")).withColumn("__line_text", F.xxhash64("text"))
    gone = gone.select(F.col("doc_id").alias("__gone_doc"), F.col("text_hash").alias("__gone_text"), "__gone")
    out = base.join(gone, F.col("__line_doc").eqNullSafe(F.col("__gone_doc")) & (F.col("__line_text") == F.col("__gone_text")), "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.pandas_udf(without_lines, "string")(F.when(F.col("__gone").isNotNull(), F.col("text")), "__gone")
    return out.select(*[c for c in base.columns if c not in ("__line_doc", "__line_text")], F.size(split).cast("long").alias("n_lines"),
                      F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"))
