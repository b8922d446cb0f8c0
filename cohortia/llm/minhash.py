"""Near-duplicates by SuperMinHash signatures, bands, exact verification and union-find.

A signature comes from correlated ranks: every shingle carries its own random permutation of the ``m`` positions, and
its j-th rank competes at one position only (j + u at position p_j). A position that was filled at an earlier rank is
never improved by a later one, so a document stops as soon as all of its positions are filled: about max(n, m ln m)
steps for n shingles instead of n * m, and each position is hit more evenly than by independent hashes, which lowers the
variance of the similarity estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import mix, stream
from cohortia.llm.components import components
from cohortia.llm.shingles import Shingler
from cohortia.session import broadcast_if_small, cut_lineage

_LOW, _S32 = np.uint64(0xFFFFFFFF), np.uint64(32)

#: Elements whose permutations are held at once.
CHUNK = 150_000

#: Pairs of a hub in one salt, turns in which components meet by single members, and cells in which shingles are counted (as a power of two).
#: None of them changes a result.
HUB_PAIRS, HUB_TURNS, DF_BITS = 256, 1, 18


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (documents x m, uint64) of sets of 64-bit hashes; the row of an empty set keeps the largest value.

    A value is (rank << 32) + u: equal at a position with the probability of the sets' Jaccard similarity.
    """
    assert 2 <= m <= 256
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        _sign(sets[start:end], out[start:end], m)
        start = end
    return out


def _sign(sets: list[np.ndarray], h: np.ndarray, m: int) -> None:
    n = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), n)
    flat = h.reshape(-1)
    p = None
    for j in range(m):
        if not len(x):
            return
        z = mix(x + stream(j))
        k = (j + (((z & _LOW) * np.uint64(m - j)) >> _S32).astype(np.int64))
        if j == 0:
            place = k
        else:
            rows = np.arange(len(x))
            place = p[rows, k].astype(np.int64)
            p[rows, k] = p[:, j]
        np.minimum.at(flat, doc * m + place, (np.uint64(j) << _S32) | (z >> _S32))
        full = h.max(axis=1) < (np.uint64(j + 1) << _S32)
        left = ~full[doc]
        if j == 0:
            x, doc, first = x[left], doc[left], place[left]
            p = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
            p[np.arange(len(x)), first] = 0
        elif not left.all():
            x, doc, p = x[left], doc[left], p[left]


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    rows = sig.shape[1] // bands
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), np.uint64)
    for i in range(rows):
        key = mix(key + parts[:, :, i] + stream(i))
    return key


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a 128-bit hash of the set), keys (a key for each band; null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = sh.sets(part.column(1).to_pylist())
                key = band_keys(super_min_hash(sets, bands * rows), bands).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([mix(s ^ stream(0)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(h1), pa.array(h2), keys], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, s (sorted distinct shingle hashes of the whole text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = sh.sets(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; ``a`` may be a hub of many pairs.

    The pairs of a hub are dealt over one salt for each ``HUB_PAIRS`` of them, and its set is sent to each salt.
    """
    pairs = cut_lineage(pairs)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("salts"))
    many = cut_lineage(hubs.where("salts > 1"))
    pairs = pairs.join(broadcast_if_small(many, 10_000), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    left = hubs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    met = pairs.select("a", "b", "salt").join(right, "b").join(left, ["a", "salt"]).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return met.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _close(x: str, y: str, percent: int) -> Column:
    """Whether sets of these sizes can be as similar as that."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``members`` with ``c``, the component of a document."""
    return members.join(comp, members["doc_id"] == comp["node"], "left").select("band", "key", "doc_id", "n", "pop", F.coalesce("root", "doc_id").alias("c"))


def hub_pairs(members: DataFrame, comp: DataFrame, turn: int, percent: int) -> DataFrame:
    """A pair (a, b) for each component that meets a larger one in a bucket: the best known member of both, or from the second turn on one that is drawn."""
    draw = F.struct((F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("pop")).alias("u"), "doc_id", "n")
    parts = cut_lineage(_labelled(members, comp).groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("many"), F.min(draw).alias("one")))
    top = parts.groupBy("band", "key").agg(F.max(F.struct("many", "c", "one")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "key", "top")
    met = parts.join(top, ["band", "key"]).where(F.col("c") != F.col("top.c")).select("c", F.col("one.doc_id").alias("b"), F.col("one.n").alias("n"), F.col("top.one.doc_id").alias("a"), F.col("top.one.n").alias("na"), F.xxhash64("band", "key", F.lit(turn)).alias("u"))
    return met.where(_close("n", "na", percent)).groupBy("c").agg(F.min(F.struct("u", "a", "b")).alias("x")).select("x.a", "x.b")


def prefix_pairs(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of documents of different components, in buckets with several, that can be linked: exact prefix filter.

    In one order of all shingles, rare ones first, a set x and a set y that is as large or larger can only be linked if one of the first
    |x| - ceil(2t / (1 + t) |x|) + 1 shingles of x is among the first |y| - ceil(t |y|) + 1 of y. Documents that have no more than a
    template in common differ in their rare shingles and don't meet. Rarity is counted in 2^DF_BITS cells of the hash range,
    which come to the driver; any order gives the same links.
    """
    now = _labelled(members, comp)
    open_ = now.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "key")
    docs = now.join(open_, ["band", "key"], "left_semi").groupBy("doc_id").agg(F.min("c").alias("c"))
    rest = cut_lineage(docs.join(sets, "doc_id").select("doc_id", "c", "s"))
    shift = np.uint64(64 - DF_BITS)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << DF_BITS, np.int64)
        for batch in batches:
            n += np.bincount((batch.column(0).flatten().to_numpy().view(np.uint64) >> shift).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    counted = rest.select("s").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << DF_BITS, np.int64)
    common[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    often = rest.sparkSession.sparkContext.broadcast(common)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = s.values.to_numpy()
                n = len(x)
                probe, index = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                x = x[np.lexsort((x, often.value[(x.view(np.uint64) >> shift).astype(np.int64)]))[:probe]]
                out.append((x, np.full(len(x), d), np.full(len(x), c), np.full(len(x), n), np.arange(len(x)), np.arange(len(x)) < index))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["token", "doc_id", "c", "n", "i", "own"])

    pre = cut_lineage(rest.mapInArrow(first, "token long, doc_id long, c long, n long, i long, own boolean"))
    shared = pre.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("own").alias("any")).where("lo <> hi and any").select("token")
    pre = pre.join(shared, "token", "left_semi")
    left = pre.where("own").select("token", F.col("doc_id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    # from the first shared one on, what is left of both must still make up the overlap that a link needs
    enough = (100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("n") - F.col("i")) >= percent * (F.col("n") + F.col("na"))
    met = pre.join(left, "token").where((F.col("c") != F.col("ca")) & _close("n", "na", percent) & (F.struct("na", "a") < F.struct("n", "doc_id")) & enough)
    return met.select("a", F.col("doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; further columns are ignored).

    Two texts are linked when their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` or more,
    confirmed on the full sets. ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that row.

    * Equal sets are one class with one representative; a class of any size costs one partial aggregation.
    * Candidates share a band. With 40 bands of 5 positions a pair at similarity 0.8 shares none with probability 1.2e-7.
    * A bucket never emits all of its pairs. First every document meets one document, that of its buckets which meets most others.
      Then, for some turns, every component meets one larger component of a bucket, by one member of each. What is still in buckets with
      several components goes through an exact prefix filter, so no candidate pair across components stays unverified.

    Null or blank texts have the empty set and are linked with nothing. A row with a null doc_id keeps a null
    component and is kept. Rows that repeat a doc_id are one document; if their texts differ, their links join.
    """
    sig = cut_lineage(signatures(docs, words, bands, rows))
    whole = sig.where("n_shingles > 0 and doc_id is not null")
    classes = whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = whole.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    every = reps.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key"))
    size = every.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut_lineage(every.join(size, ["band", "key"]))
    # how many documents a document meets: in a group of near copies, the one that the others come from meets most
    known = cut_lineage(members.groupBy("doc_id").agg((-F.sum("size")).alias("pop")))
    members = cut_lineage(members.join(known, "doc_id").select("band", "key", "doc_id", "n", "pop"))
    wanted = known.select("doc_id")
    sets = cut_lineage(shingle_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), words))

    hubs = members.groupBy("band", "key").agg(F.min(F.struct("pop", "doc_id", "n")).alias("hub"))
    first = members.join(hubs, ["band", "key"]).where(F.col("hub.doc_id") != F.col("doc_id")).where(_close("n", "hub.n", percent))
    first = first.groupBy("doc_id").agg(F.min("hub").alias("hub")).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"))
    comp = components(cut_lineage(verified(first, sets, percent)))

    def joined(pairs: DataFrame) -> DataFrame | None:
        new = cut_lineage(verified(pairs, sets, percent))
        return None if new.isEmpty() else components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))

    for turn in range(HUB_TURNS):
        more = joined(hub_pairs(members, comp, turn, percent))
        if more is None:
            break
        comp = more
    comp = joined(prefix_pairs(members, comp, sets, percent)) or comp
    moved = classes.join(comp, classes["rep"] == comp["node"], "left").where("copies > 1 or root is not null").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(moved, ["h1", "h2"], "left")
    comp_id = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(comp_id == F.col("doc_id"), F.lit(True)).alias("kept"))
