"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet through seeds, the word sequences of the minimal match length that they share. For each
such pair the longest common runs of words are found by running Karp-Rabin hashes and marked, longest first, without overlap; the
share of an item's words under tiles is its coverage. Tiles may stand in any order, so a reordered passage is still covered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shingles import Shingler

#: Words of benchmark items in a block. A block is sent to every task; more items make more blocks, each held against all documents.
BLOCK_WORDS = 1_000_000

_BASE = np.uint64(0x100000001B3)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Runs:
    """Karp-Rabin hashes of all windows of a word sequence, for any length."""

    def __init__(self, w: np.ndarray):
        self.w = w
        n = len(w)
        up = np.ones(n + 1, np.uint64)
        down = np.ones(n + 1, np.uint64)
        up[1:] = _BASE
        down[1:] = np.uint64(_inverse(int(_BASE)))
        self.up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * self.up[:n])])

    def windows(self, s: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``s`` unmarked words."""
        n = len(self.w) - s + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(marked)])
        at = np.flatnonzero(taken[s:] == taken[:n])
        return at, (self.sums[at + s] - self.sums[at]) * self.down[at]


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of word sequences ``a`` and ``b``: (place in a, place in b, length) of each tile."""
    ra, rb = _Runs(a), _Runs(b)
    ma, mb = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(len(a), len(b), 4 * least))
    while True:
        found, longest = [], 0
        at, ha = ra.windows(s, ma)
        bt, hb = rb.windows(s, mb)
        hit = np.flatnonzero(np.isin(hb, ha))
        where = defaultdict(list)
        if len(hit):
            for i, h in zip(at.tolist(), ha.tolist(), strict=True):
                where[h].append(i)
        for j, h in zip(bt[hit].tolist(), hb[hit].tolist(), strict=True):
            for i in where[h]:
                if i and j and a[i - 1] == b[j - 1] and not ma[i - 1] and not mb[j - 1]:
                    continue  # part of the match that starts one word earlier
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k >= s:
                    found.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not ma[i : i + k].any() and not mb[j : j + k].any():
                ma[i : i + k] = True
                mb[j : j + k] = True
                out.append((i, j, k))
        # what overlaps a tile may still hold a shorter match: look again at the same length before going down
        if any(not ma[i : i + k].all() and not mb[j : j + k].all() and k > s for k, i, j in found):
            continue
        if s <= least:
            return out
        s = max(least, s // 2)


class Block:
    """Items of a benchmark with the seeds that lead to them."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], least: int):
        self.items, self.least = items, least
        sh = Shingler(least)
        self.places = [sh.sequence(w) for _, w in items]  # the seed that starts at each word
        seeds = [np.unique(x, return_counts=True) for x in self.places]
        key = np.concatenate([s for s, _ in seeds])
        own = np.repeat(np.arange(len(items)), [len(s) for s, _ in seeds])
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order))
        self.owners = own[order]
        self.times = np.concatenate([n for _, n in seeds])[order]  # places of a seed in its item
        # an item shorter than the minimal match is its own minimal match, and hashed as a whole
        self.short = sorted({len(w) for _, w in items if len(w) < least})


def under(places: np.ndarray, shared: np.ndarray, least: int) -> int:
    """Words of an item that lie under shared seeds, at every place where these stand in it."""
    ends = np.zeros(len(places) + least, np.int64)
    at = np.flatnonzero(np.isin(places, shared))
    ends[at] += 1
    ends[at + least] -= 1
    return int((np.cumsum(ends) > 0).sum())


def hits(w: np.ndarray, block: Block, shingler: Shingler, cut: float) -> list[tuple[int, float, int, int]]:
    """(item number, coverage, longest tile, tiles) of the items whose words are covered to ``cut`` or more by tiles."""
    met, shared = defaultdict(int), []
    for n in [*block.short, block.least]:
        seq = np.unique(shingler.windows(w, n))
        at = np.minimum(np.searchsorted(block.keys, seq), len(block.keys) - 1)
        shared.append(seq[block.keys[at] == seq])
        for x in at[block.keys[at] == seq].tolist():
            s = slice(block.first[x], block.first[x + 1])
            for i, times in zip(block.owners[s].tolist(), block.times[s].tolist(), strict=True):
                met[i] += times
    shared = np.concatenate(shared)
    out = []
    for i, n in met.items():
        item = block.items[i][1]
        least = min(block.least, len(item))
        # tiles lie under shared seeds: where these cover too few of the item's words, tiles can't reach the threshold
        if min(n * least, len(item)) / len(item) < cut or under(block.places[i], shared, least) / len(item) < cut:
            continue
        t = tiles(item, w, least)
        coverage = sum(k for _, _, k in t) / len(item)
        if coverage >= cut:
            out.append((i, coverage, max(k for _, _, k in t), len(t)))
    return out


def blocks(benchmark: DataFrame, least: int) -> Iterator[Block]:
    """The benchmark in blocks of ``BLOCK_WORDS`` words, taken from the cluster one partition at a time."""
    sh, held, size = Shingler(least), [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        w = sh.word_hashes(r["text"])
        if not len(w):
            continue
        held.append((r["item_id"], w))
        size += len(w)
        if size >= BLOCK_WORDS:
            yield Block(held, least)
            held, size = [], 0
    if held:
        yield Block(held, least)


LEAKS = "doc_id long, item_id long, coverage double, longest long, n_tiles long"


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, cut: float = 0.6) -> DataFrame:
    """doc_id, item_id, coverage, longest (tile, in words), n_tiles for every document and item covered to ``cut`` or more.

    Words are cut at ASCII white space, A-Z lower-cased. ``docs`` has doc_id and text, ``benchmark`` item_id and text; further
    columns are ignored. Null and blank texts, on either side, meet nothing. Repeated rows, on either side, give repeated rows of the
    result. Null ids stay null. An empty side gives an empty result.
    """
    return _found(docs, benchmark, least, cut).drop("text_hash")


def _found(docs: DataFrame, benchmark: DataFrame, least: int, cut: float) -> DataFrame:
    """``leaks`` with a hash of the document's text: an id may be null or have several texts."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    kind, out = f"{LEAKS}, text_hash long", None
    for block in blocks(benchmark, least):
        part = own.mapInArrow(_search(spark.sparkContext.broadcast(block), least, cut), kind)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], kind)


def _search(sent, least: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sh = sent.value, Shingler(least)
        for batch in batches:
            rows = []
            for d, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                w = sh.word_hashes(text.as_py())
                if len(w):
                    rows += [(d, block.items[i][0], c, k, n, h) for i, c, k, n in hits(w, block, sh, cut)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "coverage", "longest", "n_tiles", "text_hash"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, cut: float = 0.6, nulls: bool = False) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns pass through.

    Rows go by doc_id and text, so another text of the same doc_id stays. Rows with a null doc_id are kept unless ``nulls``.
    """
    found = _found(docs, benchmark, least, cut)
    found = found.select(F.col("doc_id").alias("__leak_doc"), F.col("text_hash").alias("__leak_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__leak_doc")) & (F.xxhash64("text") == F.col("__leak_text"))
    return docs.join(found if nulls else found.where("__leak_doc is not null"), same, "left_anti").select(docs.columns)
