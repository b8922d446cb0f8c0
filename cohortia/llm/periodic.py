"""Runs: maximal stretches of words that repeat with a period, in whole texts.

Every run shows up as a Lyndon word: for one of the two orders of the words (one the reverse of the other), the longest
Lyndon word that starts somewhere in the run's second half or before has the run's period as its length. So each place
gives two candidates, the distances to the next smaller and to the next larger suffix, and a candidate is extended to
both sides by longest common extensions: from the suffix tree of the text to the right, from that of its reversal to the
left. Ukkonen's construction, an Euler tour with constant-time minima and the extensions take time linear in the words.

A word of a run of four or more periods stands there four times or more. So stretches are cut, again and again, at words
that stand less often in their stretch; no run is lost or shortened by that. What is left of a batch of documents goes
into one tree, with marks between the stretches that stand nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import let
from cohortia.llm.suffixtree import SuffixTree

#: Characters of texts that are taken together (a longer text alone), and words in one tree (a longer stretch alone).
BATCH_CHARS, TREE_WORDS = 4_000_000, 100_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("period", pa.list_(pa.int64())), ("collapsed", pa.string())])


def _next_lower(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a lower rank, or the length."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out, np.int64)


def runs_of(s: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs in ``s`` (integers from 0 on) with length >= max(least, times * period); times >= 2."""
    n = len(s)
    if n < max(least, 2):
        return np.empty((0, 3), np.int64)
    s = np.unique(s, return_inverse=True)[1] + 1
    tree = SuffixTree(s)
    i = np.arange(n)
    # the end mark takes part: it is the lowest word in one order and the highest in the other
    pairs = [np.stack([i, f[:n] - i], 1) for f in (_next_lower(tree.rank), _next_lower(n - tree.rank))]
    at, q = np.concatenate(pairs).T
    pick = (at + q < n) & (q * times <= n)
    at, q = at[pick], q[pick]
    right = tree.extension(at, at + q)
    del tree
    start, end = at.copy(), at + q + right
    inner = np.flatnonzero(at > 0)
    if len(inner):
        back = SuffixTree(s[::-1])
        start[inner] -= back.extension(n - at[inner], n - at[inner] - q[inner])
    found = np.stack([start, end - start, q], 1)
    return np.unique(found[found[:, 1] >= np.maximum(least, times * q)], axis=0)


def _stretches(ids: np.ndarray, seg: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, and their stretches, that can be in runs: each word stands ``times`` times or more in its stretch."""
    pos = np.arange(len(ids))
    width = int(ids.max(initial=0)) + 1
    while len(pos):
        _, back, many = np.unique(seg * width + ids[pos], return_inverse=True, return_counts=True)
        kept = many[back] >= times
        pos, old = pos[kept], seg[kept]
        if not len(pos):
            break
        new = np.cumsum(np.concatenate([[0], (np.diff(pos) != 1) | (np.diff(old) != 0)]))
        long = np.bincount(new)[new] >= least
        if kept.all() and long.all():
            return pos, new
        pos, seg = pos[long], new[long]
    return pos, pos


def find_in_words(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each word list, by start, then period."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    pos, seg = _stretches(ids, np.repeat(np.arange(len(texts)), sizes), least, times)
    found = [np.empty((0, 3), np.int64)]
    edges = np.flatnonzero(np.diff(seg, prepend=-1, append=-1)) if len(pos) else np.zeros(1, np.int64)
    k = 0
    while k < len(edges) - 1:
        end = k + 1
        while end < len(edges) - 1 and edges[end + 1] - edges[k] <= TREE_WORDS:
            end += 1
        part = pos[edges[k] : edges[end]]
        borders = edges[k + 1 : end] - edges[k]
        marks = len(known) + np.arange(len(borders))
        r = runs_of(np.insert(ids[part], borders, marks), least, times)
        # back to places among all words: a stretch starts later by the marks before it
        r[:, 0] = part[r[:, 0] - np.searchsorted(borders + np.arange(len(borders)), r[:, 0])]
        found.append(r)
        k = end
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    first = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(runs[:, 0], first)
    out = [runs[a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for r, f in zip(out, first, strict=False):
        r[:, 0] -= f
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row of ``docs`` (doc_id, text; further columns are ignored).

    A word is a stretch without ASCII white space, as it stands. A run is a stretch of words with smallest period q and a
    length of max(least, times * q) or more that no neighbouring word extends; ``times`` is two or more. ``runs`` has
    structs (start, length, period), by start, then period; ``collapsed`` is the text's words joined by one blank,
    without those that a run has after its first q words.

    A null or blank text has no words and no runs and collapses to an empty text. Null doc_ids and repeated rows are rows
    like any other, and an empty table gives an empty result. Memory grows with the longest text, never with the table.
    """
    assert times >= 2

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_in_words(texts, least, times)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32))
        every = np.concatenate(found)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(every[:, k]))) for k in range(3)]
        text = pa.array([_collapsed(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), *lists, text], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode()
                ids.append(d.as_py())
                texts.append(raw.split())
                size += len(raw)
                if size >= BATCH_CHARS:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    return out.select("doc_id", "n_words", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, of several the first by start, then period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of a tenth of its documents made periodic from some word on.

    h is the unsigned CRC-32 of the decimal doc_id and g = floor(h / 10). If h % 10 = 0 and the text has n > 0 words,
    every word from number a = g % n on becomes word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)). A row
    with a null doc_id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")).otherwise(F.col("text"))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, rewritten)).otherwise(F.col("text")))
