"""Toxicity: a support vector machine on the subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the character triples they have in common, gaps allowed: a triple that spans L characters
of a word weighs DECAY ** L, so an insult with inserted or missing characters stays close to the insult. Landmarks
are words of the training sample; a word's Nyström features are its kernel values to the landmarks, whitened by the
landmarks' own kernel matrix. A text's score is that of its worst word, and the machine is trained accordingly: every toxic
text puts forward its most suspicious word, clean texts put forward theirs, and both are chosen anew in each round.

The trained function is linear in the kernel values, so it is linear in the triples of the landmarks: it is scored from a
table of their weights, which gives exactly the same values.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY = 0.7
#: The most characters that may stand between the ends of a triple beyond its own.
GAP = 2
#: Longer words are cut into pieces that overlap by half.
PIECE = 40

_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")


def units(text: str | None) -> set[str]:
    """Distinct lower-cased words of the whole text; runs of single characters also as one word."""
    low = (text or "").lower()
    found = set(low.split())
    found.update(m[0].replace(" ", "") for m in _SPACED.finditer(low))
    for w in [w for w in found if len(w) > PIECE]:
        found.remove(w)
        found.update(w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2))
    return found


def triples(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's explicit features of each word: (word number, triple, weight). A triple that a word has in several places comes
    several times; its weight is the sum. With these sums a word has unit length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w) + 2, []).append(i)
    owner, keys, weights = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0)]
    b = np.uint64(21)
    for size, numbers in groups.items():
        if size < 3:
            continue
        text = "".join(f"\x02{words[i]}\x03" for i in numbers)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, size)
        key, wt = [], []
        for span in range(2, min(3 + GAP, size)):
            left, right = c[:, : size - span] << (b + b), c[:, span:]
            for mid in range(1, span):
                key.append(left | (c[:, mid : size - span + mid] << b) | right)
                wt.append(np.full(size - span, DECAY ** (span + 1)))
        key, wt = np.concatenate(key, axis=1), np.concatenate(wt)
        order = np.argsort(key, axis=1)
        ks, ws = np.take_along_axis(key, order, 1), wt[order]
        norm = (ws * ws).sum(axis=1)
        for d in range(1, ks.shape[1]):  # equal triples stand together: their products, one distance after the other
            same = ks[:, d:] == ks[:, :-d]
            if not same.any():
                break
            norm += 2 * (ws[:, d:] * ws[:, :-d] * same).sum(axis=1)
        owner.append(np.repeat(np.array(numbers), key.shape[1]))
        keys.append(key.reshape(-1))
        weights.append((wt[None, :] / np.sqrt(norm)[:, None]).reshape(-1))
    return np.concatenate(owner), np.concatenate(keys), np.concatenate(weights)


def kernel(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Normalised kernel values of all of ``a`` (rows) with all of ``b``."""
    oa, ka, va = triples(a)
    ob, kb, vb = triples(b)
    every = np.unique(kb)
    dense = np.zeros((len(b), len(every)))
    np.add.at(dense, (ob, np.searchsorted(every, kb)), vb)
    at = np.searchsorted(every, ka)
    hit = (at < len(every)) & (every[np.minimum(at, len(every) - 1)] == ka)
    out = np.zeros((len(a), len(b)))
    oa, at, va = oa[hit], at[hit], va[hit]
    for lo in range(0, len(oa), 20_000):  # bounded rows of triples at a time
        s = slice(lo, lo + 20_000)
        np.add.at(out, oa[s], va[s, None] * dense[:, at[s]].T)
    return out


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted triples of the landmarks
    values: np.ndarray
    bias: float
    slope: float  # of the calibration
    offset: float

    def margins(self, words: Sequence[str]) -> np.ndarray:
        own, key, val = triples(words)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.bincount(own[hit], val[hit] * self.values[at[hit]], len(words)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    active = np.ones(len(a), bool)
    for _ in range(50):
        p = a[active] * cost[active, None]
        new = np.linalg.solve(p.T @ a[active] + np.diag(ridge), p.T @ y[active])
        now = y * (a @ new) < 1
        done = np.array_equal(now, active) or np.abs(new - w).max() < 1e-8
        w, active = new, now
        if done or not active.any():
            break
    return w[:-1], w[-1]


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the labels over the margins; smoothed targets keep it finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([f, np.ones(len(f))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - t) + 1e-6 * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train(rows: Sequence[tuple[str, int]], landmarks: int = 192, rounds: int = 4, negatives: int = 6000, l2: float = 0.05) -> ToxicModel:
    """``rows``: a bounded sample of (text, 0 or 1). Without both labels the result is a constant score."""
    y = np.array([v for _, v in rows], int)
    if len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.0
        return ToxicModel(np.zeros(1, np.uint64), np.zeros(1), 0.0, 0.0, math.log((p + 1e-3) / (1 - p + 1e-3)))
    docs = [sorted(units(t)) for t, _ in rows]
    seen = [Counter(), Counter()]
    for d, v in zip(docs, y, strict=True):
        seen[v].update(d)
    n = [int((y == 0).sum()), int((y == 1).sum())]
    words = sorted(set(seen[0]) | set(seen[1]))
    number = {w: i for i, w in enumerate(words)}
    c1, c0 = (np.array([s[w] for w in words], float) for s in (seen[1], seen[0]))
    odds = np.log((c1 + 0.1) / (n[1] + 1)) - np.log((c0 + 0.5) / (n[0] + 1))
    lift = c1 * np.maximum(odds, 0)
    rank = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    half = landmarks // 2
    suspects = np.lexsort((rank, -lift))[:half]
    common = np.lexsort((rank, -c0))[: half // 2]
    usual = np.lexsort((rank, c0 == 0))[: landmarks - half - len(common)]
    marks = [words[i] for i in dict.fromkeys([*suspects, *common, *usual])]
    val, vec = np.linalg.eigh(kernel(marks, marks))
    ok = val > 1e-8
    white = vec[:, ok] / np.sqrt(val[ok])
    lists = [np.array([number[w] for w in d], np.int64) for d in docs]
    some = np.flatnonzero(c0 > 0)
    some = some[np.argsort(rank[some])][:negatives]
    # a witness has to be commoner in toxic texts; at first also seen often enough for that to be no chance
    witness = odds > math.log(3)
    score, model = np.where(witness & (c1 >= 3), lift, 0.0), None
    own, key, kv = triples(marks)
    for _ in range(rounds):
        worst = np.array([ix[np.argmax(score[ix])] if len(ix) else -1 for ix in lists])
        has = worst >= 0
        good = has & (y == 1)
        good[good] = (score[worst[good]] > 0) & witness[worst[good]]
        pos = np.unique(worst[good], return_counts=True)
        neg = np.setdiff1d(np.concatenate([worst[has & (y == 0)], some]), pos[0])
        if not len(pos[0]):
            break
        x = kernel([words[i] for i in [*pos[0], *neg]], marks) @ white
        t = np.r_[np.ones(len(pos[0])), -np.ones(len(neg))]
        heavy = np.sqrt(1 + c0[neg])  # a word of many clean texts is a surer negative
        w, b = _svm(x, t, np.r_[np.sqrt(pos[1]) / np.sqrt(pos[1]).sum(), heavy / heavy.sum()] * 100, l2)
        beta = white @ w
        keys, inv = np.unique(key, return_inverse=True)
        model = ToxicModel(keys, np.bincount(inv, kv * beta[own], len(keys)), float(b), 1.0, 0.0)
        score = np.concatenate([model.margins(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
    if model is None:
        return ToxicModel(np.zeros(1, np.uint64), np.zeros(1), 0.0, 0.0, math.log(n[1] / n[0]))
    f = np.array([score[ix].max() if len(ix) else model.bias for ix in lists])
    model.slope, model.offset = _platt(f, y)
    return model


class _Margins(dict):
    """Margins of words seen by this task; forgets them all beyond a number of words."""

    def __init__(self, model: ToxicModel, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def learn(self, words: set[str]) -> None:
        if len(self) > self.limit:
            self.clear()
        new = sorted(words.difference(self))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.update(zip(part, self.model.margins(part).tolist(), strict=True))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 at 0.5 or more) of every row of ``docs`` (doc_id, text; further columns are ignored).

    Whole texts are read, however long. A null, empty or blank text has the model's score of no word at all. Rows are scored
    by themselves: repeated rows get equal scores, a null doc_id stays null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as many triples as the landmarks have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = _Margins(m)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [units(t) for t in part.column(1).to_pylist()]
                known.learn(set().union(*sets))
                f = np.array([max(map(known.__getitem__, s)) if s else m.bias for s in sets])
                p = m.probability(f)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
