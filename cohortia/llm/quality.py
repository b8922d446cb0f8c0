"""Quality: ordinal regression by cumulative links on hashed text.

P(grade <= j) = 1 / (1 + exp(w.x - t_j)): one weight vector for all grades and ordered thresholds t_0 < t_1 < ... The model gives
an expected grade and the probability of a grade or better, by which documents are selected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.llm.common import Hashes

#: Hashed dimensions of the weights.
DIMS = 1 << 15

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _bin(x: float, cuts: Sequence[float]) -> int:
    return sum(x > c for c in cuts)


class Features:
    """Hashed features of a text: tokens (log counts, unit length) and the bins of a few shares that describe its shape."""

    def __init__(self):
        self.hash = Hashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.array([self.hash[b"#empty"] % DIMS]), np.ones(1)
        count = Counter(tokens)
        n = len(tokens)
        letters = [t for t in count if t[0].isalpha()]
        caps = sum(count[t] for t in letters if len(t) > 1 and t.isupper())
        marks = sum(count[t] for t in count if not t[0].isalnum())
        pairs = sum(map(str.__eq__, tokens, tokens[1:]))
        shape = {"caps": _bin(caps / n, (0.02, 0.1, 0.3)), "marks": _bin(marks / n, (0.1, 0.2, 0.3, 0.4)), "twice": _bin(pairs / n, (0.01, 0.05, 0.2)),
                 "top": _bin(max(count.values()) / n, (0.1, 0.2, 0.4)), "size": _bin(n, (5, 20, 100, 1000))}
        low = Counter()
        for t, c in count.items():
            low[t.lower()] += c
        idx = np.fromiter((self.hash[t.encode("utf-8", "surrogatepass")] for t in low), np.uint64, len(low)) % np.uint64(DIMS)
        val = np.log1p(np.fromiter(low.values(), float, len(low)))
        val /= np.sqrt((val * val).sum())
        own = np.array([self.hash[f"#{k}={v}".encode()] % DIMS for k, v in shape.items()], np.uint64)
        return np.concatenate([idx, own]).astype(np.int64), np.concatenate([val, np.full(len(own), 0.5)])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one less than the grades

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j (columns) at linear scores ``x``."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -700, 700)))


def train(rows: Sequence[tuple[str, int]], grades: int, l2: float = 2e-5, steps: int = 250, rate: float = 0.3) -> OrdinalModel:
    """Maximum likelihood by Adam on a bounded sample of (text, grade). Without rows every grade is equally likely."""
    start = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
    if not rows:
        return OrdinalModel(np.zeros(DIMS), start)
    feats = Features()
    x = [feats(t) for t, _ in rows]
    y = np.array([g for _, g in rows])
    doc = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    idx, val = np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])
    used, idx = np.unique(idx, return_inverse=True)
    share = (np.bincount(y, minlength=grades) + 1) / (len(y) + grades)
    cum = np.cumsum(share)[:-1]
    base = np.log(cum / (1 - cum))
    # thresholds: the first, and the logarithms of the steps to the next ones
    par = np.concatenate([np.zeros(len(used)), [base[0]], np.log(np.maximum(np.diff(base), 1e-3))])
    m1, m2 = np.zeros(len(par)), np.zeros(len(par))
    k, nw = grades - 1, len(used)
    one = np.arange(len(y))
    for step in range(1, steps + 1):
        gaps = np.exp(par[nw + 1 :])
        t = par[nw] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(doc, par[idx] * val, len(x))
        f = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -50, 50)))  # P(grade <= j)
        hi = np.where(y < k, f[one, np.minimum(y, k - 1)], 1.0)
        lo = np.where(y > 0, f[one, np.maximum(y - 1, 0)], 0.0)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gs = (dhi - dlo) / len(y)  # of the loss by s
        gt = np.bincount(np.minimum(y, k - 1), np.where(y < k, -dhi, 0), k) + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dlo, 0), k)
        gt /= len(y)
        g = np.concatenate([np.bincount(idx, gs[doc] * val, nw) + l2 * par[:nw], [gt.sum()], [gt[i + 1 :].sum() * gaps[i] for i in range(k - 1)]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        par -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
    w = np.zeros(DIMS)
    w[used] = par[:nw]
    return OrdinalModel(w, par[nw] + np.concatenate([[0.0], np.cumsum(np.exp(par[nw + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 good but toxic, 2 good. A null ``toxic`` counts as 0; rows without quality are left out."""
    good = F.col("quality").cast("int")
    return labels.where(good.isin(0, 1)).select("doc_id", F.when(good == 0, 0).when(F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 1, 1).otherwise(2).alias("grade"))


def grade(docs: DataFrame, model: OrdinalModel, at_least: int = 1, cut: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_good`` (probability of grade ``at_least`` or better) and ``selected`` (p_good >= cut).

    Columns of ``docs`` named like the new ones are replaced. A null or empty text has a feature of its own. Rows are judged by
    themselves: repeated rows get equal grades.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats, m = Features(), sent.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            s = np.empty(batch.num_rows)
            for i, t in enumerate(text):
                idx, val = feats(t.as_py())
                s[i] = m.weights[idx] @ val
            tail = m.tails(s)
            p = tail[:, at_least - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail.sum(axis=1)), pa.array(p), pa.array(p >= cut)], names=[*batch.schema.names, "expected_grade", "p_good", "selected"])

    own = docs.drop("expected_grade", "p_good", "selected")
    schema = T.StructType([*own.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("selected", T.BooleanType())])
    return own.mapInArrow(run, schema)
