"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import LOWER, UPPER

_FOLD = str.maketrans(UPPER, LOWER)

#: Both classes have the same subdomains, so that these tell nothing.
_SUB = ("", "www.", "blog.", "m.")

#: A small labelled table (url, 1 to block), from which the model is trained where the caller has none.
LABELLED_URLS = [
    *[(f"https://{s}{h}.example.{t}/{p}", 1) for h, t, p in [
        ("cheap-pills", "com", "en/12"), ("spam-farm", "org", "en/7"), ("cheap-watches", "net", "fr/80"), ("casino-bonus", "com", "de/4"),
        ("free-money", "net", "es/9"), ("pills-online", "org", "en/301"), ("spam-links", "com", "fr/22"), ("win-casino", "net", "en/640"),
        ("farm-of-links", "com", "es/71"), ("adult-cams", "net", "en/18"), ("cheap-loans", "com", "en/550"), ("replica-bags", "org", "de/93"),
        ("sports-bets", "org", "fr/55"), ("adult-chat", "com", "es/37")] for s in _SUB],
    *[(f"http://{s}{h}.example.{t}/{p}", 0) for h, t, p in [
        ("ththre", "com", "fr/825"), ("therha", "net", "en/676"), ("tiontion", "com", "en/853"), ("ththan", "net", "en/960"), ("tionsh", "org", "es/533"),
        ("thertion", "com", "es/978"), ("ththly", "net", "en/777"), ("thernd", "org", "de/612"), ("library", "org", "en/3"), ("museum", "net", "fr/45"),
        ("university", "com", "en/201"), ("weather", "net", "de/66")] for s in _SUB],
]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or a URL without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :])
    return m[1].translate(_FOLD), m[2]


class Rules:
    """The rule that fits a host or one of its parent domains, and begins the path; the longest one."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: -len(r.text)):
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
                    best = r
            at = host.find(".", at) + 1
            if not at:
                return best


def features(host: str, path: str, dims: int, sizes: Sequence[int]) -> np.ndarray:
    """Distinct hashed character n-grams of the host and of the path, kept apart by a leading mark."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            out.update(xxhash.xxh3_64_intdigest((mark + s[i : i + n]).encode("utf-8", "surrogatepass")) % dims for i in range(max(1, len(s) - n + 1)))
    return np.fromiter(out, np.int64, len(out))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)

    def score(self, host: str, path: str) -> float:
        """Probability that the URL should be blocked. Features are scaled by the root of their number."""
        x = features(host, path, len(self.weights), self.sizes)
        return 1 / (1 + np.exp(-(self.bias + self.weights[x].sum() / np.sqrt(len(x)))))


def train(rows: Sequence[tuple[str, int]], dims: int = 1 << 15, l2: float = 1e-3, steps: int = 500, rate: float = 2.0) -> UrlModel:
    """Logistic regression by gradient descent on the labelled table; the classes weigh the same. ``rows`` is small by contract."""
    model = UrlModel(np.zeros(dims), 0.0)
    x = [features(*parts(u), dims, model.sizes) for u, _ in rows]
    y = np.array([v for _, v in rows], float)
    doc, idx = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)
    val = 1 / np.sqrt(np.repeat([len(v) for v in x], [len(v) for v in x]))
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(doc, model.weights[idx] * val, len(x)) + model.bias)))
        g = cost * (p - y)
        model.weights -= rate * (np.bincount(idx, g[doc] * val, dims) + l2 * model.weights)
        model.bias -= rate * g.sum()
    return model


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages`` (page_id, url; further columns are ignored).

    A rule fits its host and all subdomains, where the path starts with the rule's path; the longest rule wins and sets the verdict.
    Where none fits the model does: block at a score of 0.5 or more. A null url, or one without ``://``, has empty parts and is judged
    by the model on these. Rows are judged by themselves: repeated rows and null ids change nothing, and nothing is shuffled.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast((Rules(rules), model))  # the size of the parameters, whatever the table holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_set, m = sent.value
        for batch in batches:
            rows = []
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = parts(url)
                r, score = rule_set.find(host, path), float(m.score(host, path))
                rows.append((page, host, path, r and r.text, r.verdict if r else ("block" if score >= 0.5 else "allow"), score))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
