"""Many literal patterns against whole texts: Aho–Corasick automata past which texts stream in Arrow batches.

Patterns are dealt to shards of about ``SHARD_CHARS`` characters. A shard is the only thing that is broadcast, so its size is
bounded whatever the list holds; a worker keeps the automaton of the shard that it used last. Every text passes every shard
once; texts are never shuffled. Null and empty texts hold no pattern; null and empty patterns occur nowhere.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.session import cut_lineage

SHARD_CHARS = 2_000_000
ROWS_OUT = 50_000
_LAST: dict[str, tuple] = {}


def shards(patterns: DataFrame, pattern: str, value: str, chars: int = SHARD_CHARS) -> list[Broadcast]:
    """Broadcast lists of (pattern, value), each of about ``chars`` characters; equal patterns keep their smallest value."""
    p = cut_lineage(patterns.select(F.col(pattern).alias("p"), F.col(value).alias("v")).where("p <> '' AND v IS NOT NULL")
                    .groupBy("p").agg(F.min("v").alias("v")))
    total = p.agg(F.sum(F.length("p") + F.length("v"))).first()[0] or 0
    n = -(-total // chars)
    sc = patterns.sparkSession.sparkContext
    shard = F.pmod(F.xxhash64("p"), F.lit(max(n, 1)))
    lists = ([(r["p"], r["v"]) for r in p.where(shard == i).collect()] for i in range(n))
    return [sc.broadcast(x) for x in lists if x]


def _automaton(name: str, shard: Broadcast) -> ahocorasick.Automaton:
    """The shard's automaton, its words carrying (length, value); built once for a worker."""
    if name not in _LAST:
        a = ahocorasick.Automaton()
        for p, v in shard.value:
            a.add_word(p, (len(p), v))
        a.make_automaton()
        _LAST.clear()
        _LAST[name] = a
    return _LAST[name]


def occurring(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, chars: int = SHARD_CHARS) -> DataFrame:
    """Distinct (``key``, ``pattern``) pairs where the pattern occurs in the text, exactly.

    The scan carries digests of patterns only; they are joined back by an equi-join on the pairs that were found.
    """
    p = patterns.select(F.col(pattern).alias("_p")).where("_p <> ''").distinct().withColumn("_h", F.md5("_p"))
    t = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    kind = t.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("_h", T.StringType())])

    def finder(shard: Broadcast, name: str):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(keys, at, found):
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=["key", "_h"])

            for b in batches:
                a = _automaton(name, shard)
                keys, at, found = b.column(0), [], []
                for i, s in enumerate(b.column(1)):
                    new = {v for _, (_, v) in a.iter(s.as_py())}
                    at += [i] * len(new)
                    found += new
                    if len(at) >= ROWS_OUT:
                        yield rows(keys, at, found)
                        at, found = [], []
                yield rows(keys, at, found)
        return find

    out = texts.sparkSession.createDataFrame([], schema)
    for shard in shards(p, "_p", "_h", chars):
        out = out.union(t.mapInArrow(finder(shard, uuid.uuid4().hex), schema))
    return out.distinct().join(p, "_h").select(F.col("key").alias(key), F.col("_p").alias(pattern))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _spliced(s: str, spans: list[tuple[int, int, str]]) -> str:
    """``s`` with spans replaced, the leftmost first and of these the longest; spans that overlap a replaced one are left."""
    out, done = [], 0
    for start, end, new in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= done:
            out += [s[done:start], new]
            done = end
    return "".join(out) + s[done:]


def replaced(df: DataFrame, text: str, mapping: DataFrame, token: str, real: str, pattern: str | None = None, chars: int = SHARD_CHARS) -> DataFrame:
    """``df`` with the mapped tokens in ``text`` replaced, row by row: no shuffle, other columns untouched.

    With ``pattern`` (a Python regular expression) a token is replaced where it is a whole match of the pattern; the automaton
    finds the texts that hold a mapped token at all, only these are matched. Without it, tokens are replaced wherever no word
    character touches them, the leftmost and longest first. Tokens mapped twice take the smallest name. With several shards the
    places found are carried from pass to pass, and the text is rewritten in the last.
    """
    rx = re.compile(pattern) if pattern else None
    spans = f"_spans_{uuid.uuid4().hex}"
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("new", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
    at = df.columns.index(text)
    parts = shards(mapping, token, real, chars)

    def places(s: str, a: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
        if rx is not None:
            if next(a.iter(s), None) is None:
                return []
            return [(m.start(), m.end(), a.get(m[0])[1]) for m in rx.finditer(s) if m[0] and a.exists(m[0])]
        got = ((e - n + 1, e + 1, v) for e, (n, v) in a.iter(s))
        return [x for x in got if not (x[0] and _word(s[x[0] - 1])) and not (x[1] < len(s) and _word(s[x[1]]))]

    def passing(shard: Broadcast, name: str, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a = _automaton(name, shard)
                new, found = [], []
                for i, x in enumerate(b.column(at)):
                    s = x.as_py()
                    was = [] if first else [(y["start"], y["end"], y["new"]) for y in b.column(b.num_columns - 1)[i].as_py()]
                    got = was + (places(s, a) if s else [])
                    new.append(_spliced(s, got) if last and got else s)
                    found.append([] if last else [dict(zip(("start", "end", "new"), y)) for y in got])
                cols = list(b.columns) if first else list(b.columns)[:-1]
                names = b.schema.names if first else b.schema.names[:-1]
                cols[at] = pa.array(new, pa.string())
                if not last:
                    cols, names = [*cols, pa.array(found, arrow)], [*names, spans]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        return run

    x = df
    for i, shard in enumerate(parts):
        last = i == len(parts) - 1
        schema = df.schema if last else T.StructType([*df.schema.fields, T.StructField(spans, kind)])
        x = x.mapInArrow(passing(shard, uuid.uuid4().hex, i == 0, last), schema)
        x = x if last else cut_lineage(x)
    return x
