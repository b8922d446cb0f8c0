"""Phrase collocations by SON partitioning.

The rows of the corpus are dealt into ``SHARDS`` shards (the parts that the table is read in, modulo SHARDS). A phrase with a support of
``support`` or more in the corpus has support / SHARDS or more in one shard at least, whatever the shards hold. So

1. every shard is mined completely at that lowered support: words, pairs, then phrases of three and four words whose pairs are
   frequent in some shard;
2. the locally frequent phrases are united. A phrase that is frequent in k shards with c occurrences there has less than
   c + (SHARDS - k) * lowered support in all; where that is too little it isn't a candidate;
3. all candidates are counted globally, exactly, by their text.

Mining and candidates go by 64-bit hashes in bit maps of a fixed size: a collision makes a needless candidate, which the exact
count drops. Tasks count what they hold before it is shuffled, so a phrase costs a row per task, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortia.llm.common import mix, stream
from cohortia.session import broadcast_if_small, cut_lineage

#: Shards that are mined for themselves.
SHARDS = 8

#: Words (and ends of pieces) that a task counts at once.
CHUNK = 3_000_000

#: Bits of a bit map of phrases, as a power of two: 2^27 are 16 MB. More phrases than bits only make more needless candidates.
MAP_BITS = 27

_ENDS = ".,;:!?\n\x0b\x0c\r"  # characters that end a piece
#: A-Z to lower case, ends of pieces to line feeds, tabs to blanks.
_TABLE = bytes(10 if chr(c) in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Key of documents without a language.
UNKNOWN = "und"


class _Words(dict):
    """Numbers of words in the order in which they come, with their hashes; 0 is the end of a piece, 1 is nothing."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})
        self.text: list[bytes] = [b"\n", b""]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.text)
        self.text.append(word)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.text), np.uint64, len(self.text))


class _Chunk:
    """Word numbers of many texts one after the other, with an end of a piece after each, and their languages."""

    def __init__(self):
        self.words, self.ids, self.langs, self.size = _Words(), [], [], 0

    def add(self, text: str, lang: str) -> None:
        words = text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        self.ids.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.langs.append(lang)
        self.size += len(words)

    def done(self) -> None:
        """``a`` word numbers and ``lang`` the number of each one's language, without empty words."""
        self.names = sorted(set(self.langs))
        number = {x: k for k, x in enumerate(self.names)}
        self.a = np.concatenate(self.ids)
        self.lang = np.repeat(np.array([number[x] for x in self.langs], np.int32), [len(x) for x in self.ids])
        self.ids = []
        full = self.a != 1
        self.a, self.lang = self.a[full], self.lang[full]

    def keys(self) -> np.ndarray:
        """A hash of each word in its language."""
        seeds = np.array([xxhash.xxh3_64_intdigest(b"lang " + x.encode()) for x in self.names], np.uint64)
        return mix(self.words.hashes()[self.a] ^ seeds[self.lang])


def phrase_keys(word_keys: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of ``n`` words."""
    many = max(0, len(word_keys) - n + 1)
    h = np.zeros(many, np.uint64)
    for i in range(n):
        h = mix(h + word_keys[i : many + i] + stream(i + 8 * n))
    return h


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_map(keys: DataFrame) -> np.ndarray:
    """The bit map of a column of keys (long): at most 2^(MAP_BITS - 6) numbers come to the driver, however many keys there are."""
    at = F.shiftrightunsigned("key", 64 - MAP_BITS)
    part = keys.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    got = part.toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Chunk, int]]:
    """Chunks of (text, lang, shard) rows with their shard; a longer text is a chunk by itself."""
    chunk, shard = _Chunk(), 0
    for batch in batches:
        for text, lang, s in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            shard = s.as_py()
            chunk.add(text.as_py(), lang.as_py())
            if chunk.size >= CHUNK:
                chunk.done()
                yield chunk, shard
                chunk = _Chunk()
    if chunk.size:
        chunk.done()
        yield chunk, shard


def _rows(docs: DataFrame) -> DataFrame:
    lang, text = F.coalesce("lang", F.lit(UNKNOWN)), F.coalesce("text", F.lit(""))
    return docs.select(text.alias("text"), lang.alias("lang"), F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word), f: how often each word stands in the texts of a language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches):
            for k, name in enumerate(chunk.names):
                n = np.bincount(chunk.a[chunk.lang == k], minlength=2)
                n[0] = 0
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array([chunk.words.text[i] for i in at], pa.binary()), pa.array(n[at])], schema=schema)

    out = _rows(docs).mapInArrow(run, "lang string, phrase binary, f long")
    return out.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def mined(docs: DataFrame, lengths: tuple[int, ...], frequent: np.ndarray, part: int, support: int) -> DataFrame:
    """key: hashes of the phrases of ``lengths`` words that can have ``support``, found shard by shard.

    ``frequent`` is the bit map of the phrases of ``part`` words that can; a phrase counts where all of its own are there.
    """
    bits = docs.sparkSession.sparkContext.broadcast(frequent)
    lowered = -(-support // SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, shard in _chunks(batches):
            good = _valid(chunk, bits.value, part)
            keys = chunk.keys()
            for n in lengths:
                here = _windows(good, n - part + 1)
                k, many = np.unique(phrase_keys(keys, n)[here], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard, np.int32)), pa.array(k.view(np.int64)), pa.array(many.astype(np.int32))], names=["shard", "key", "n"])

    local = _rows(docs).mapInArrow(run, "shard int, key long, n int").groupBy("shard", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= lowered)
    united = local.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return united.where(F.col("n") + (F.lit(SHARDS) - F.col("k")) * (lowered - 1) >= support).select("key")


def _windows(good: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` places from each one on are good."""
    out = good
    for i in range(1, n):
        out = out[:-1] & good[i:] if len(out) else out
    return out


def _valid(chunk: _Chunk, frequent: np.ndarray, n: int) -> np.ndarray:
    """Whether a frequent phrase of ``n`` words of one piece starts at each place."""
    own = _windows(chunk.a != 0, n)
    out = np.zeros(len(own), bool)
    at = np.flatnonzero(own)
    out[at] = _inside(frequent, phrase_keys(chunk.keys(), n)[at])
    return out


def _exact(docs: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """lang, phrase, f: how often each candidate of two words or more stands in the corpus; told apart by word numbers, not by hashes."""
    bits = docs.sparkSession.sparkContext.broadcast(maps)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches):
            a, text, width = chunk.a.astype(np.int64), chunk.words.text, len(chunk.words.text)
            for n in sorted(bits.value):
                at = np.flatnonzero(_valid(chunk, bits.value[n], n))
                if not len(at):
                    continue
                # a number for each different phrase, one more word at a time
                number = chunk.lang[at].astype(np.int64)
                for i in range(n):
                    number = np.unique(number * width + a[at + i], return_inverse=True)[1]
                many = np.bincount(number)
                first = np.empty(len(many), np.int64)
                first[number[::-1]] = at[::-1]
                words = [[text[x] for x in a[first + i].tolist()] for i in range(n)]
                phrases = pa.array(list(map(b" ".join, zip(*words, strict=True))), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(chunk.names).take(pa.array(chunk.lang[first])), phrases, pa.array(many)], schema=schema)

    out = _rows(docs).mapInArrow(run, "lang string, phrase binary, f long")
    return out.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f of all phrases of one to four words with ``support`` or more; lang, n of all words)."""
    words = cut_lineage(word_counts(docs))
    often = words.where(F.col("f") >= support)
    pairs = bit_map(cut_lineage(mined(docs, (2,), bit_map(_keys_of_words(often)), 1, support)))
    longer = bit_map(cut_lineage(mined(docs, (3, 4), pairs, 2, support)))
    counted = _exact(docs, {2: pairs, 3: longer, 4: longer}).where(F.col("f") >= support)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return cut_lineage(often.union(counted)), cut_lineage(total)


def _keys_of_words(words: DataFrame) -> DataFrame:
    """The keys that ``phrase_keys`` gives single words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds: dict[str, int] = {}
            h = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in batch.column(1).to_pylist()], np.uint64)
            s = np.array([seeds.setdefault(x, xxhash.xxh3_64_intdigest(b"lang " + x.encode())) for x in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(phrase_keys(mix(h ^ s), 1).view(np.int64))], names=["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key long")


def _whole(x: str) -> Column:
    """Wide enough for a product of a count and a constant."""
    return F.col(x).cast("decimal(20,0)")


def collocations(docs: DataFrame, support: int = 30, cover: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, n, score, covered for every phrase of two to four words with ``support`` or more occurrences.

    Texts (``text``, ``lang``; further columns are ignored) are lower-cased in A-Z and cut into pieces at . , ; : ! ? and at line feed,
    vertical tab, form feed and return, pieces into words at blanks and tabs. Occurrences lie within a piece and may overlap. Cut
    after its first k words, a phrase with a occurrences, whose parts have l and r, has the score floor(2000000 a / (l + r)); the cut with the
    lowest score counts, of equal ones that with the smallest k. ``covered`` marks phrases that lie in a longer one of these
    phrases with 100 f(longer) >= ``cover`` a. ``n`` counts all words of the language.

    A null text is empty, a null language is ``und``. Repeated rows are texts by themselves. An empty table gives an empty result.
    """
    phrases, total = frequent_phrases(docs, support)
    own = phrases.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    found = own.where("m > 1")

    def words(start: Column, many: Column) -> Column:
        return F.array_join(F.slice("w", start, many), " ")

    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("left"), words(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r)")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    # the parts of a longer phrase: those of two words or more, without itself
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda j: F.transform(F.sequence(F.lit(1), F.col("m") - j + 1), lambda i: words(i, j))))
    parts = found.where("m > 2").select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    out = lowest.join(most, ["lang", "phrase"], "left").join(broadcast_if_small(total, 10_000), "lang")
    covered = F.coalesce(_whole("longer") * 100 >= _whole("a") * cover, F.lit(False))
    return out.select("lang", "phrase", "a", "l", "r", "n", "score", covered.alias("covered"))


def top(found: DataFrame, k: int = 2000, spread: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``k`` phrases that aren't covered: by score and a descending, then phrase.

    The first ``k`` of each of ``spread`` parts of a language are found on their own, so the last step has k * spread rows of it at most.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = found.where(~F.col("covered")).withColumn("_part", F.pmod(F.hash("phrase"), F.lit(spread)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
