"""Document fingerprints: threshold-scaled sketches of word shingles, built from DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. The fraction is the same for all documents, so
the sketch of a long document is long, the union of two sketches is the sketch of the joined sets, and the share of the
smaller sketch found in the larger estimates containment without bias however unequal the documents are. The smallest
hash is kept in any case, so that no text has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortia.llm.common import SPACE, let, shuffle_partitions
from cohortia.operators.ordered import with_bucket
from cohortia.session import cut_lineage

#: Shingle hashes are cut to this many bits, ten hexadecimal digits.
BITS = 40


def sketch(text: Column, fraction: float = 0.25, words: int = 5) -> Column:
    """Sorted hashes of the text's sketch. ``words - 1`` markers stand before and after the words, so that every text has
    shingles, a short one too, and the empty text has those of the markers alone."""
    edge = F.array(*[F.lit("\x00")] * (words - 1))
    found = F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != "")
    mask = F.lit((1 << BITS) - 1)
    hashes = let(F.concat(edge, found, edge), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - (words - 1)), lambda i: F.xxhash64(F.slice(p, i, words)).bitwiseAND(mask)))
    small = let(hashes, lambda hs: let(F.array_min(hs), lambda least: F.filter(hs, lambda h: (h < int(fraction * (1 << BITS))) | (h == least))))
    return F.array_sort(F.array_distinct(small))


def fingerprint(sk: Column) -> Column:
    """The sketch as a string: ten hexadecimal digits for each hash."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller set that lies in the other: 1 for equal texts."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)).cast("double")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two sets together."""
    return F.array_sort(F.array_union(a, b))


def _down(order: str) -> list[Column]:
    return [F.col(order).desc_nulls_last(), F.xxhash64("text")]


def with_next(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``docs`` with ``next``: a struct of the whole following row in descending ``order``; after the last comes the first. The rows
    come dealt by ``_range`` and in order.

    The rows are dealt once, into equi-depth ranges of ``order``, and each range is ordered by itself. A range's last row takes
    the first row of the next range that has rows from a table with one row for each range. Ties are ordered by the hash of their
    text, nulls come last.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    edges = docs.select(F.col(order).cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.25 / n)
    ranged = with_bucket(docs, order, sorted({e for e in edges if e is not None}), "_range")
    # the largest come first, nulls last
    ranged = ranged.withColumn("_range", F.when(F.col(order).isNull(), F.lit(n)).otherwise(n - 1 - F.col("_range")).cast("int"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    down = _down(order)
    w = W.partitionBy("_range").orderBy(*down)
    dealt = ranged.repartition(shuffle_partitions(spark), "_range").sortWithinPartitions("_range", *down)
    led = dealt.withColumn("_own", row).withColumn("next", F.lead("_own").over(w)).drop("_own")
    # the first row of every range: found by key, so that only these rows' texts are read again
    keys = ranged.select("_range", F.col(order).alias("_o"), F.xxhash64("text").alias("_h"))
    top = keys.groupBy("_range").agg(F.min(F.struct(F.when(F.col("_o").isNull(), 1).otherwise(0).alias("null"), (-F.col("_o")).alias("o"), "_h")).alias("k"))
    top = top.select("_range", (-F.col("k.o")).alias("_o"), F.col("k._h").alias("_h"))
    first = ranged.withColumn("_h", F.xxhash64("text")).alias("r").join(
        F.broadcast(top.alias("t")), (F.col("r._range") == F.col("t._range")) & F.col(f"r.{order}").eqNullSafe(F.col("t._o")) & (F.col("r._h") == F.col("t._h")))
    first = first.select(F.col("r._range").alias("_range"), row.alias("_row")).dropDuplicates(["_range"])
    first = cut_lineage(first)
    order_of = [r[0] for r in first.select("_range").collect()]  # one number for each range
    if not order_of:
        return led
    order_of.sort()
    after = dict(zip(order_of, [*order_of[1:], order_of[0]], strict=True))
    follow = F.create_map(*[F.lit(x) for kv in after.items() for x in kv])
    heads = first.select(F.col("_range").alias("_at"), "_row")
    out = led.withColumn("_to", F.when(F.col("next").isNull(), F.element_at(follow, F.col("_range"))))
    out = out.join(F.broadcast(heads), F.col("_to") == F.col("_at"), "left")
    return out.select(*docs.columns, "_range", F.coalesce("next", "_row").alias("next"))


def fingerprints(docs: DataFrame, fraction: float = 0.25, words: int = 5) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): the fingerprint of its text, of an edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in
    descending doc_id; the next of the last is the first, and a lone document follows itself. A null text counts as empty. Rows
    with a null doc_id come last. Repeated rows follow one another. Further columns of ``docs`` are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own).select("doc_id", "text", "_range", F.col("next.text").alias("after"))
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("after", F.lit(1), k))
    made = both.select("doc_id", "_range", "text", "after", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.select("doc_id", "_range", "text", "after", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[sketch(F.col(c), fraction, words).alias(f"s_{c}") for c in ("text", "edited")])
    # the next document's sketch is the next row's; only the last row of a range has to make it
    led = F.lead("s_text").over(W.partitionBy("_range").orderBy(*_down("doc_id")))
    made = made.withColumn("s_after", F.coalesce(led, sketch(F.col("after"), fraction, words)))
    return made.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s_text")).alias("fingerprint"), fingerprint(F.col("s_edited")).alias("edited_fingerprint"),
                       containment(F.col("s_text"), F.col("s_edited")).alias("near_edited"), containment(F.col("s_text"), F.col("s_after")).alias("near_next"))
