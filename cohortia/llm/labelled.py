"""Bounded samples of labelled documents for classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer documents are left out of training samples, so that a sample's size in bytes is bounded; they are scored like any other.
MAX_CHARS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_label: int, values: list[int]) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows_per_label`` documents for each label value, the first in the order of a hash of doc_id.

    Only this many ids are chosen first and looked up in the documents, so no text is shuffled.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where("doc_id is not null").where(F.col("_y").isin(values))
    # the text's length is not known yet: spare ids make up for documents that are too long
    ids = None
    for v in values:
        part = own.where(F.col("_y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label + rows_per_label // 4)
        ids = part if ids is None else ids.union(part)
    ids = ids.dropDuplicates(["doc_id"])
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.length("text") <= MAX_CHARS) & (F.length("text") > 0))
    got = text.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "_y").orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()
    out, n = [], dict.fromkeys(values, 0)
    for r in got:
        if n[r["_y"]] < rows_per_label:
            n[r["_y"]] += 1
            out.append((r["text"], r["_y"]))
    return out
