"""A corpus pipeline of five stages over ``documents``; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import decontam, linededup, minhash, mixing, quality
from cohortia.llm.common import table
from cohortia.llm.queries import MIX_BUDGET, domains, quality_model
from cohortia.session import cut_lineage

#: The first stage leaves no poor documents, so the mixture has shares of the others alone.
MIX_KEPT = {"good": 0.95, "toxic": 0.05}

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a probability of one half or more."""
    model = quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.grade(docs.select(COLUMNS), model).where("selected").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    out = linededup.dedup_lines(docs.select(COLUMNS))
    # a document that loses nothing stays as it is, a null text too
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, a null one only where there is no other.

    Rows are told apart by numbers of their own, since a doc_id may be null or repeat.
    """
    rows = cut_lineage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id", F.xxhash64("text").alias("th")), "_row")
    groups = cut_lineage(groups)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "_row")).alias("m")).select("m._row")
    gone = groups.join(first, "_row", "left_anti").select("_row")
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), nulls=True)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, with the number of copies that meets the target shares."""
    return mixing.mix(docs.select(COLUMNS), domains(table(spark, sf_dir, "labels")), MIX_KEPT, MIX_BUDGET)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing_to_targets)]

#: Two stages are trained classifiers, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
