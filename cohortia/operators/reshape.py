"""Projections, filters, reshaping and normalisation of long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortia.session import broadcast_if_small, cut_lineage, distinct_values


def melt(wide: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, feature: str = "feature",
         value: str = "value") -> DataFrame:
    """Wide -> long. NaN becomes null once, here at the edge."""
    cols = list(columns) if columns else [c for c in wide.columns if c not in ids]
    w = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    long = w.unpivot(list(ids), cols, feature, value)
    return long.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def pivot(long: DataFrame, ids: Sequence[str], feature: str, value: str, agg: str = "max", limit: int = 4000) -> DataFrame:
    """Long -> wide for small outputs; the column list is read first and refused beyond ``limit``."""
    names = distinct_values(long, feature, limit)
    return long.groupBy(*ids).pivot(feature, names).agg(getattr(F, agg)(value))


def cpm_log2(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """log2(counts per million + 1) with the library size of each sample."""
    size = counts.groupBy(*by, "sample_id").agg(F.sum("value").alias("_lib"))
    return counts.join(size, [*by, "sample_id"]).withColumn(
        "value", F.log2(F.col("value") / F.nullif("_lib", F.lit(0.0)) * 1e6 + 1)).drop("_lib")


def log_transform(df: DataFrame, base: str, value: str = "value") -> DataFrame:
    """log(v + 1) in the stated base ('e', '2' or '10'); bases are never mixed silently."""
    fn = {"e": F.log1p(value), "2": F.log2(F.col(value) + 1), "10": F.log10(F.col(value) + 1)}[base]
    return df.withColumn(value, fn)


def restrict(expr: DataFrame, genes: DataFrame, feature: str = "feature") -> DataFrame:
    """Keep the features of a reference list."""
    return expr.join(genes.select(feature).distinct(), feature, "left_semi")


def top_variable(expr: DataFrame, n: int, by_variance: bool = False) -> DataFrame:
    """Restrict to the n features with the largest sd (ties by name)."""
    top = top_variable_features(expr, n, by_variance)
    return expr.join(top.select("feature"), "feature", "left_semi")


def top_variable_features(expr: DataFrame, n: int, by_variance: bool = False) -> DataFrame:
    s = expr.groupBy("feature").agg((F.var_samp if by_variance else F.stddev)("value").alias("spread"))
    return s.orderBy(F.col("spread").desc_nulls_last(), "feature").limit(n)


def rename_by_map(df: DataFrame, mapping: DataFrame, col: str, real: str, anon: str, drop_unmapped: bool = False) -> DataFrame:
    """Replace ids through a mapping table; unmapped ids are kept or dropped."""
    m = mapping.select(F.col(real).alias(col), F.col(anon).alias("_anon"))
    j = df.join(m, col, "inner" if drop_unmapped else "left")
    return j.withColumn(col, F.coalesce("_anon", F.col(col).cast("string"))).drop("_anon").select(*df.columns)


def remap_categories(df: DataFrame, col: str, prefix: str = "CAT_", out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace values by prefix + position in sorted distinct order. Returns (table, value map)."""
    v = df.select(col).where(F.col(col).isNotNull()).distinct()
    # the categories of one clinical column; ordering them is a sort of distinct values only
    codes = cut_lineage(v.withColumn("code", F.concat(F.lit(prefix), (F.dense_rank().over(W.orderBy(col)) - 1).cast("string"))))
    new = df.join(broadcast_if_small(codes), col, "left").withColumn(out or col, F.col("code")).drop("code")
    return new.select(*[c for c in df.columns], *([out] if out and out not in df.columns else [])), codes


def functional_variants(maf: DataFrame, classes: Sequence[str], min_vaf: float | None = None) -> DataFrame:
    """Variants of functional classes with an allele fraction of at least ``min_vaf`` (text is coerced, bad text drops)."""
    out = maf.where(F.col("variant_class").isin(list(classes)))
    if min_vaf is not None:
        out = out.withColumn("vaf", F.expr("try_cast(vaf AS DOUBLE)")).where(F.col("vaf") >= min_vaf)
    return out


# fixed values: symbols that spreadsheets turn into dates, and their repair
DATE_SYMBOLS = {"2020-03-02 00:00:00": "MARCH2", "2020-09-01 00:00:00": "SEPT1", "2020-09-02 00:00:00": "SEPT2",
                "2020-09-10 00:00:00": "SEPT10"}
# fixed values: artefact gene families (anchored patterns) and non-gene prefixes
ARTEFACT_PATTERNS = ["^DUX", "^OR[0-9]"]
NON_GENE_PREFIXES = ["LOC", "hsa-"]


def clean_symbols(df: DataFrame, col: str, repairs: dict[str, str] | None = None, artefacts: Sequence[str] = tuple(ARTEFACT_PATTERNS),
                  prefixes: Sequence[str] = tuple(NON_GENE_PREFIXES)) -> DataFrame:
    """Repair mangled symbols, then drop artefact families and non-gene entries."""
    m = DATE_SYMBOLS if repairs is None else repairs
    fixed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(col)), F.col(col)) if m else F.col(col)
    out = df.withColumn(col, fixed)
    for p in artefacts:
        out = out.where(~F.col(col).rlike(p))
    for p in prefixes:
        out = out.where(~F.col(col).startswith(p))
    return out


def first_prefix(col: str, rules: Sequence[tuple[str, str]], exact: dict[str, str] | None = None, default: str | None = None) -> Column:
    """Label from ordered prefix rules (first match wins), then exact names, then a default."""
    c = F
    for prefix, label in rules:
        c = c.when(F.col(col).startswith(prefix), label)
    for name, label in (exact or {}).items():
        c = c.when(F.col(col) == name, label)
    return c.otherwise(F.lit(default) if default is not None else F.col(col))


def split_cohort_label(df: DataFrame, col: str, aliases: dict[str, str] | None = None, sep: str = r"\.") -> DataFrame:
    """COHORT.subtype -> (cohort, subtype); rows without a subtype or with NA drop; cohort aliases apply; rows distinct."""
    parts = F.split(F.col(col), sep, 2)
    out = df.withColumn("cohort", F.try_element_at(parts, F.lit(1))).withColumn("subtype", F.try_element_at(parts, F.lit(2)))
    out = out.where("subtype IS NOT NULL AND subtype <> 'NA' AND subtype <> ''")
    return (out.replace(aliases, subset=["cohort"]) if aliases else out).drop(col).dropDuplicates()


def impute_mean(expr: DataFrame) -> DataFrame:
    """Replace null values by the feature mean."""
    m = expr.groupBy("feature").agg(F.avg("value").alias("_m"))
    return expr.join(m, "feature").withColumn("value", F.coalesce("value", "_m")).drop("_m")


# fixed values: ordinal coding of protein staining levels, and the reliability classes that count
LEVEL_CODES = {"Not detected": 0, "Low": 1, "Medium": 2, "High": 3}
RELIABLE = ["Enhanced", "Supported", "Approved"]


def encode_levels(df: DataFrame, codes: dict[str, int] | None = None, reliable: Sequence[str] = tuple(RELIABLE)) -> DataFrame:
    """(gene, tissue, cell_type, level, reliability) -> max ordinal code per (gene, tissue__cell_type); unknown text is -1."""
    codes = codes or LEVEL_CODES
    m = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return (df.where(F.col("reliability").isin(list(reliable)))
            .groupBy("gene", F.concat_ws("__", "tissue", "cell_type").alias("site"))
            .agg(F.max(F.coalesce(F.try_element_at(m, F.col("level")), F.lit(-1))).alias("code")))


def cohort_columns(long: DataFrame, cohort: DataFrame, width: int = 12) -> DataFrame:
    """Rows whose id, cut to ``width`` characters, is in the cohort; samples null in every feature drop."""
    x = long.withColumn("sample_id", F.substring("sample_id", 1, width))
    kept = x.join(cohort.select(F.col("sample_id")).distinct(), "sample_id", "left_semi")
    alive = kept.where("value IS NOT NULL").select("sample_id").distinct()
    return kept.join(alive, "sample_id", "left_semi")


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def best_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest by ``order``. An aggregation with map-side combine, not a sort per key."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def most_complete(long: DataFrame, key: str, variant: str) -> DataFrame:
    """For keys that come in several variants, keep the variant with the most non-null values (ties: first name)."""
    n = long.groupBy(key, variant).agg(F.count("value").alias("_n"))
    best = n.groupBy(key).agg(F.min_by(variant, F.struct(-F.col("_n"), F.col(variant))).alias(variant))
    return long.join(best, [key, variant], "left_semi")


def top_k_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. Spark limits each task to k rows per key before the shuffle (window group limit)."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def top_blocks(df: DataFrame, stat: Column, key: str, n: int, block: int) -> DataFrame:
    """Top n rows by a statistic with their position and consecutive block number (n is small: it is a report)."""
    t = df.withColumn("_s", stat).orderBy(F.col("_s").desc_nulls_last(), key).limit(n)
    rn = F.row_number().over(W.orderBy(F.col("_s").desc_nulls_last(), key))
    return t.withColumn("position", rn).withColumn("block", F.floor((F.col("position") - 1) / block)).drop("_s")
