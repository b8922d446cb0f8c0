"""Blinding, labelling, splitting and perturbation of cohort tables. All draws use the portable md5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.aggregates import universe
from cohortia.operators.ordered import draw_key, draw_order, quantile_bins, running
from cohortia.operators.reshape import remap_categories, rename_by_map
from cohortia.session import broadcast_if_small, cut_lineage, distinct_values, spread

# fixed values: columns that reveal disease, tissue, subtype or demographics and never reach the analyst
ALWAYS_STRIP = [
    "OncotreePrimaryDisease", "OncotreeLineage", "OncotreeSubtype", "OncotreeCode", "PrimaryOrMetastasis",
    "SampleCollectionSite", "lineage", "lineage_subtype", "cancer_type", "tissue_type", "BRCA1_mut", "BRCA2_mut",
    "TP53_mut", "KRAS_mut", "paper_BRCA_Subtype_PAM50", "molecular_subtype", "subtype", "icluster", "auc", "ic50",
    "lfc", "primary_diagnosis", "morphology", "site_of_resection_or_biopsy", "tissue_or_organ_of_origin", "pathology",
    "hrd_score", "tmb", "race", "ethnicity", "gender", "sex",
]
# fixed values: columns that keep their name while their values are recoded
VALUE_REMAP = ["tumor_stage"]


def padded(c: Column, prefix: str, width: int) -> Column:
    """prefix + number padded to at least ``width`` digits (longer numbers are not cut)."""
    s = c.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def anonymise_samples(views: dict[str, DataFrame], cohort: DataFrame, seed: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rename sample ids in every view through one map; rows of samples outside the cohort drop."""
    m = cut_lineage(_numbered(cohort, "sample_id", "SAMPLE_", 4, seed))
    return {n: rename_by_map(v, m, "sample_id", "sample_id", "anon", drop_unmapped=True) for n, v in views.items()}, m


def anonymise_genes(views: dict[str, DataFrame], seed: int, col: str = "feature") -> tuple[dict[str, DataFrame], DataFrame]:
    """Rename genes in every view through one map over the union of all views."""
    m = cut_lineage(_numbered(universe([v.select(F.col(col).alias("gene")) for v in views.values()]).withColumnRenamed("gene", col), col, "GENE_", 5, seed))
    return {n: rename_by_map(v, m, col, col, "anon", drop_unmapped=True) for n, v in views.items()}, m


def _numbered(ids: DataFrame, col: str, prefix: str, width: int, seed: int) -> DataFrame:
    o = draw_order(ids.select(col).where(F.col(col).isNotNull()).distinct(), [], seed, [col])
    return o.select(col, padded(F.col("rn") - 1, prefix, width).alias("anon"))


def mask_clinical(meta: DataFrame, rename: dict[str, bool] | None = None, strip: Sequence[str] = tuple(ALWAYS_STRIP),
                  remap: Sequence[str] = tuple(VALUE_REMAP), rename_clinical: bool = True) -> tuple[DataFrame, DataFrame]:
    """Strip leaky columns; rename others to CLIN_xx (alphabetical) and recode their values; recode in place others.

    ``rename`` maps column -> whether its text values are recoded too. Returns (table, codebook(anon, real_name, code, value)).
    """
    spark = meta.sparkSession
    out = meta.drop(*[c for c in strip if c in meta.columns])
    book = None
    if rename_clinical:
        types = dict(out.dtypes)
        for i, c in enumerate(sorted(x for x in (rename or {}) if x in types)):
            anon = f"CLIN_{i:02d}"
            rows = spark.range(1).select(F.lit(anon).alias("anon"), F.lit(c).alias("real_name"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("value"))
            if rename[c] and types[c] == "string":
                out, codes = remap_categories(out, c)
                rows = codes.select(F.lit(anon).alias("anon"), F.lit(c).alias("real_name"), "code", F.col(c).cast("string").alias("value"))
            out = out.withColumnRenamed(c, anon)
            book = rows if book is None else book.unionByName(rows)
        for c in remap:
            if types.get(c) == "string":
                out, _ = remap_categories(out, c)
    if book is None:
        book = spark.createDataFrame([], "anon string, real_name string, code string, value string")
    return out, book


def frequent_category_labels(meta: DataFrame, col: str, n_groups: int, seed: int, min_size: int = 30) -> DataFrame:
    """(sample_id, label): Context_A.. for ``n_groups`` categories drawn among those with enough samples."""
    ok = meta.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    chosen = draw_order(ok.select(col), [], seed, [col]).where(F.col("rn") <= n_groups)
    letters = F.array(*[F.lit(f"Context_{chr(65 + i)}") for i in range(n_groups)])
    return meta.join(chosen, col).select("sample_id", F.element_at(letters, F.col("rn").cast("int")).alias("label"))


def mutation_labels(samples: DataFrame, events: DataFrame, gene: str, min_mutated: int = 20) -> DataFrame:
    """(sample_id, label): mutant or wild type for one gene; empty when too few samples are mutated."""
    hit = events.where(F.col("gene") == gene).select("sample_id").distinct().withColumn("_m", F.lit(1))
    enough = hit.agg((F.count(F.lit(1)) >= min_mutated).alias("_ok"))
    j = samples.select("sample_id").distinct().join(hit, "sample_id", "left").join(F.broadcast(enough), on=F.lit(True))
    return j.where("_ok").select("sample_id", F.when(F.col("_m") == 1, "Context_Mutant").otherwise("Context_WT").alias("label"))


def response_labels(response: DataFrame, drug: str | None = None) -> DataFrame:
    """(sample_id, drug, label): response tertiles of one drug, by default the one with the most complete data."""
    ok = response.where("value IS NOT NULL")
    if drug is None:
        n = ok.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
        best = n.agg(F.min_by("feature", F.struct(-F.col("_n"), F.col("feature"))).alias("feature"))
        ok = ok.join(F.broadcast(best), "feature")
    else:
        ok = ok.where(F.col("feature") == drug)
    b = quantile_bins(cut_lineage(ok), ["feature"], "value", 3)
    names = F.array(F.lit("Context_Sensitive"), F.lit("Context_Intermediate"), F.lit("Context_Resistant"))
    return b.select("sample_id", F.col("feature").alias("drug"), F.element_at(names, F.col("bin") + 1).alias("label"))


def sealed_split(labels: DataFrame, seed: int, fraction: float = 0.2) -> DataFrame:
    """(sample_id, label, sealed): labels recoded to Context_A.. in sorted order, a fixed share of samples sealed."""
    names = distinct_values(labels, "label", 26)
    code = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, f"Context_{chr(65 + i)}")])
    o = draw_order(labels.select("sample_id", "label"), [], seed, ["sample_id"])
    n = o.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(fraction) + F.lit(1e-9))).alias("_k"))
    return o.join(F.broadcast(n), on=F.lit(True)).select(
        "sample_id", F.element_at(code, F.col("label")).alias("label"), (F.col("rn") <= F.col("_k")).alias("sealed"))


def decoy_codebook(samples: DataFrame, prefix: str = "SAMPLE_", width: int = 4) -> DataFrame:
    """(sample_id, decoy): numbers in sorted id order."""
    x = samples.select("sample_id").distinct().withColumn("_one", F.lit(1))
    # range-partitioned by id and stored with the partition number: any id type, balanced, fixed once written
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = cut_lineage(x.repartitionByRange(n, "sample_id").withColumn("_b", F.spark_partition_id()))
    r = running(x, [], ["sample_id"], {"_rn": ("sum", "_one")})
    return r.select("sample_id", padded(F.col("_rn") - 1, prefix, width).alias("decoy"))


def swap_between_groups(values: DataFrame, grp: DataFrame, a: str, b: str, seed: int, cols: Sequence[str]) -> DataFrame:
    """Give every sample of group a a value tuple of group b and the reverse, round robin over shuffled tuples.

    Recipients keep their own order, donors are shuffled, and sample i gets donor i modulo the donor group's size.
    Samples outside both groups keep their values.
    """
    j = cut_lineage(values.join(grp.where(F.col("label").isin(a, b)), "sample_id", "left"))
    two = j.where("label IS NOT NULL")
    size = two.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    rec = cut_lineage(draw_order(two.select("label", "sample_id"), ["label"], seed, ["sample_id"], "_i"))
    don = draw_order(two.select("label", "sample_id", *cols), ["label"], seed + 1, ["sample_id"], "_d")
    other = F.when(F.col("label") == a, b).otherwise(a)
    r = rec.withColumn("_from", other).join(F.broadcast(size.select(F.col("label").alias("_from"), "_size")), "_from")
    r = r.select("sample_id", "_from", (((F.col("_i") - 1) % F.col("_size")) + 1).alias("_d"))
    got = r.join(don.select(F.col("label").alias("_from"), "_d", *cols), ["_from", "_d"]).select("sample_id", *cols)
    rest = j.where("label IS NULL").select("sample_id", *cols)
    return got.union(rest)


def swap_check(before: DataFrame, after: DataFrame, grp: DataFrame, col: str) -> DataFrame:
    """Group means before and after a swap, side by side."""
    t = before.select("sample_id", F.col(col).alias("v"), F.lit("before").alias("w")).union(after.select("sample_id", F.col(col), F.lit("after")))
    return t.join(grp, "sample_id").groupBy("label").agg(
        F.avg(F.when(F.col("w") == "before", F.col("v"))).alias("mean_before"), F.avg(F.when(F.col("w") == "after", F.col("v"))).alias("mean_after"))


def random_partitions(samples: DataFrame, reps: int, seed: int, k_choices: Sequence[int] = (2, 3, 4), min_size: int = 8) -> DataFrame:
    """(rep, sample_id, label): near-equal random groups per replicate, k drawn per replicate among the choices that keep
    every group at ``min_size`` (k = 2 if none does)."""
    s = samples.select("sample_id").distinct()
    n = s.count()
    ks = [k for k in k_choices if n // k >= min_size] or [2]
    r = s.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    o = draw_order(r, ["rep"], seed, ["sample_id"])
    h = F.conv(F.substring(draw_key(seed, F.lit("k"), "rep"), 1, 8), 16, 10).cast("long")
    k = F.element_at(F.array(*[F.lit(x) for x in ks]), (h % len(ks) + 1).cast("int"))
    return o.withColumn("_k", k).select("rep", "sample_id", F.concat(F.lit("Cluster_"), ((F.col("rn") - 1) % F.col("_k")).cast("string")).alias("label"))


def random_gene_sets(genes: DataFrame, reps: int, seed: int, size: int) -> DataFrame:
    """(rep, gene): a random set of fixed size per replicate."""
    g = genes.select("gene").distinct()
    r = g.select("gene", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return draw_order(r, ["rep"], seed, ["gene"]).where(F.col("rn") <= size).select("rep", "gene")


def cna_from_peaks(calls: DataFrame, peak_genes: DataFrame, additions: DataFrame | None = None) -> DataFrame:
    """(sample_id, gene, call) from peak calls and per-peak gene lists. Amplification (+1) wins over deletion (-1).

    calls(sample_id, peak, kind, level), peak_genes(kind, peak, gene); ``additions`` has the shape of ``peak_genes`` and
    lets a peak lend its calls to further genes. Neutral pairs are absent (complete the grid only on request).
    A sample's calls are brought together before they are expanded to genes, so what is shuffled is calls, not genes.
    """
    pg = peak_genes if additions is None else peak_genes.unionByName(additions)
    pg = cut_lineage(pg.select("kind", "peak", "gene").distinct())
    ev = cut_lineage(calls.where(F.col("level") > 0).select("sample_id", "peak", "kind").distinct())
    width = pg.groupBy("kind", "peak").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.avg("n"), F.lit(1.0))).first()[0]
    ev = spread(ev, ["sample_id"], int(ev.count() * width)).join(broadcast_if_small(pg), ["kind", "peak"])
    return ev.groupBy("sample_id", "gene").agg(F.when(F.max(F.col("kind") == "amp"), 1).otherwise(-1).alias("call"))
