"""Reference look-ups and target triage: actionability, flattening, census shaping, dependency funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.operators.aggregates import distinct_samples, joined_names, universe
from cohortia.operators.reshape import best_row
from cohortia.operators.stats import cohens_d
from cohortia.session import broadcast_if_small, cut_lineage

# fixed values: clinical stage names and their number
STAGE_NUMBER = {"PHASE_1": 1, "PHASE_1_2": 1, "PHASE_2": 2, "PHASE_2_3": 2, "PHASE_3": 3, "APPROVAL": 4}
# fixed values: tractability labels that count as approved, and as clinical
APPROVED_LABEL = "Approved Drug"
CLINICAL_LABELS = ["Approved Drug", "Advanced Clinical", "Phase 1 Clinical"]


def batch_actionability(genes: DataFrame, tract: DataFrame, drugs: DataFrame) -> DataFrame:
    """One row per gene: approved/clinical drug flags, tractability by small molecule and antibody, drug counts."""
    is_true = F.col("value")
    t = tract.groupBy("gene_symbol").agg(
        F.bool_or("has_approved_drug").alias("has_approved_drug"), F.bool_or("has_clinical_drug").alias("has_clinical_drug"),
        F.bool_or((F.col("modality") == "SM") & is_true).alias("tractable_sm"), F.bool_or((F.col("modality") == "AB") & is_true).alias("tractable_ab"))
    d = drugs.groupBy("gene_symbol").agg(F.count_if("is_approved").alias("n_approved_drugs"), F.count_if(F.col("max_phase_num") >= 3).alias("n_clinical_drugs"))
    out = genes.select("gene_symbol").join(t, "gene_symbol", "left").join(d, "gene_symbol", "left")
    return out.na.fill(False, ["has_approved_drug", "has_clinical_drug", "tractable_sm", "tractable_ab"]).na.fill(
        0, ["n_approved_drugs", "n_clinical_drugs"])


def actionability(genes: DataFrame, tract: DataFrame, drugs: DataFrame) -> DataFrame:
    """Full summary per gene: flags with fall-back to the drug table, first true bucket per modality, drug lists by phase.

    Drugs are reduced to one row per (gene, drug) before they are collected, so a list is as long as the drug list.
    """
    g = genes.select("gene_symbol").distinct()
    t = tract.join(g, "gene_symbol", "left_semi")
    ok = F.col("value")

    def bucket(m):
        return F.min(F.when((F.col("modality") == m) & ok, F.struct("bucket_ix", "bucket_label")))["bucket_label"]
    ts = t.groupBy("gene_symbol").agg(F.bool_or("has_approved_drug").alias("_ta"), F.bool_or("has_clinical_drug").alias("_tc"),
                                      bucket("SM").alias("top_sm_bucket"), bucket("AB").alias("top_ab_bucket"))
    d = drugs.join(g, "gene_symbol", "left_semi").groupBy("gene_symbol", "drug_name").agg(
        F.max("max_phase_num").alias("phase"), F.bool_or("is_approved").alias("approved"))
    rec = F.struct((-F.col("phase")).alias("k"), F.col("drug_name"))
    ds = d.groupBy("gene_symbol").agg(
        F.bool_or("approved").alias("_da"), (F.max("phase") >= 3).alias("_dc"),
        F.array_sort(F.collect_list(F.when(F.col("approved"), rec))).alias("_la"),
        F.array_sort(F.collect_list(F.when(F.col("phase") >= 3, rec))).alias("_lc"))
    out = g.join(ts, "gene_symbol", "left").join(ds, "gene_symbol", "left")

    def drug_names(c):
        return F.coalesce(F.transform(c, lambda x: x["drug_name"]), F.array().cast("array<string>"))
    no = F.lit(False)
    return out.select(
        "gene_symbol", F.coalesce("_ta", "_da", no).alias("has_approved_drug"), F.coalesce("_tc", "_dc", no).alias("has_clinical_drug"),
        F.col("top_sm_bucket").isNotNull().alias("tractable_sm"), F.col("top_ab_bucket").isNotNull().alias("tractable_ab"),
        "top_sm_bucket", "top_ab_bucket", F.array_join(drug_names("_la"), "; ").alias("approved_drugs"), F.array_join(drug_names("_lc"), "; ").alias("clinical_drugs"),
        (F.col("_ta").isNotNull() | F.col("_da").isNotNull()).alias("found"))


def tractability_flags(buckets: DataFrame) -> DataFrame:
    """buckets(gene_symbol, modality, label, value, ...) -> the same rows as buckets with gene-level flags.

    The flags are one partially aggregated row per gene that is joined back, so a gene's buckets are never held together.
    """
    hit = F.col("value")
    flags = cut_lineage(buckets.groupBy(F.col("gene_symbol").alias("_g")).agg(
        F.bool_or(hit & (F.col("label") == APPROVED_LABEL)).alias("has_approved_drug"),
        F.bool_or(hit & F.col("label").isin(CLINICAL_LABELS)).alias("has_clinical_drug")))
    j = buckets.join(broadcast_if_small(flags), F.col("gene_symbol").eqNullSafe(F.col("_g")))
    return j.select("gene_symbol", "modality", F.col("label").alias("bucket_label"), "value",
                    *[c for c in buckets.columns if c not in ("gene_symbol", "modality", "label", "value")], "has_approved_drug", "has_clinical_drug")


def flatten_tractability(targets: DataFrame) -> DataFrame:
    """targets(gene_symbol, tractability array<struct<modality,label,value>>) -> one row per bucket with gene-level flags."""
    x = targets.select("gene_symbol", F.posexplode("tractability").alias("bucket_ix", "t"))
    return tractability_flags(x.select("gene_symbol", "t.modality", "t.label", "t.value", "bucket_ix"))


def drug_rows(rows: DataFrame) -> DataFrame:
    """rows(gene_symbol, drug_id, drug_name, stage, diseases array<struct<id,name>>) -> one row per row x disease.

    Rows without a disease keep blanks; a disease repeated within a row is kept once, which its own array decides.
    """
    stage = F.create_map(*[F.lit(x) for kv in STAGE_NUMBER.items() for x in kv])

    def disease_key(z):
        name = F.coalesce(z["id"], F.lit(""))
        return F.when(name != "", name).otherwise(F.coalesce(z["name"], F.lit("")))
    keys = F.transform("diseases", disease_key)
    once = F.filter("diseases", lambda z, i: F.array_position(keys, disease_key(z)) == i + 1)
    x = rows.select("gene_symbol", "drug_id", "drug_name", F.col("stage").alias("max_phase_str"), F.explode_outer(once).alias("dz"))
    return x.select("gene_symbol", "drug_id", "drug_name", "max_phase_str", F.coalesce(F.try_element_at(stage, F.col("max_phase_str")), F.lit(0)).alias("max_phase_num"),
                    (F.col("max_phase_str") == "APPROVAL").alias("is_approved"), F.coalesce("dz.id", F.lit("")).alias("disease_id"), F.coalesce("dz.name", F.lit("")).alias("disease_name"))


def flatten_drugs(targets: DataFrame) -> DataFrame:
    """targets(gene_symbol, rows array<struct<drug_id,drug_name,stage,diseases array<struct<id,name>>>>) -> one row per
    gene x drug x disease; rows without a disease keep blanks; a disease repeated within a row is kept once."""
    return drug_rows(targets.select("gene_symbol", F.explode("rows").alias("r")).select("gene_symbol", "r.*"))


def census_genes(raw: DataFrame) -> DataFrame:
    """(gene, cgc_tier, role_in_cancer, somatic): tier coerced, yes/no text to boolean, genes without a name drop."""
    return raw.where("gene IS NOT NULL").select("gene", F.expr("try_cast(tier AS TINYINT)").alias("cgc_tier"), F.col("role").alias("role_in_cancer"),
                                               (F.lower(F.trim("somatic")) == "y").alias("somatic"))


def hallmarks(raw: DataFrame) -> DataFrame:
    return joined_names(raw.where("gene IS NOT NULL AND hallmark IS NOT NULL AND trim(hallmark) <> 'function summary'"), ["gene"], "hallmark", "hallmarks")


def fusions(raw: DataFrame) -> DataFrame:
    """Distinct samples and fusion types per gene pair."""
    ok = raw.where("gene_5prime IS NOT NULL AND gene_3prime IS NOT NULL")
    keys = ["gene_5prime", "gene_3prime"]
    return distinct_samples(ok, keys).join(joined_names(ok.where("fusion_type IS NOT NULL"), keys, "fusion_type", "fusion_types"), keys, "left")


def mutation_frequency(raw: DataFrame) -> DataFrame:
    return distinct_samples(raw.where("gene IS NOT NULL"), ["gene"])


def proteomics_matrix(rows: DataFrame, data_cols: Sequence[str], model: DataFrame, suffix: str = r"_TenPx\d+$") -> DataFrame:
    """Protein rows -> (sample_id, feature, value): peptide-count columns dropped, most complete row per gene, run suffix
    stripped, line names translated with fall-back to the name itself."""
    cols = [c for c in data_cols if not c.endswith("_Peptides")]
    valid = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in cols), F.lit(0))
    x = rows.withColumn("gene", F.trim("gene")).where("gene IS NOT NULL").withColumn("_n", valid)
    one = best_row(x.select("gene", "row_id", "_n", *cols), ["gene"], [-F.col("_n"), F.col("row_id")])
    long = one.select("gene", *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot("gene", cols, "line", "value")
    long = long.withColumn("line", F.regexp_replace("line", suffix, ""))
    j = long.join(model.select(F.col("name").alias("line"), "model_id"), "line", "left")
    return j.select(F.coalesce("model_id", "line").alias("sample_id"), F.col("gene").alias("feature"), "value")


def namespace(sources: dict[str, DataFrame], seed: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Put every source table under one anonymous gene id."""
    from cohortia.operators.blinding import anonymise_genes
    return anonymise_genes(sources, seed, col="gene")


def dependency_contrast(dependency: DataFrame, lines: DataFrame) -> DataFrame:
    """Per gene: mean dependency in target lines and elsewhere, and their difference. dependency(sample_id, gene, value), lines(sample_id, target)."""
    j = dependency.join(lines, "sample_id")
    t = F.when(F.col("target"), F.col("value"))
    o = F.when(~F.col("target"), F.col("value"))
    return j.groupBy("gene").agg(F.avg(t).alias("mean_target"), F.avg(o).alias("mean_other"), (F.avg(t) - F.avg(o)).alias("selectivity"))


def target_funnel(contrast: DataFrame, normal: DataFrame, tolerance: DataFrame, max_dependency: float, max_selectivity: float,
                  max_normal: float, min_tolerance: float) -> DataFrame:
    """Per gene, the stages it passes: dependency -> selectivity -> normal tissue -> tolerability. Thresholds are the caller's."""
    n = normal.groupBy("gene").agg(F.max("value").alias("max_normal"))
    j = contrast.join(n, "gene", "left").join(tolerance, "gene", "left")
    s1 = F.col("mean_target") <= max_dependency
    s2 = s1 & (F.col("selectivity") <= max_selectivity)
    s3 = s2 & (F.coalesce("max_normal", F.lit(0.0)) <= max_normal)
    s4 = s3 & (F.coalesce("tolerance", F.lit(0.0)) >= min_tolerance)
    return j.select("gene", "mean_target", "selectivity", "max_normal", "tolerance",
                    (s1.cast("int") + s2.cast("int") + s3.cast("int") + s4.cast("int")).alias("stage"))


def funnel_counts(funnel: DataFrame) -> DataFrame:
    return funnel.agg(F.count(F.lit(1)).alias("genes"), *[F.count_if(F.col("stage") >= i).alias(n) for i, n in enumerate(
        ("dependent", "selective", "spares_normal", "tolerable"), 1)])


def biomarker_dependency(dependency: DataFrame, marker: DataFrame, patient_events: DataFrame, n_patients: int | Column) -> DataFrame:
    """Per gene: effect size of dependency in marker-positive against negative lines, with the marker's patient frequency."""
    j = dependency.join(marker, "sample_id")
    d = cohens_d(j, ["gene"], "value", F.col("positive"))
    n = n_patients if isinstance(n_patients, Column) else F.lit(n_patients)
    f = patient_events.select("sample_id", "gene").distinct().groupBy("gene").agg((F.count(F.lit(1)) / n).alias("patient_frequency"))
    return d.join(f, "gene", "left").na.fill({"patient_frequency": 0.0})


def attach_response(response: DataFrame, samples: DataFrame) -> DataFrame:
    """Drug response restricted to the cohort's samples."""
    return response.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
