"""Rubric scoring: component scores over screens, weighted totals, null calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.text import matched_names
from cohortia.operators import stats
from cohortia.operators.blinding import random_gene_sets, random_partitions
from cohortia.operators.cluster import bootstrap_stability, pca_scores, sample_vectors, silhouette
from cohortia.operators.reshape import clip01
from cohortia.operators.survival import (concordance, directions, extreme_log_hr, hr_vs_worst, logrank,
                                         loo_direction_match)
from cohortia.session import cut_lineage


def driver_enrichment(events: DataFrame, grp: DataFrame, drivers: DataFrame, full_at: int = 5) -> DataFrame:
    """Number of significant driver x group associations (BH over genes x groups), over ``full_at``."""
    t = stats.fisher_enrichment(events.join(drivers, "gene", "left_semi"), grp)
    sig = F.count(F.when(F.col("fdr") < 0.05, 1))
    return t.agg(F.countDistinct("gene").alias("n_drivers_tested"), sig.alias("n_significant"),
                 F.least(sig / float(full_at), F.lit(1.0)).alias("score"))


def metric_battery(wide: DataFrame, pairs: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Spearman over a table of metric pairs with the expected sign; one stacked pass over the metrics."""
    stacked = wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric_pair"), F.col(x).alias("x"), F.col(y).alias("y")) for n, x, y, _ in pairs])))
    sign = F.create_map(*[F.lit(v) for n, _, _, s in pairs for v in (n, s)])
    rho = stats.spearman(stacked, ["metric_pair"], "x", "y")
    return rho.withColumn("expected", F.element_at(sign, F.col("metric_pair"))).withColumn(
        "as_expected", F.signum("rho") == F.col("expected"))


# fixed values: component weights of the two rubrics
WEIGHTS = {"structure_validity": 2.0, "clinical_signal": 3.0, "genomic_coherence_drivers": 2.0, "reference_concordance": 2.0,
           "marker_evidence": 2.0, "pathway_validity": 1.0, "mechanism_grounding": 2.0}
GATED = ["mechanism_grounding", "pathway_validity"]
DISCOVERY_WEIGHTS = {"structure_validity": 2.0, "survival_stratification": 3.0, "provenance_integrity": 3.0, "pathway_validity": 1.0,
                     "mechanistic_grounding": 3.0, "cross_modal_support": 2.0, "validation_experiment": 2.0}
EXAMINATION_WEIGHTS = {"exam_data_lock_quality": 1.0, "exam_mechanistic_integration": 2.0}
VALIDATION_WEIGHTS = {"target_coexpr_replication": 2.0, "target_survival_replication": 3.0}
# fixed values: points per support level, weight per decision, and the support level each kind of recall implies
SUPPORT_POINTS = {"grounded": 1.0, "unsupported": 0.25, "anchored": 0.0}
DECISION_WEIGHTS = {"d1_partition": 2.0, "d2_identity": 2.0, "d3_mechanism": 1.0}
RECALL_SUPPORT = {"grounded_recall": "grounded", "derived": "grounded", "wrong_disease": "anchored",
                  "bare_assertion": "unsupported", "no_identification": "unsupported"}


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def weighted_total(components: DataFrame, gate: DataFrame | None = None, weights: dict[str, float] = WEIGHTS,
                   gated: Sequence[str] = tuple(GATED)) -> DataFrame:
    """Weighted sum per episode over the maximum; an episode that committed to the wrong identity loses the narrative parts.

    components(episode, component, raw), gate(episode, fooled).
    """
    g = gate.select("episode", "fooled") if gate is not None else components.select("episode").distinct().withColumn("fooled", F.lit(False))
    x = components.join(g, "episode", "left").withColumn("fooled", F.coalesce("fooled", F.lit(False)))
    keep = F.when(F.col("fooled") & F.col("component").isin(list(gated)), 0.0).otherwise(1.0)
    total = F.sum(F.col("raw") * F.coalesce(_lookup(weights, F.col("component")), F.lit(0.0)) * keep)
    return x.groupBy("episode").agg(total.alias("total"), (total / sum(weights.values())).alias("normalised"), F.bool_or("fooled").alias("gated"))


def phase_composite(components: DataFrame) -> DataFrame:
    """Three phases: total, internal norm (phases 1 + 2), external norm (phase 3), geometric-mean composite.

    A phase without any component does not enter the maximum.
    """
    def phase(w):
        c = _lookup(w, F.col("component"))
        return F.coalesce(F.sum(F.col("raw") * c), F.lit(0.0)), F.count(c) > 0, float(sum(w.values()))
    p1, _, m1 = phase(DISCOVERY_WEIGHTS)
    p2, h2, m2 = phase(EXAMINATION_WEIGHTS)
    p3, h3, m3 = phase(VALIDATION_WEIGHTS)
    a = components.groupBy("episode").agg((p1 + p2 + p3).alias("total"), ((p1 + p2) / (m1 + F.when(h2, m2).otherwise(0.0))).alias("internal_norm"),
                                          F.when(h3, p3 / m3).otherwise(0.0).alias("external_norm"))
    i, e = F.col("internal_norm"), F.col("external_norm")
    return a.withColumn("composite", F.when((i > 0) & (e > 0), F.sqrt(i * e)).otherwise(0.0))


def support_score(levels: DataFrame) -> DataFrame:
    """Support score and consistency flags per episode. levels(episode, decision, support, contradiction[, recall_type])."""
    s, c, dn = F.col("support"), F.col("contradiction"), F.col("decision")
    flag = F.when((s == "grounded") & (c == "ignored"), F.concat(dn, F.lit(": grounded+ignored"))).when(
        (s == "anchored") & (c == "none"), F.concat(dn, F.lit(": anchored+none")))
    recall = F.lit(None).cast("string")
    if "recall_type" in levels.columns:
        want = _lookup(RECALL_SUPPORT, F.col("recall_type"))
        recall = F.when((dn == "d2_identity") & (want != s), F.concat(F.lit("d2_identity: recall_type="), F.col("recall_type"), F.lit(" expects "), want))
    pts = F.coalesce(_lookup(SUPPORT_POINTS, s), F.lit(0.0)) * F.coalesce(_lookup(DECISION_WEIGHTS, dn), F.lit(0.0))
    return levels.groupBy("episode").agg(F.sum(pts).alias("score"), F.array_sort(F.concat(F.collect_list(flag), F.collect_list(recall))).alias("flags"))


# ---- component scores ---------------------------------------------------------------------------------------------
# Each returns one row with its parts, ``score`` in [0, 1] and ``status`` (ok / no_data), the reason being a size guard.

def _guarded(df: DataFrame, enough: Column) -> DataFrame:
    return df.withColumn("score", F.when(enough, F.col("score")).otherwise(0.0)).withColumn(
        "status", F.when(enough, F.lit("ok")).otherwise(F.lit("no_data")))


def _one(*frames: DataFrame) -> DataFrame:
    """Put one-row tables side by side; a missing row leaves nulls."""
    return reduce(lambda a, b: a.join(F.broadcast(b), on=F.lit(True), how="left"), frames)


def structure_validity(expr: DataFrame, grp: DataFrame, reps: int = 100, dims: int = 50, seed: int = 42) -> DataFrame:
    """Half clipped silhouette of the labels on principal components, half mean bootstrap ARI."""
    vec = cut_lineage(sample_vectors(expr.join(grp.select("sample_id"), "sample_id", "left_semi"), scale=False))
    sc, _ = pca_scores(vec, dims)
    sc = cut_lineage(sc)
    sil = silhouette(sc.join(grp, "sample_id"))
    ari = bootstrap_stability(sc, grp, reps, seed).agg(F.avg("ari").alias("bootstrap_ari"), F.count(F.lit(1)).alias("n_bootstrap"))
    k = grp.agg(F.countDistinct("label").alias("n_groups"))
    j = _one(sil, ari, k).withColumn("score", 0.5 * clip01(F.col("silhouette")) + 0.5 * clip01(F.coalesce("bootstrap_ari", F.lit(0.0))))
    return _guarded(j, (F.col("n") >= 20) & (F.col("n_groups") >= 2))


def _surv_counts(s: DataFrame) -> DataFrame:
    return s.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event"), F.lit(0)).alias("n_events"), F.countDistinct("label").alias("n_groups"))


def clinical_signal(surv: DataFrame, grp: DataFrame) -> DataFrame:
    """0.6 x concordance above chance (0.3 counts full) + 0.4 x |log HR| of the extreme groups (2 counts full)."""
    s = cut_lineage(surv.join(grp, "sample_id"))
    dc = clip01((F.col("folded") - 0.5) / 0.3)
    hr = clip01(F.coalesce("log_hr", F.lit(0.0)) / 2.0)
    j = _one(_surv_counts(s), concordance(s).select("c_index", "folded"), extreme_log_hr(s).where("status = 'ok'").select("log_hr"))
    return _guarded(j.withColumn("score", 0.6 * dc + 0.4 * hr), (F.col("n") >= 20) & (F.col("n_events") >= 5) & (F.col("n_groups") >= 2))


def survival_stratification(surv: DataFrame, grp: DataFrame) -> DataFrame:
    """Half log-rank (p = 1e-4 counts full), half hazard ratio against the worst group (4 counts full)."""
    s = cut_lineage(surv.join(grp, "sample_id"))
    lr = clip01(-F.log10(F.greatest("p", F.lit(1e-12))) / 4.0)
    hr = clip01(F.log(F.coalesce("hr_vs_worst", F.lit(1.0))) / F.log(F.lit(4.0)))
    j = _one(_surv_counts(s), logrank(s).select("chi2", "df", "p"), hr_vs_worst(s))
    return _guarded(j.withColumn("score", 0.5 * lr + 0.5 * hr), (F.col("n") >= 20) & (F.col("n_events") >= 5) & (F.col("n_groups") >= 2))


def gene_evidence(expr: DataFrame, grp: DataFrame, surv: DataFrame, genes: DataFrame, meth: DataFrame | None = None, cna: DataFrame | None = None) -> DataFrame:
    """One row per submitted gene: nominal and genome-wide evidence by modality. The shared table behind both gene scores.

    Expression families cover every gene of the matrix; methylation and copy number are tested for submitted genes only.
    """
    expr = cut_lineage(expr)
    de = stats.bh_fdr(stats.anova(expr, grp).select("feature", "p"), []).select("feature", F.col("p").alias("de_p"), F.col("fdr").alias("de_fdr"))
    sv = stats.bh_fdr(stats.survival_spearman(expr, surv).select("feature", "p"), []).select("feature", F.col("p").alias("surv_p"), F.col("fdr").alias("surv_fdr"))
    known = expr.select("feature").distinct().withColumn("valid", F.lit(True))
    out = genes.select("feature").distinct().join(known, "feature", "left").join(de, "feature", "left").join(sv, "feature", "left")
    none = F.lit(False)
    if meth is not None:
        m = stats.methylation_evidence(expr, meth, genes).select(F.col("gene").alias("feature"), F.col("passed").alias("methylation"))
        out = out.join(m, "feature", "left")
    if cna is not None:
        c = stats.cna_enrichment(cna, grp).select(F.col("gene").alias("feature"), F.col("passed").alias("cna"))
        out = out.join(c.join(genes, "feature", "left_semi"), "feature", "left")
    return out.select("feature", F.coalesce("valid", none).alias("valid"), "de_p", "de_fdr", "surv_p", "surv_fdr",
                      (F.coalesce("methylation", none) if meth is not None else none).alias("methylation"), (F.coalesce("cna", none) if cna is not None else none).alias("cna"))


def provenance_integrity(evidence: DataFrame) -> DataFrame:
    """Share of submitted genes that pass at least two of: differential at FDR < 0.05, survival at FDR < 0.05, another modality."""
    n = F.coalesce((F.col("de_fdr") < 0.05).cast("int"), F.lit(0)) + F.coalesce((F.col("surv_fdr") < 0.05).cast("int"), F.lit(0)) + (F.col("methylation") | F.col("cna")).cast("int")
    ok = F.col("valid") & (n >= 2)
    return evidence.agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("valid").alias("n_valid"), F.count_if(ok).alias("n_passing"), F.avg(ok.cast("double")).alias("score"))


def cross_modal_support(evidence: DataFrame) -> DataFrame:
    """Share of submitted genes with nominal expression evidence and evidence of another modality."""
    rna = F.coalesce(F.col("de_p") < 0.05, F.lit(False)) | F.coalesce(F.col("surv_p") < 0.05, F.lit(False))
    ok = F.col("valid") & rna & (F.col("methylation") | F.col("cna"))
    return evidence.agg(F.count(F.lit(1)).alias("n_genes"), F.count_if(ok).alias("n_with_both"), F.avg(ok.cast("double")).alias("score"))


def marker_evidence(expr: DataFrame, grp: DataFrame, genes: DataFrame, drivers: DataFrame) -> DataFrame:
    """0.4 validity + 0.4 mean folded one-vs-rest AUC above chance + 0.2 overlap with known drivers. genes(feature, position):
    the AUC part uses the first 15 valid genes of the submitted order, as the rubric defines."""
    known = expr.select("feature").distinct()
    g = cut_lineage(genes.join(known.withColumn("_v", F.lit(1)), "feature", "left"))
    valid = g.where("_v = 1")
    first = valid.orderBy("position").limit(15).select("feature")
    auc = stats.auc_one_vs_rest(expr.join(first, "feature", "left_semi"), grp).groupBy("feature").agg(F.avg("folded_auc").alias("a")).agg(F.avg("a").alias("mean_auc"))
    ov = valid.join(drivers.select(F.col("gene").alias("feature")).distinct().withColumn("_d", F.lit(1.0)), "feature", "left").agg(
        F.coalesce(F.avg(F.coalesce("_d", F.lit(0.0))), F.lit(0.0)).alias("driver_overlap"))
    v = g.agg(F.avg(F.coalesce(F.col("_v"), F.lit(0)).cast("double")).alias("validity"))
    part = clip01((F.coalesce("mean_auc", F.lit(0.5)) - 0.5) * 2)
    return _one(v, auc, ov).withColumn("score", 0.4 * F.col("validity") + 0.4 * part + 0.2 * F.col("driver_overlap"))


def pathway_validity(pathways: DataFrame, genes: DataFrame, sets: DataFrame, universe: int = 20000) -> DataFrame:
    """0.6 share of submitted names found in the catalogue + 0.4 share of found sets enriched in the submitted genes.

    pathways(name), genes(gene), sets(set_name, gene). Only matched sets are tested.
    """
    hit = cut_lineage(matched_names(pathways, sets))
    ora = stats.over_representation(genes, sets.join(hit.select("set_name"), "set_name", "left_semi"), universe)
    e = hit.join(ora.select("set_name", "k", "p"), "set_name", "left").agg(F.count(F.lit(1)).alias("n_valid"), F.count_if((F.col("k") > 0) & (F.col("p") < 0.05)).alias("n_enriched"))
    n = pathways.select("name").distinct().agg(F.count(F.lit(1)).alias("n_submitted"))
    val = F.col("n_valid") / F.col("n_submitted")
    return _one(n, e).withColumn("score", 0.6 * val + 0.4 * F.col("n_enriched") / F.greatest("n_valid", F.lit(1)))


def coexpression_replication(expr: DataFrame, surv: DataFrame, ext: DataFrame, control: DataFrame, genes: DataFrame, min_genes: int = 4) -> DataFrame:
    """Does the gene-gene structure carry over? Mean of specificity (rank agreement with the external cohort above that with
    a control cohort), sign concordance above chance, and leave-one-out direction match (if both directions exist)."""
    both = genes.join(expr.select("feature").distinct(), "feature", "left_semi").join(ext.select("feature").distinct(), "feature", "left_semi")
    both = cut_lineage(both)
    cols = ["sample_id", "feature", "value"]
    all_ = expr.select(*cols).withColumn("cohort", F.lit("own")).union(ext.select(*cols).withColumn("cohort", F.lit("external"))).union(control.select(*cols).withColumn("cohort", F.lit("control")))
    pr = cut_lineage(stats.pair_spearman(all_, both, by=["cohort"]))
    a = stats.matrix_agreement(pr, "cohort", "own", "external").select(F.col("matrix_rho").alias("rho_external"), "sign_concordance")
    b = stats.matrix_agreement(pr, "cohort", "own", "control").select(F.col("matrix_rho").alias("rho_control"))
    dirs = directions(expr.join(both, "feature", "left_semi"), surv)
    m = loo_direction_match(ext.join(both, "feature", "left_semi"), dirs).agg(F.avg(F.col("match").cast("double")).alias("direction_match"))
    n = both.agg(F.count(F.lit(1)).alias("n_genes"))
    rho = clip01(F.coalesce("rho_external", F.lit(0.0)) - F.coalesce("rho_control", F.lit(0.0)))
    conc = clip01((F.coalesce("sign_concordance", F.lit(0.0)) - 0.5) * 2)
    d = F.col("direction_match")
    j = _one(n, a, b, m).withColumn("score", F.when(d.isNull(), (rho + conc) / 2.0).otherwise((rho + conc + d) / 3.0))
    return _guarded(j, F.col("n_genes") >= min_genes)


def null_stratification(surv: DataFrame, reps: int, seed: int) -> DataFrame:
    """Null distribution of the survival stratification score over random partitions: every replicate in the same jobs.

    The replicate is a key of the log-rank and of the Cox fit; the survival table itself is shared.
    """
    part = random_partitions(surv, reps, seed)
    s = cut_lineage(surv.join(part, "sample_id"))
    lr = logrank(s, ["rep"]).select("rep", "p")
    by_k = s.groupBy("rep").agg(F.countDistinct("label").alias("k"))
    hr = None
    for k in sorted(r[0] for r in by_k.select("k").distinct().collect()):  # replicates with the same number of groups share a model shape
        sub = s.join(by_k.where(F.col("k") == k).select("rep"), "rep", "left_semi")
        h = hr_vs_worst(sub, ["rep"])
        hr = h if hr is None else hr.union(h)
    j = lr.join(hr, "rep", "left")
    a = clip01(-F.log10(F.greatest("p", F.lit(1e-12))) / 4.0)
    b = clip01(F.log(F.coalesce("hr_vs_worst", F.lit(1.0))) / F.log(F.lit(4.0)))
    return j.select("rep", (0.5 * a + 0.5 * b).alias("score"))


def null_provenance(expr: DataFrame, surv: DataFrame, grp: DataFrame, reps: int, seed: int, size: int = 15) -> DataFrame:
    """Null distribution of the provenance score over random gene sets. The per-gene table is computed once and shared."""
    ev = cut_lineage(gene_evidence(expr, grp, surv, expr.select("feature").distinct()))
    sets = random_gene_sets(ev.select(F.col("feature").alias("gene")), reps, seed, size).withColumnRenamed("gene", "feature")
    n = F.coalesce((F.col("de_fdr") < 0.05).cast("int"), F.lit(0)) + F.coalesce((F.col("surv_fdr") < 0.05).cast("int"), F.lit(0)) + (F.col("methylation") | F.col("cna")).cast("int")
    return sets.join(ev, "feature").groupBy("rep").agg(F.avg((n >= 2).cast("double")).alias("score"))
