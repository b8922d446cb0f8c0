"""Per-feature screens over long tables. Every one is a partial aggregation plus, at most, a distributed rank.

Inputs: ``expr(sample_id, feature, value)``, ``grp(sample_id, label)``. ``by`` adds keys (cohort, replicate, fold)
so that many screens run as one job.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.tails import chi2_sf, f_sf, fisher2, hyper_sf, norm_sf2, t_quantile95, t_sf2
from cohortia.operators.ordered import add_rank, bh_fdr, rank_table, ranked_cells
from cohortia.session import cut_lineage, distinct_values


def _grouped(expr: DataFrame, grp: DataFrame, by: Sequence[str]) -> DataFrame:
    return expr.join(grp, [*by, "sample_id"]).where(F.col("value").isNotNull() & F.col("label").isNotNull())


def group_moments(expr: DataFrame, grp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sum of squared deviations per (feature, label); one map-side combined shuffle."""
    return (
        _grouped(expr, grp, by)
        .groupBy(*by, "feature", "label")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
             (F.var_pop("value") * F.count("value")).alias("ss"), F.sum("value").alias("total"))
    )


def anova(expr: DataFrame, grp: DataFrame, by: Sequence[str] = (), min_group: int = 3, min_samples: int = 10,
          with_p: bool = True) -> DataFrame:
    """One-way ANOVA per feature over groups of at least ``min_group``: f, df1, df2, n (and p)."""
    m = group_moments(expr, grp, by)
    kept = F.col("n") >= min_group
    a = m.groupBy(*by, "feature").agg(
        F.sum("n").alias("n_all"),
        F.sum(F.when(kept, F.col("n"))).alias("n"),
        F.count(F.when(kept, 1)).alias("k"),
        F.sum(F.when(kept, F.col("ss"))).alias("ssw"),
        F.sum(F.when(kept, F.col("total"))).alias("t"),
        F.sum(F.when(kept, F.col("n") * F.col("mean") * F.col("mean"))).alias("q"),
    ).where((F.col("n_all") >= min_samples) & (F.col("k") >= 2) & (F.col("n") > F.col("k")))
    ssb = F.col("q") - F.col("t") * F.col("t") / F.col("n")
    f = (ssb / (F.col("k") - 1)) / F.nullif(F.col("ssw") / (F.col("n") - F.col("k")), F.lit(0.0))
    out = a.select(*by, "feature", f.alias("f"), (F.col("k") - 1).cast("long").alias("df1"),
                   (F.col("n") - F.col("k")).cast("long").alias("df2"), F.col("n").cast("long").alias("n"))
    return out.withColumn("p", f_sf("f", "df1", "df2")) if with_p else out


def _label_cells(expr: DataFrame, grp: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, feature, value, label, n), stored once: every later branch reads this table, not the samples."""
    return cut_lineage(_grouped(expr, grp, by).groupBy(*by, "feature", "value", "label").agg(F.count(F.lit(1)).alias("n")))


def _rank_sums(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (by, feature, label): n, rank_sum, tie (share of the tie term), n_total."""
    t = F.col("ties").cast("double")
    return ranked_cells(cells, [*by, "feature"], "value").groupBy(*by, "feature", "label").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("n") * (t * t - 1)).alias("tie"), F.max("n_total").alias("n_total"))


def kruskal(expr: DataFrame, grp: DataFrame, by: Sequence[str] = (), min_group: int = 3,
            with_p: bool = True) -> DataFrame:
    """Kruskal-Wallis H per feature with tie correction; features with fewer than two usable groups get h = 0."""
    cells = _label_cells(expr, grp, by)
    sizes = cells.groupBy(*by, "feature", "label").agg(F.sum("n").alias("_s"))
    usable = cells.join(sizes.where(F.col("_s") >= min_group).drop("_s"), [*by, "feature", "label"], "left_semi")
    h = _rank_sums(usable, by).groupBy(*by, "feature").agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"),
        F.sum("tie").alias("tie"), F.max("n_total").alias("n_total"))
    n = F.col("n_total").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    fixed = raw / F.nullif(1.0 - F.col("tie") / (n * n * n - n), F.lit(0.0))
    out = h.select(*by, "feature", F.when(F.col("k") >= 2, F.coalesce(fixed, F.lit(0.0))).otherwise(0.0).alias("h"),
                   (F.col("k") - 1).alias("df"))
    feats = sizes.select(*by, "feature").distinct()
    out = feats.join(out, [*by, "feature"], "left").na.fill({"h": 0.0, "df": 0})
    return out.withColumn("p", chi2_sf("h", "df")) if with_p else out


def auc_one_vs_rest(expr: DataFrame, grp: DataFrame, by: Sequence[str] = (), min_group: int = 3) -> DataFrame:
    """Folded one-vs-rest ROC AUC per (feature, label) from rank sums; both sides need ``min_group`` samples."""
    sums = _rank_sums(_label_cells(expr, grp, by), by)
    n, tot = F.col("n"), F.col("n_total")
    auc = (F.col("rank_sum") - n * (n + 1) / 2.0) / (n * (tot - n))
    return sums.where((n >= min_group) & (tot - n >= min_group)).select(
        *by, "feature", "label", auc.alias("auc"), F.greatest(auc, 1 - auc).alias("folded_auc"))


def mann_whitney(df: DataFrame, by: Sequence[str], value: str, group: str, first, with_p: bool = True) -> DataFrame:
    """Mann-Whitney U of group == first against the rest, tie-corrected normal approximation with continuity."""
    e = df.select(*by, F.col(value).cast("double").alias("value"),
                  F.when(F.col(group) == F.lit(first), 1).otherwise(0).alias("label"))
    cells = cut_lineage(e.where("value IS NOT NULL").groupBy(*by, "value", "label").agg(F.count(F.lit(1)).alias("n")))
    rk = ranked_cells(cells, by, "value")
    t = F.col("ties").cast("double")
    j = rk.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("n2"),
        F.sum(F.when(F.col("label") == 1, F.col("n") * F.col("rank"))).alias("r1"),
        F.sum(F.col("n") * (t * t - 1)).alias("tie"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    out = j.where("n1 > 0 AND n2 > 0").select(
        *by, "n1", "n2", u.alias("u"),
        (F.greatest(F.abs(u - n1 * n2 / 2.0) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))).alias("z"))
    return out.withColumn("p", norm_sf2("z")) if with_p else out


def wilcoxon_signed_rank(df: DataFrame, by: Sequence[str], value: str, with_p: bool = True) -> DataFrame:
    """Signed-rank test against zero; zeros dropped, normal approximation with tie correction."""
    nz = df.where(F.col(value) != 0).select(*by, F.abs(value).alias("_a"), F.signum(value).alias("_s"))
    cells = cut_lineage(nz.groupBy(*by, "_a", "_s").agg(F.count(F.lit(1)).alias("n")))
    t = F.col("ties").cast("double")
    s = ranked_cells(cells, by, "_a").groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("_s") > 0, F.col("n") * F.col("rank")).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(F.col("_s") < 0, F.col("n") * F.col("rank")).otherwise(0.0)).alias("w_neg"),
        F.sum(F.col("n") * (t * t - 1)).alias("tie"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie") / 48.0)
    z = (F.least("w_pos", "w_neg") - n * (n + 1) / 4.0) / F.nullif(sd, F.lit(0.0))
    out = s.select(*by, "n", "w_pos", "w_neg", z.alias("z"))
    return out.withColumn("p", norm_sf2("z")) if with_p else out


def correlation_p(out: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Two-sided p of a correlation through its t statistic, r clipped away from +-1."""
    c = F.greatest(F.least(F.col(r), F.lit(0.999999)), F.lit(-0.999999))
    return out.withColumn("p", t_sf2(c * F.sqrt((F.col(n) - 2) / (1 - c * c)), F.col(n) - 2))


def spearman(pairs: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 10, with_p: bool = True) -> DataFrame:
    """Spearman rho per key from distributed ranks: rho, n (and p). Constant sides give null rho."""
    ok = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    cells = cut_lineage(ok.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_n")))
    rx, ry = rank_table(cells, by, x, "_n"), rank_table(cells, by, y, "_n")
    j = cells.join(rx.select(*by, x, F.col("rank").alias("_rx")), [*by, x]).join(
        ry.select(*by, y, F.col("rank").alias("_ry")), [*by, y])
    w = F.col("_n")
    s = j.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("xy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("xx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("yy"))
    n = F.col("n").cast("double")
    base = n * (n + 1) * (n + 1) / 4.0
    den = F.sqrt((F.col("xx") - base) * (F.col("yy") - base))
    out = s.where(F.col("n") >= min_n).select(
        *by, "n", ((F.col("xy") - base) / F.nullif(den, F.lit(0.0))).alias("rho"))
    return correlation_p(out, "rho") if with_p else out


def survival_spearman(expr: DataFrame, surv: DataFrame, by: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """Spearman of each feature with survival time (ignores censoring, as the screen it stands for does)."""
    pairs = expr.join(surv.select(*by, "sample_id", "duration"), [*by, "sample_id"])
    return spearman(pairs, [*by, "feature"], "value", "duration", with_p=with_p)


def two_by_two(events: DataFrame, grp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """2x2 counts per (gene, label): a/b = with/without event in the group, c/d = outside it.

    ``events(sample_id, gene)`` holds positive calls only, so the zero grid is never built.
    """
    g = grp.where("label IS NOT NULL").select(*by, "sample_id", "label").distinct()
    sizes = g.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_in"))
    hit = events.select(*by, "sample_id", "gene").distinct().join(g, [*by, "sample_id"])
    a = cut_lineage(hit.groupBy(*by, "gene", "label").agg(F.count(F.lit(1)).alias("a")))
    per_gene = a.groupBy(*by, "gene").agg(F.sum("a").alias("pos"))
    # genes x labels frame: labels are a handful per key and carried as one array, not a cross join
    labels = sizes.groupBy(*by).agg(F.collect_list(F.struct("label", "n_in")).alias("_l"), F.sum("n_in").alias("n_all"))
    frame = per_gene.join(F.broadcast(labels), list(by)) if by else per_gene.join(F.broadcast(labels), on=F.lit(True))
    frame = frame.select(*by, "gene", "pos", "n_all", F.inline("_l"))
    t = frame.join(a, [*by, "gene", "label"], "left").na.fill({"a": 0})
    return t.select(*by, "gene", "label", "a", (F.col("n_in") - F.col("a")).alias("b"),
                    (F.col("pos") - F.col("a")).alias("c"),
                    (F.col("n_all") - F.col("n_in") - F.col("pos") + F.col("a")).alias("d"))


def fisher_enrichment(events: DataFrame, grp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided Fisher per gene x group against the rest, with odds ratio and BH over the whole family."""
    t = two_by_two(events, grp, by).withColumn("p", fisher2("a", "b", "c", "d"))
    t = t.withColumn("odds_ratio", F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), F.lit(0)))
    return bh_fdr(t, by)


def cna_enrichment(cna: DataFrame, grp: DataFrame, min_covered: int = 20, threshold: float = 0.05) -> DataFrame:
    """Altered-vs-neutral Fisher per gene, best group. ``cna(sample_id, gene, call)``.

    A sample counts as covered when any gene of it is non-zero; degenerate margins are skipped.
    """
    altered = cna.where(F.col("call") != 0)
    covered = altered.select("sample_id").distinct()
    g = grp.join(covered, "sample_id", "left_semi")
    t = two_by_two(altered, g).where("a + c >= 1 AND b + d >= 1 AND a + b + c + d >= %d" % min_covered)
    t = t.withColumn("p", fisher2("a", "b", "c", "d"))
    return t.groupBy("gene").agg(
        F.min("p").alias("best_p"), F.min_by("label", F.struct("p", "label")).alias("best_group")
    ).withColumn("passed", F.col("best_p") < threshold)


def methylation_evidence(expr: DataFrame, meth: DataFrame, genes: DataFrame, min_n: int = 20, r_threshold: float = 0.3,
                         fdr_threshold: float = 0.05) -> DataFrame:
    """Best CpG per submitted gene by |Pearson r|, its BH FDR within that gene's CpG family, and the verdict.

    ``genes(feature)`` is the submitted list: the semi join bounds the gene side before samples are joined.
    """
    x = expr.join(genes, "feature", "left_semi").select("sample_id", F.col("feature").alias("gene"),
                                                        F.col("value").alias("x"))
    m = meth.select("sample_id", F.col("feature").alias("cpg"), F.col("value").alias("m"))
    r = x.join(m, "sample_id").groupBy("gene", "cpg").agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "m").alias("r")).where(
        (F.col("n") >= min_n) & F.col("r").isNotNull() & ~F.isnan("r"))
    t = bh_fdr(correlation_p(r), ["gene"])
    best = F.struct(F.abs("r"), "cpg")
    return t.groupBy("gene").agg(
        F.max_by("cpg", best).alias("best_cpg"), F.max_by("r", best).alias("best_r"),
        F.max_by("p", best).alias("best_p"), F.max_by("fdr", best).alias("best_fdr"), F.count(F.lit(1)).alias("n_cpgs"),
    ).withColumn("passed", (F.abs("best_r") >= r_threshold) & (F.col("best_fdr") < fdr_threshold))


def over_representation(hits: DataFrame, sets: DataFrame, universe: int = 20000) -> DataFrame:
    """Hypergeometric upper tail per gene set. ``hits(gene)``, ``sets(set_name, gene)``."""
    h = hits.select("gene").distinct()
    n_hits = h.agg(F.count(F.lit(1)).alias("n_draw"))
    s = sets.select("set_name", "gene").distinct()
    k = s.join(h.withColumn("_hit", F.lit(1)), "gene", "left").groupBy("set_name").agg(
        F.count(F.lit(1)).alias("n_set"), F.count("_hit").alias("k"))
    return k.join(F.broadcast(n_hits), on=F.lit(True)).withColumn(
        "p", F.when(F.col("k") > 0, hyper_sf("k", F.lit(universe), "n_set", "n_draw")).otherwise(1.0))


def cohens_d(df: DataFrame, by: Sequence[str], value: str, in_a: Column) -> DataFrame:
    """(mean a - mean b) / sqrt of the average population variance."""
    a, b = F.when(in_a, F.col(value)), F.when(~in_a, F.col(value))
    sd = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2.0)
    return df.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"),
                               F.avg(b).alias("mean_b"),
                               ((F.avg(a) - F.avg(b)) / F.nullif(sd, F.lit(0.0))).alias("d"))


def mean_ci(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd (n-1) and half-width of the 95% t interval."""
    a = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"))
    return a.withColumn("ci95", t_quantile95(F.col("n") - 1) * F.col("sd") / F.sqrt("n"))


def separation(a: DataFrame, key: Sequence[str], side: str, left, right) -> DataFrame:
    """z of the difference of two means: ``a`` is a mean_ci table with a two-valued ``side`` column."""
    def pick(c, v):
        return F.max(F.when(F.col(side) == F.lit(v), F.col(c)))
    se2 = F.col("sd") * F.col("sd") / F.col("n")
    t = a.withColumn("_se2", se2).groupBy(*key).agg(
        (pick("mean", left) - pick("mean", right)).alias("diff"), (pick("_se2", left) + pick("_se2", right)).alias("v"))
    return t.select(*key, "diff", (F.col("diff") / F.nullif(F.sqrt("v"), F.lit(0.0))).alias("z"))


def pair_spearman(expr: DataFrame, genes: DataFrame, by: Sequence[str] = (), max_genes: int = 2000) -> DataFrame:
    """Spearman rho of every pair (a < b) of a submitted gene list, per ``by`` key, as a long table.

    The pairs are those of the list, whose size is checked. Each task turns its samples' rank vectors into partial
    cross-product sums (one row per pair and Arrow batch), so no sample-level pair is ever emitted.
    """
    names = distinct_values(genes, "feature", max_genes)
    d = len(names)
    x = cut_lineage(expr.join(genes, "feature", "left_semi").select(*by, "sample_id", "feature", "value"))
    r = add_rank(x, [*by, "feature"], "value", "rank")
    packed = r.groupBy(*by, "sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "rank"))).alias("m"))
    order = F.array(*[F.lit(n) for n in names])
    vec = packed.select(*by, F.transform(order, lambda f: F.coalesce(F.try_element_at("m", f), F.lit(float("nan")))).alias("v"))
    iu = np.triu_indices(d, 1)

    def partial(batches):
        for pdf in batches:
            for key, g in (pdf.groupby(list(by), sort=False) if by else [((), pdf)]):
                m = np.vstack(g["v"].to_numpy()).astype(float)
                ok = (~np.isnan(m)).astype(float)
                z = np.nan_to_num(m)
                zz = z * z
                cross = {"n": ok.T @ ok, "xy": z.T @ z, "x": z.T @ ok, "y": ok.T @ z, "xx": zz.T @ ok, "yy": ok.T @ zz}
                out = {c: [v] * len(iu[0]) for c, v in zip(by, key)}
                out |= {"ai": iu[0], "bi": iu[1]} | {c: v[iu] for c, v in cross.items()}
                yield pd.DataFrame(out)

    fields = [expr.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in ("ai", "bi")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("n", "xy", "x", "y", "xx", "yy")]
    sums = vec.mapInPandas(partial, T.StructType(fields)).groupBy(*by, "ai", "bi").agg(
        *[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")])
    n = F.col("n")
    cov = F.col("xy") - F.col("x") * F.col("y") / n
    den = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n))
    return sums.select(*by, F.element_at(order, F.col("ai") + 1).alias("a"), F.element_at(order, F.col("bi") + 1).alias("b"),
                       (cov / F.nullif(den, F.lit(0.0))).alias("rho"), n.cast("long").alias("n"))


def matrix_agreement(pairs: DataFrame, cohort: str, left, right) -> DataFrame:
    """Rank correlation of two cohorts' pair vectors and the share of pairs with the same sign."""
    p = cut_lineage(pairs.groupBy("a", "b").agg(
        F.max(F.when(F.col(cohort) == F.lit(left), F.col("rho"))).alias("x"),
        F.max(F.when(F.col(cohort) == F.lit(right), F.col("rho"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL"))
    sign = p.agg(F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_concordance"))
    rho = spearman(p, [], "x", "y", min_n=3, with_p=False)
    return rho.join(F.broadcast(sign), on=F.lit(True)).select("n", F.col("rho").alias("matrix_rho"), "sign_concordance")


def marker_table(expr: DataFrame, grp: DataFrame) -> DataFrame:
    """Per (feature, label): mean in the group, mean outside, difference, standardised effect."""
    m = group_moments(expr, grp).withColumn("sq", F.col("ss") + F.col("n") * F.col("mean") * F.col("mean"))
    tot = m.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("total").alias("t_all"), F.sum("sq").alias("q_all"))
    j = m.join(tot, "feature")
    n2, t2, q2 = F.col("n_all") - F.col("n"), F.col("t_all") - F.col("total"), F.col("q_all") - F.col("sq")
    mean2 = t2 / n2
    v1, v2 = F.col("ss") / F.col("n"), q2 / n2 - mean2 * mean2
    return j.where(n2 > 0).select(
        "feature", "label", F.col("mean").alias("mean_in"), mean2.alias("mean_out"),
        (F.col("mean") - mean2).alias("diff"),
        ((F.col("mean") - mean2) / F.nullif(F.sqrt((v1 + v2) / 2.0), F.lit(0.0))).alias("effect"))


def two_hit(mutation: DataFrame, cna: DataFrame, grp: DataFrame) -> DataFrame:
    """Samples per (gene, label) that carry both a mutation and a copy-number change in the same gene."""
    m = mutation.select("sample_id", "gene").distinct()
    c = cna.where(F.col("call") != 0).select("sample_id", "gene").distinct()
    both = m.join(c, ["sample_id", "gene"], "left_semi").join(grp, "sample_id")
    return both.groupBy("gene", "label").agg(F.count(F.lit(1)).alias("n_two_hit"))
