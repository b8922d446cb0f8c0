"""Survival tables, curves, tests, signatures and replication on distributed risk sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.tails import chi2_sf
from cohortia.operators.cox import cox_fit, cox_univariate
from cohortia.operators.ordered import draw_order, quantiles, running_by
from cohortia.operators.stats import spearman
from cohortia.session import cut_lineage, distinct_values

MAX_GROUPS = 64  # covariance matrices are k x k; more groups than this is refused, never truncated


def survival_table(meta: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(sample_id, duration, event): event from the vital status text, time from death or last follow-up.

    Times may be text; anything non-numeric, NaN or <= 0 is dropped.
    """
    vs = F.lower(F.coalesce(F.col("vital_status").cast("string"), F.lit("")))
    event = vs.contains("dead") | vs.contains("deceased")
    days = F.when(event, F.expr("try_cast(days_to_death AS DOUBLE)")).otherwise(
        F.expr("try_cast(days_to_last_follow_up AS DOUBLE)"))
    return meta.select("sample_id", *keep, days.alias("duration"), event.cast("int").alias("event")).where(
        (F.col("duration") > 0) & ~F.isnan("duration"))


def _time_cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, duration, n, d) cells, stored once."""
    return cut_lineage(df.groupBy(*by, "duration").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d")))


def at_risk(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key and distinct time: events d and number at risk."""
    return running_by(_time_cells(df, by), by, ["duration"], {"at_risk": ("sum", "n")}, descending=True)


def kaplan_meier(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kaplan-Meier survival at each distinct time of each key: exp of a running sum of log(1 - d/n)."""
    r = at_risk(df, by)
    term = F.when(F.col("d") == F.col("at_risk"), F.lit(float("-inf"))).otherwise(
        F.log1p(-F.col("d") / F.col("at_risk").cast("double")))
    s = running_by(cut_lineage(r.withColumn("_l", term)), by, ["duration"], {"_cum": ("sum", "_l")})
    return s.select(*by, "duration", "at_risk", "d", F.exp("_cum").alias("survival"))


@F.pandas_udf(T.DoubleType())
def _quad_form(z: pd.Series, v: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(z, v):
        a = np.asarray(a, dtype=float)
        out.append(float(a @ np.linalg.pinv(np.asarray(b, dtype=float).reshape(len(a), len(a)), rcond=1e-9) @ a))
    return pd.Series(out)


def _label_cells(df: DataFrame, by: Sequence[str], labels: list, weight: str | None = None) -> DataFrame:
    """Per (by, duration): n_i and d_i for each of the k labels side by side, stored once. ``weight``: rows a row stands for."""
    cols = []
    for i, g in enumerate(labels):
        hit = F.col("label") == F.lit(g)
        n = F.coalesce(F.sum(F.when(hit, F.col(weight))), F.lit(0)) if weight else F.count(F.when(hit, 1))
        cols += [n.alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, F.col("event"))), F.lit(0)).alias(f"d{i}")]
    return cut_lineage(df.where("label IS NOT NULL").groupBy(*by, "duration").agg(*cols))


def logrank(df: DataFrame, by: Sequence[str] = (), labels: list | None = None, with_p: bool = True) -> DataFrame:
    """k-sample log-rank per key: chi2, df (and p). ``df``: by..., duration, event, label."""
    labels = labels or distinct_values(df, "label", MAX_GROUPS)
    k = len(labels)
    r = running_by(_label_cells(df, by, labels), by, ["duration"], {f"r{i}": ("sum", f"n{i}") for i in range(k)},
                descending=True)
    n = sum((F.col(f"r{i}") for i in range(k)), F.lit(0)).cast("double")
    d = sum((F.col(f"d{i}") for i in range(k)), F.lit(0)).cast("double")
    r = r.withColumn("_n", n).withColumn("_d", d).where("_d > 0")
    n, d = F.col("_n"), F.col("_d")
    fac = F.when(n > 1, d * (n - d) / (n - 1) / (n * n)).otherwise(0.0)
    z = [F.sum(F.col(f"d{i}") - d * F.col(f"r{i}") / n) for i in range(1, k)]
    v = [F.sum(fac * F.col(f"r{i}") * ((n if i == j else F.lit(0.0)) - F.col(f"r{j}"))) for i in range(1, k) for j in range(1, k)]
    seen = sum((F.max((F.col(f"r{i}") > 0).cast("long")) for i in range(k)), F.lit(0))
    out = r.groupBy(*by).agg(F.array(*z).alias("z"), F.array(*v).alias("v"), (seen - 1).cast("long").alias("df"))
    out = out.select(*by, _quad_form("z", "v").alias("chi2"), "df")
    return out.withColumn("p", chi2_sf("chi2", "df")) if with_p else out


def group_medians(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median duration per label (censored rows included), with n and events."""
    q = quantiles(df.where("label IS NOT NULL"), [*by, "label"], "duration", {"median": 0.5})
    ev = df.groupBy(*by, "label").agg(F.sum("event").alias("events"))
    return q.join(ev, [*by, "label"])


def concordance(df: DataFrame, by: Sequence[str] = (), labels: list | None = None) -> DataFrame:
    """C-index of the label ranked by its median duration: c, folded max(c, 1-c), comparable pairs.

    The score has as many levels as labels, so pairs are counted from per-level suffix sums.
    """
    cells = cut_lineage(df.where("label IS NOT NULL").groupBy(*by, "label", "duration").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("event").alias("event")))
    labels = labels or distinct_values(cells, "label", MAX_GROUPS)
    k = len(labels)
    med = quantiles(cells, [*by, "label"], "duration", {"median": 0.5}, weight="_n")
    sc = med.groupBy(*by).agg(*[F.max(F.when(F.col("label") == F.lit(g), F.col("median"))).alias(f"m{i}")
                                for i, g in enumerate(labels)])
    r = running_by(_label_cells(cells, by, labels, "_n"), by, ["duration"], {f"r{i}": ("sum", f"n{i}") for i in range(k)},
                descending=True).where(" + ".join(f"d{i}" for i in range(k)) + " > 0")
    j = r.join(sc, list(by)) if by else r.join(F.broadcast(sc), on=F.lit(True))
    after = F.array(*[(F.col(f"r{i}") - F.col(f"d{i}")).cast("double") for i in range(k)])
    ev = F.array(*[F.col(f"d{i}").cast("double") for i in range(k)])
    m = F.array(*[F.col(f"m{i}") for i in range(k)])
    j = j.select(*by, after.alias("a"), ev.alias("e"), m.alias("m"))
    idx = F.sequence(F.lit(0), F.lit(k - 1))

    def inner(g):
        return F.aggregate(idx, F.lit(0.0), lambda s, l: s + F.col("a")[l] * F.when(
            F.col("m")[l] > F.col("m")[g], 1.0).when(F.col("m")[l] == F.col("m")[g], 0.5).otherwise(0.0))

    conc = F.aggregate(idx, F.lit(0.0), lambda s, g: s + F.col("e")[g] * inner(g))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) * F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    out = j.groupBy(*by).agg(F.sum(conc).alias("_c"), F.sum(total).alias("pairs"))
    c = F.col("_c") / F.nullif(F.col("pairs"), F.lit(0.0))
    return out.select(*by, c.alias("c_index"), F.greatest(c, 1 - c).alias("folded"), "pairs")


def group_cox(df: DataFrame, by: Sequence[str] = (), labels: list | None = None) -> DataFrame:
    """Log hazard ratio of every label against the label with the worst median: log_hr per (by, label).

    The dummy model is fitted once against the first label; switching the reference is a subtraction, so keys whose
    worst label differs still share one fit.
    """
    labels = labels or distinct_values(df, "label", MAX_GROUPS)
    x = df
    for i, g in enumerate(labels[1:], 1):
        x = x.withColumn(f"g{i}", (F.col("label") == F.lit(g)).cast("double"))
    fit = cox_fit(x.where("label IS NOT NULL"), by, [f"g{i}" for i in range(1, len(labels))])
    per = F.array(F.struct(F.lit(labels[0]).alias("label"), F.lit(0.0).alias("b")),
                  *[F.struct(F.lit(g).alias("label"), F.col("coef")[i].alias("b")) for i, g in enumerate(labels[1:])])
    long = fit.where("status = 'ok'").select(*by, F.inline(per))
    worst = group_medians(df, by).groupBy(*by).agg(F.min_by("label", F.struct("median", "label")).alias("worst"))
    j = long.join(worst, list(by)) if by else long.join(F.broadcast(worst), on=F.lit(True))
    base = j.where("label = worst").select(*by, F.col("b").alias("_b0"))
    j = j.join(base, list(by)) if by else j.join(F.broadcast(base), on=F.lit(True))
    return j.select(*by, "label", "worst", (F.col("b") - F.col("_b0")).alias("log_hr"))


def hr_vs_worst(df: DataFrame, by: Sequence[str] = (), labels: list | None = None) -> DataFrame:
    """exp(max |log HR|) of the labels against the worst-median label."""
    return group_cox(df, by, labels).where("label <> worst").groupBy(*by).agg(
        F.exp(F.max(F.abs("log_hr"))).alias("hr_vs_worst"))


def extreme_log_hr(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """|log HR| between the labels with the best and the worst median survival."""
    ext = group_medians(df, by).groupBy(*by).agg(
        F.max_by("label", F.struct("median", "label")).alias("best"), F.min_by("label", F.struct("median", "label")).alias("worst"))
    j = df.join(ext, list(by)) if by else df.join(F.broadcast(ext), on=F.lit(True))
    two = j.where("label = best OR label = worst").withColumn("x", (F.col("label") == F.col("best")).cast("double"))
    return cox_univariate(two, by, scale=None).select(*by, F.abs("coef").alias("log_hr"), "status")


def zscore(expr: DataFrame, by: Sequence[str] = (), sample_sd: bool = False) -> DataFrame:
    """z per feature; a zero sd counts as 1. Moments are aggregated map-side and joined back."""
    sd = F.stddev("value") if sample_sd else F.stddev_pop("value")
    st = expr.groupBy(*by, "feature").agg(F.avg("value").alias("_m"), sd.alias("_sd"))
    z = (F.col("value") - F.col("_m")) / F.coalesce(F.nullif("_sd", F.lit(0.0)), F.lit(1.0))
    return expr.join(st, [*by, "feature"]).withColumn("z", z).drop("_m", "_sd")


def gene_cox(expr: DataFrame, surv: DataFrame | None, by: Sequence[str] = (), min_n: int = 20, min_events: int = 1,
             scale: str = "sample") -> DataFrame:
    """Univariate Cox of every gene of every key at once; direction +1 protective, -1 risk."""
    x = expr
    if surv is not None:  # else the rows already carry duration and event
        x = expr.join(surv, [*[c for c in by if c in surv.columns], "sample_id"])
    x = x.select(*by, "feature", "duration", "event", F.col("value").alias("x"))
    f = cox_univariate(x, [*by, "feature"], scale=scale, min_n=min_n, min_events=min_events)
    return f.withColumn("direction", F.when(F.col("coef") > 0, -1).otherwise(1))


def directions(expr, surv, by: Sequence[str] = (), min_n: int = 20) -> DataFrame:
    """(by, feature, direction) of the genes that fit."""
    return cut_lineage(gene_cox(expr, surv, by, min_n).where("status = 'ok'").select(*by, "feature", "direction"))


def signature(expr: DataFrame, dirs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean z of protective minus mean z of risk genes per sample; z within each ``by`` key."""
    keys = [c for c in by if c in dirs.columns]
    d = expr.join(dirs, [*keys, "feature"])
    z = zscore(d, by)
    prot, risk = F.when(F.col("direction") > 0, F.col("z")), F.when(F.col("direction") < 0, F.col("z"))
    return z.groupBy(*by, "sample_id").agg(
        (F.coalesce(F.avg(prot), F.lit(0.0)) - F.coalesce(F.avg(risk), F.lit(0.0))).alias("score"))


def loo_direction_match(expr: DataFrame, dirs: DataFrame) -> DataFrame:
    """Per gene: Spearman of the gene with the signature built without it, and whether the sign matches.

    Total sums minus the gene's own share give every leave-one-out signature from a single aggregation.
    """
    z = cut_lineage(zscore(expr.join(dirs, "feature")))
    side = F.col("direction")
    tot = z.groupBy("sample_id").agg(
        F.sum(F.when(side > 0, F.col("z"))).alias("sp"), F.count(F.when(side > 0, 1)).alias("np"),
        F.sum(F.when(side < 0, F.col("z"))).alias("sr"), F.count(F.when(side < 0, 1)).alias("nr"))
    own_p, own_r = (side > 0).cast("int"), (side < 0).cast("int")
    sig = (F.col("sp") - own_p * F.col("z")) / (F.col("np") - own_p) - (F.col("sr") - own_r * F.col("z")) / (F.col("nr") - own_r)
    p = z.join(tot, "sample_id").where((F.col("np") - own_p > 0) & (F.col("nr") - own_r > 0)).select("feature", "value", sig.alias("sig"))
    rho = spearman(p, ["feature"], "value", "sig", min_n=3, with_p=False).where("rho IS NOT NULL")
    return rho.join(dirs, "feature").select("feature", "direction", "rho", (F.signum("rho") == F.col("direction")).alias("match"))


def folds(surv: DataFrame, k: int, seed: int) -> DataFrame:
    """(sample_id, fold): near-equal folds from the portable random order."""
    o = draw_order(surv.select("sample_id"), [], seed, ["sample_id"])
    return o.select("sample_id", ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def _replicates(surv: DataFrame, reps: int) -> DataFrame:
    return surv.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def bootstrap_weights(surv: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, sample_id) with repetition: each draw of each replicate picks the sample at a hashed position.

    Positions come from one global order, draws are made on the executors, and the join is on the position.
    """
    o = cut_lineage(draw_order(surv.select("sample_id"), [], seed, ["sample_id"]))
    n = o.count()
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "rep", "rn")), 1, 12), 16, 10).cast("long") % n + 1
    draws = o.select("rn", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("rep", pick.alias("rn"))
    return draws.join(o, "rn").select("rep", "sample_id")


def sign_stability(expr: DataFrame, surv: DataFrame, reps: int, seed: int) -> DataFrame:
    """Share of bootstrap replicates in which each gene keeps its full-data Cox sign."""
    expr, surv = cut_lineage(expr), cut_lineage(surv)
    full = directions(expr, surv)
    s = bootstrap_weights(surv, reps, seed).join(surv, "sample_id")
    d = cut_lineage(gene_cox(expr.join(full, "feature", "left_semi").join(s, "sample_id"), None, ["rep"]))
    done = d.where("status = 'ok'").select("rep").distinct().agg(F.count(F.lit(1)).alias("done"))
    kept = d.where("status = 'ok'").select("rep", "feature", F.col("direction").alias("d")).join(full, "feature").groupBy(
        "feature").agg(F.count(F.when(F.col("d") == F.col("direction"), 1)).alias("kept"))
    return full.join(kept, "feature", "left").join(F.broadcast(done), on=F.lit(True)).select(
        "feature", "direction", (F.coalesce("kept", F.lit(0)) / F.col("done")).alias("stability"))


def cv_signature(expr: DataFrame, surv: DataFrame, k: int, seed: int, top: int | None = None) -> DataFrame:
    """K-fold cross-validated signature: directions (and optionally the top genes by Cox p) from the training folds
    only, scores on the held-out fold, one Cox over all held-out samples."""
    expr, surv = cut_lineage(expr), cut_lineage(surv)
    f = cut_lineage(folds(surv, k, seed))
    # training rows of fold i are all rows of the other folds: tag each row with the k-1 models it trains
    tags = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("fold"))
    train = f.select("sample_id", F.explode(tags).alias("fold"))
    g = gene_cox(expr.join(train, "sample_id"), surv, ["fold"]).where("status = 'ok'")
    if top:
        from pyspark.sql.window import Window as W
        g = g.withColumn("_rn", F.row_number().over(W.partitionBy("fold").orderBy("p", "feature"))).where(F.col("_rn") <= top)
    dirs = cut_lineage(g.select("fold", "feature", "direction"))
    sc = signature(expr.join(f, "sample_id"), dirs, ["fold"]).join(surv, "sample_id")
    return cox_univariate(sc.select("duration", "event", F.col("score").alias("x")), [])


def leave_out_stability(expr: DataFrame, surv: DataFrame, reps: int, seed: int, keep: float = 0.9) -> DataFrame:
    """SD over replicates of the in-sample signature log HR when a tenth of the samples is left out."""
    expr, surv = cut_lineage(expr), cut_lineage(surv)
    r = draw_order(_replicates(surv.select("sample_id"), reps), ["rep"], seed, ["sample_id"])
    n = surv.count()
    kept = cut_lineage(r.where(F.col("rn") <= int(round(n * keep))).select("rep", "sample_id"))
    e = expr.join(kept, "sample_id")
    dirs = directions(e, surv, ["rep"])
    sc = signature(e, dirs, ["rep"]).join(surv, "sample_id").select("rep", "duration", "event", F.col("score").alias("x"))
    fit = cox_univariate(sc, ["rep"]).where("status = 'ok'")
    return fit.agg(F.count(F.lit(1)).alias("reps"), F.stddev("coef").alias("sd_log_hr"))


def marker_transfer(expr: DataFrame, surv: DataFrame, dirs: DataFrame, near: float = 0.15) -> DataFrame:
    """Spearman of the signature with time in another cohort and its class."""
    sc = signature(expr, dirs).join(surv, "sample_id")
    rho = spearman(sc, [], "score", "duration")
    return rho.withColumn("interpretation", F.when(F.col("rho") > near, "replicates").when(
        F.col("rho") < -near, "flips").otherwise("near-zero"))


def cohort_sheet(expr: DataFrame, surv: DataFrame) -> DataFrame:
    """QC sheet: samples, events, median follow-up, features, mean per-feature sd."""
    s = quantiles(surv.withColumn("_g", F.lit(1)), ["_g"], "duration", {"median_follow_up": 0.5}).drop("_g")
    e = surv.agg(F.sum("event").alias("n_events"))
    f = expr.groupBy("feature").agg(F.stddev("value").alias("sd")).agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("sd").alias("mean_feature_sd"))
    return s.withColumnRenamed("n", "n_samples").join(F.broadcast(e), on=F.lit(True)).join(F.broadcast(f), on=F.lit(True))


def adjusted_gene_cox(expr: DataFrame, surv: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Cox per gene with shared clinical covariates: adjusted coefficient of the gene."""
    x = zscore(expr).join(surv, "sample_id").select("feature", "duration", "event", F.col("z").alias("x"), *covariates)
    f = cox_fit(x, ["feature"], ["x", *covariates])
    return f.select("feature", F.col("coef")[0].alias("coef"), F.col("se")[0].alias("se"), "n", "events", "status")


# fixed values: literature marker sets with the direction they are expected to show
POSITIVE_CONTROLS = [
    ("cytolytic", ["GZMA", "PRF1"], "prot"),
    ("ifn_gamma", ["IFNG", "STAT1", "IDO1", "CXCL9", "CXCL10", "HLA-DRA"], "prot"),
    ("hypoxia", ["VEGFA", "SLC2A1", "CA9", "LDHA", "PGK1", "ENO1", "ADM", "NDRG1", "BNIP3", "P4HA1", "ALDOA", "PGAM1",
                 "HK2", "HILPDA"], "adv"),
    ("proliferation", ["MKI67", "TOP2A", "CCNB1", "CDK1", "BUB1", "AURKA"], "adv"),
]


def survival_replication(expr: DataFrame, surv: DataFrame, ext_expr: DataFrame, ext_surv: DataFrame, genes: DataFrame,
                         controls: Sequence[tuple[str, Sequence[str], str]] = tuple(POSITIVE_CONTROLS)) -> DataFrame:
    """Does a signature learned in one cohort stratify survival in another? One row with score and verdict.

    Directions are inferred in the first cohort; candidate and control signatures are scored in the second and share
    one batched Cox. A wrong direction is a gate (score 0), not one of several additive parts.

    The row is there whatever the cohorts hold: with fewer than 20 samples, fewer than two genes or no fit the score is 0, the
    figures of the fit and the verdict are null, and ``reason`` says why (null otherwise).
    """
    spark = expr.sparkSession
    ext_expr, ext_surv = cut_lineage(ext_expr), cut_lineage(ext_surv)
    dirs = directions(expr.join(genes, "feature", "left_semi"), surv)
    ctl = [(name, g, 1) for name, gs, _ in controls for g in gs]
    ctl_df = spark.createDataFrame(ctl, "signature string, feature string, direction int")
    sets = dirs.withColumn("signature", F.lit("candidate")).select("signature", "feature", "direction").unionByName(ctl_df)
    x = cut_lineage(ext_expr.join(sets, "feature").join(ext_surv.select("sample_id"), "sample_id", "left_semi"))
    sc = signature(x.select("signature", "sample_id", "feature", "value"), sets, ["signature"]).join(ext_surv, "sample_id")
    fit = cut_lineage(cox_univariate(sc.select("signature", "duration", "event", F.col("score").alias("x")), ["signature"]).where("status = 'ok'"))
    expect = F.create_map(*[F.lit(v) for name, _, e in controls for v in (name, e)])
    want = F.element_at(expect, F.col("signature"))
    ctl_ok = (F.col("p") < 0.05) & (((F.col("hr") < 1) & (want == "prot")) | ((F.col("hr") > 1) & (want == "adv")))
    power = fit.where("signature <> 'candidate'").agg(F.count(F.when(ctl_ok, 1)).alias("n_controls_passing"))
    used = x.where("signature = 'candidate'").select("feature", "direction").distinct().agg(
        F.count(F.when(F.col("direction") > 0, 1)).alias("n_protective"), F.count(F.when(F.col("direction") < 0, 1)).alias("n_risk"))
    common = ext_expr.select("sample_id").distinct().join(ext_surv.select("sample_id"), "sample_id", "left_semi").agg(F.count(F.lit(1)).alias("_common"))
    # one row of counts that no join can empty; the candidate's fit is attached to it
    base = common.join(F.broadcast(used), on=F.lit(True)).join(F.broadcast(power), on=F.lit(True)).withColumn("signature", F.lit("candidate"))
    c = base.join(fit.select("signature", "n", "events", "coef", "hr", "p"), "signature", "left")
    genes_used = F.col("n_protective") + F.col("n_risk")
    # fixed values: at least 20 samples and two genes
    reason = (F.when(F.col("_common") < 20, F.concat(F.lit("only "), F.col("_common"), F.lit(" samples with expression and survival")))
              .when(genes_used < 2, F.concat(F.lit("only "), genes_used, F.lit(" genes with a direction and external expression")))
              .when(F.col("hr").isNull(), F.lit("Cox fit failed on the signature")))
    c = cut_lineage(c.withColumn("reason", reason))
    ok = F.col("reason").isNull()
    right = ok & (F.col("hr") < 1)
    sig = F.when(right, F.least(-F.log10(F.greatest("p", F.lit(1e-12))) / 4.0, F.lit(1.0))).otherwise(0.0)
    mag = F.when(right, F.least(F.abs(F.col("coef")) / F.log(F.lit(2.0)), F.lit(1.0))).otherwise(0.0)
    # fixed values: names and thresholds of the verdict
    verdict = (F.when(F.col("n_controls_passing") < 1, "underpowered_cohort_inconclusive").when(~right, "genuine_non_replication")
               .when((F.col("p") < 0.05) & (F.abs("coef") > F.log(F.lit(1.5))), "replicates")
               .when(F.col("p") < 0.05, "weak_replication").otherwise("uninformative"))
    fitted = [F.when(ok, F.col(x)).alias(x) for x in ("n", "events", "hr", "p")]
    return c.select(*fitted, "n_protective", "n_risk", F.when(ok, right).alias("direction_ok"), sig.alias("significance"),
                    mag.alias("magnitude"), F.when(right, (sig + mag) / 2.0).otherwise(0.0).alias("score"),
                    "n_controls_passing", F.when(ok, verdict).alias("verdict"), "reason")
