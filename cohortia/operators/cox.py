"""Batched Cox regression: thousands of models (genes, replicates, folds) fitted in the same few Spark jobs.

Rows are collapsed to weighted cells and hash-placed once by (model, time bucket). Each Newton step reads those cells,
computes risk-set sums by the bucketed running scheme of ``ordered`` (so no model has to fit one task), and reduces
them to one score vector and information matrix per model. Only the small coefficient table is rewritten per step.
Ties use Efron's rule, with its inner sum in closed form so that a heavily tied day costs one expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.tails import norm_sf2
from cohortia.operators.ordered import bucket_edges, running, with_bucket
from cohortia.session import co_locate, cut_lineage


def _tie_sums(b: Column, d: Column) -> tuple[Column, Column]:
    """sum over l < d of 1/(b - l) and of its square.

    Up to 16 ties are added up directly; beyond that the first 8 terms are explicit and the rest is a difference of
    digamma / trigamma asymptotic series written so that nothing cancels.
    """
    y = F.greatest(b - d + 1.0, F.lit(1.0))
    x = y + d
    y8 = y + 8.0
    seq = F.sequence(F.lit(0), F.least(d, F.lit(16)).cast("int") - 1)
    d1 = F.aggregate(seq, F.lit(0.0), lambda a, l: a + 1.0 / (y + l))
    d2 = F.aggregate(seq, F.lit(0.0), lambda a, l: a + 1.0 / ((y + l) * (y + l)))
    h1 = sum((1.0 / (y + j) for j in range(8)), F.lit(0.0))
    h2 = sum((1.0 / ((y + j) * (y + j)) for j in range(8)), F.lit(0.0))
    p = F.pow

    def low(z):
        return -1.0 / (12 * p(z, 2)) + 1.0 / (120 * p(z, 4)) - 1.0 / (252 * p(z, 6)) + 1.0 / (240 * p(z, 8))

    def low2(z):
        return 1.0 / (2 * p(z, 2)) + 1.0 / (6 * p(z, 3)) - 1.0 / (30 * p(z, 5)) + 1.0 / (42 * p(z, 7)) - 1.0 / (30 * p(z, 9))

    gap = x - y8
    h1 = h1 + F.log1p(gap / y8) + gap / (2 * x * y8) + low(x) - low(y8)
    h2 = h2 + gap / (x * y8) + low2(y8) - low2(x)
    return F.when(d <= 16, d1).otherwise(h1), F.when(d <= 16, d2).otherwise(h2)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(u: pd.Series, info: pd.Series) -> pd.Series:
    """Newton step information^-1 * score, or null for a singular matrix."""
    out = []
    for a, b in zip(u, info):
        a = np.asarray(a, dtype=float)
        m = np.asarray(b, dtype=float).reshape(len(a), len(a))
        try:
            s = np.linalg.solve(m, a)
            out.append(s.tolist() if np.all(np.isfinite(s)) else None)
        except np.linalg.LinAlgError:
            out.append(None)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _std_errors(info: pd.Series) -> pd.Series:
    out = []
    for b in info:
        k = int(round(np.sqrt(len(b))))
        try:
            out.append(np.sqrt(np.diag(np.linalg.inv(np.asarray(b, dtype=float).reshape(k, k)))).tolist())
        except np.linalg.LinAlgError:
            out.append(None)
    return pd.Series(out)


def cox_fit(data: DataFrame, by: Sequence[str], covs: Sequence[str], max_iter: int = 25, tol: float = 1e-6,
            min_n: int = 10, min_events: int = 5, efron: bool = True) -> DataFrame:
    """Cox partial-likelihood fits, one per ``by`` key, with the same covariate names in each.

    ``data``: by..., duration, event, covs... (rows with a null covariate are dropped). Returns per key: n, events,
    coef[], se[], p[], iterations, status (``ok`` or ``fit_failed``). Keys below the size guards are not returned.
    Runs a handful of eager jobs; only scalars reach the driver.
    """
    covs, p = list(covs), len(covs)
    keyed = data if by else data.withColumn("_g", F.lit(0))
    by_ = list(by) or ["_g"]
    ok = keyed.where(" AND ".join(f"{c} IS NOT NULL" for c in ["duration", "event", *covs]))
    cells = cut_lineage(ok.groupBy(*by_, "duration", "event", *covs).agg(F.count(F.lit(1)).alias("n")))
    sizes = cells.groupBy(*by_).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("event")).alias("events"),
                                    *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(covs)],
                                    *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(covs)])
    usable = (F.col("n") >= min_n) & (F.col("events") >= min_events)
    for i in range(p):
        usable = usable & (F.col(f"_lo{i}") < F.col(f"_hi{i}"))
    fit_keys = cut_lineage(sizes.where(usable).select(*by_, "n", "events"))
    placed = with_bucket(cells, "duration", bucket_edges(cells.where("event = 1"), "duration"))
    placed = placed.join(fit_keys.select(*by_), by_, "left_semi").select(
        *by_, "_b", "duration", "event", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covs)], "n")
    placed, table = co_locate(placed, [*by_, "_b"])
    spread = cut_lineage(placed.select(*by_, "_b").distinct())  # coefficients go to the buckets of their model, by the join AQE picks
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    zero = F.array(*[F.lit(0.0)] * p)
    beta = fit_keys.select(*by_, zero.alias("beta"), F.lit(1.0).alias("move"), F.lit(True).alias("alive"))

    # every expression below names columns only, so it is built once and reused by all Newton steps
    eta = sum((F.col("beta")[i] * F.col(f"x{i}") for i in range(p)), F.lit(0.0))
    w, ev, d = F.col("w"), F.col("event").cast("double"), F.col("d")

    def moments(weight: Column, tag: str) -> dict[str, Column]:
        return ({f"{tag}0": weight} | {f"{tag}{i + 1}": weight * F.col(f"x{i}") for i in range(p)}
                | {f"{tag}q{i}_{j}": weight * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs})

    terms = moments(w, "s") | moments(w * ev, "e") | {"d": F.col("n") * ev}
    terms |= {f"dx{i}": F.col("n") * ev * F.col(f"x{i}") for i in range(p)}
    row_terms = [v.alias(k) for k, v in terms.items()]
    cell_aggs = [F.sum(k).alias(k) for k in terms]
    s_cols = ["s0", *[f"s{i + 1}" for i in range(p)], *[f"sq{i}_{j}" for i, j in pairs]]
    bb = F.col("Rs0") / (F.col("e0") / d)
    if efron:
        def c(name: str) -> Column:
            return F.col(name) / d

        t1, t2 = _tie_sums(F.col("_bb"), d)
        ties = [t1.alias("_h1"), t2.alias("_h2")]
        h1, h2 = F.col("_h1"), F.col("_h2")
        a = [c(f"e{i + 1}") / c("e0") for i in range(p)]
        m = [(F.col(f"Rs{i + 1}") - c(f"e{i + 1}") * F.col("_bb")) / c("e0") for i in range(p)]
        u = [F.sum(F.col(f"dx{i}") - (d * a[i] + m[i] * h1)) for i in range(p)]
        inf = {(i, j): F.sum(d * c(f"eq{i}_{j}") / c("e0") + (F.col(f"Rsq{i}_{j}") - c(f"eq{i}_{j}") * F.col("_bb")) / c("e0") * h1
                             - (d * a[i] * a[j] + (a[i] * m[j] + a[j] * m[i]) * h1 + m[i] * m[j] * h2)) for i, j in pairs}
    else:
        ties = []
        mu = [F.col(f"Rs{i + 1}") / F.col("Rs0") for i in range(p)]
        u = [F.sum(F.col(f"dx{i}") - d * mu[i]) for i in range(p)]
        inf = {(i, j): F.sum(d * (F.col(f"Rsq{i}_{j}") / F.col("Rs0") - mu[i] * mu[j])) for i, j in pairs}
    full = F.array(*[inf[min(i, j), max(i, j)] for i in range(p) for j in range(p)])
    fit_aggs = [F.array(*u).alias("u"), full.alias("info")]

    def score(b: DataFrame) -> DataFrame:
        """U and I at the current coefficients, per key. The bucketed rows are neither shuffled nor sorted by key."""
        b = b.select(*by_, "beta")
        rows = placed.join(spread.join(b, by_), [*by_, "_b"])
        rows = rows.select("*", (F.col("n") * F.exp(eta)).alias("w")).select(*by_, "_b", "duration", *row_terms)
        t = rows.groupBy(*by_, "_b", "duration").agg(*cell_aggs)
        rs = running(t, by_, ["duration"], {f"R{c}": ("sum", c) for c in s_cols}, descending=True, totals_from=rows).where("d > 0")
        if efron:
            rs = rs.select("*", bb.alias("_bb")).select("*", *ties)
        return rs.groupBy(*by_).agg(*fit_aggs)

    step = _solve("u", "info") if p > 1 else F.when(
        F.col("info")[0] > 1e-12, F.array(F.col("u")[0] / F.col("info")[0]))
    info_state = None
    size = F.aggregate(F.transform("_s", F.abs), F.lit(0.0), lambda a, v: F.greatest(a, v))
    shrink = F.least(F.lit(1.0), F.lit(1.0) / F.greatest(size, F.lit(1e-300)))  # at most one unit per step
    good = F.col("_s").isNotNull() & ~F.isnan(size)
    moved = F.transform(F.arrays_zip("beta", "_s"), lambda z: z["beta"] + z["_s"] * shrink)
    state = [*by_, F.when(good, moved).otherwise(F.col("beta")).alias("beta"),
             F.when(good, size).otherwise(F.lit(0.0)).alias("move"), (good & F.col("alive")).alias("alive"), "info"]
    for it in range(1, max_iter + 1):
        nxt = beta.join(score(beta), by_).select("*", step.alias("_s")).select(*state)
        info_state = cut_lineage(nxt)
        beta = info_state.select(*by_, "beta", "move", "alive")
        if it >= 2:
            worst = info_state.agg(F.max("move")).first()[0]
            if worst is None or worst < tol:
                break
    data.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    fin = info_state.join(fit_keys, by_)
    ses = _std_errors("info") if p > 1 else F.array(1.0 / F.sqrt(F.col("info")[0]))
    big = F.aggregate(F.transform("beta", F.abs), F.lit(0.0), lambda a, v: F.greatest(a, v))
    status = F.when(F.col("alive") & (F.col("move") < 1e-4) & (big < 20), "ok").otherwise("fit_failed")
    out = fin.select(*by_, "n", "events", F.col("beta").alias("coef"), ses.alias("se"), F.lit(it).alias("iterations"),
                     status.alias("status"))
    return out if by else out.drop("_g")


def cox_univariate(data: DataFrame, by: Sequence[str], x: str = "x", scale: str | None = "pop",
                   min_n: int = 10, min_events: int = 5, **kw) -> DataFrame:
    """One-covariate Cox per key: hr, coef, p, n, events, status.

    ``scale``: z-score with the population ('pop') or sample ('sample') sd; a two-valued covariate is left unscaled.
    """
    ok = data.where(f"{x} IS NOT NULL AND duration IS NOT NULL AND event IS NOT NULL").select(
        *by, "duration", "event", F.col(x).cast("double").alias("_x"))
    if scale:
        ok = cut_lineage(ok)
        sd = F.stddev_pop("_x") if scale == "pop" else F.stddev("_x")
        st = ok.groupBy(*by).agg(F.avg("_x").alias("_m"), sd.alias("_sd"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        # a covariate is binary when everything sits on its minimum or maximum
        j = ok.join(st, list(by)) if by else ok.join(F.broadcast(st), on=F.lit(True))
        inner = j.groupBy(*by).agg(F.max((F.col("_x") != F.col("_lo")) & (F.col("_x") != F.col("_hi"))).alias("_many"))
        st = st.join(inner, list(by)) if by else st.join(F.broadcast(inner), on=F.lit(True))
        ok = ok.join(st, list(by)) if by else ok.join(F.broadcast(st), on=F.lit(True))
        always = F.lit(scale == "sample")
        ok = ok.where("_sd > 0").select(*by, "duration", "event", F.when(
            F.col("_many") | always, (F.col("_x") - F.col("_m")) / F.col("_sd")).otherwise(F.col("_x")).alias("_x"))
    f = cox_fit(ok, by, ["_x"], min_n=min_n, min_events=min_events, **kw)
    return f.select(*by, F.col("coef")[0].alias("coef"), F.exp(F.col("coef")[0]).alias("hr"), F.col("se")[0].alias("se"),
                    "n", "events", "status").withColumn("p", norm_sf2(F.col("coef") / F.col("se")))
