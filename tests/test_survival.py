"""Survival operators by hand, by invariants and against a plain NumPy Cox fit."""

import numpy as np
import pandas as pd
import pytest

from cohortia.operators import cox
from cohortia.operators import survival as sv


def brute_cox(t, e, x, iters=60):
    """Efron Cox by direct summation over risk sets (test oracle only)."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    b = np.zeros(x.shape[1])
    for _ in range(iters):
        u, inf = np.zeros_like(b), np.zeros((len(b), len(b)))
        w = np.exp(x @ b)
        for tt in np.unique(t[e == 1]):
            risk, dead = t >= tt, (t == tt) & (e == 1)
            d = dead.sum()
            u += x[dead].sum(0)
            for l in range(d):
                f = l / d
                s0 = w[risk].sum() - f * w[dead].sum()
                s1 = (w[risk, None] * x[risk]).sum(0) - f * (w[dead, None] * x[dead]).sum(0)
                s2 = np.einsum("i,ij,ik->jk", w[risk], x[risk], x[risk]) - f * np.einsum("i,ij,ik->jk", w[dead], x[dead], x[dead])
                u -= s1 / s0
                inf += s2 / s0 - np.outer(s1 / s0, s1 / s0)
        step = np.linalg.solve(inf, u)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b, np.sqrt(np.diag(np.linalg.inv(inf)))


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(3)
    n = 240
    x, z = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    t = np.ceil(rng.exponential(12 * np.exp(-0.6 * x + 0.4 * z)) / 6) * 6  # coarse times: many ties, some above 16 a day
    e = (rng.random(n) < 0.75).astype(int)
    return pd.DataFrame({"sample_id": range(n), "duration": t, "event": e, "x": x, "z": z, "label": rng.choice(["a", "b", "c"], n)})


def test_cox_one_covariate_with_heavy_ties(spark, cohort):
    assert cohort[cohort["event"] == 1].groupby("duration").size().max() > 16
    b, se = brute_cox(cohort["duration"].to_numpy(), cohort["event"].to_numpy(), cohort[["x"]].to_numpy())
    r = cox.cox_fit(spark.createDataFrame(cohort), [], ["x"]).first()
    assert r["status"] == "ok" and r["coef"][0] == pytest.approx(b[0], abs=1e-6) and r["se"][0] == pytest.approx(se[0], abs=1e-5)


def test_cox_two_covariates_batched(spark, cohort):
    both = pd.concat([cohort.assign(k="one"), cohort[cohort["label"] != "c"].assign(k="two"), cohort.head(5).assign(k="tiny")])
    r = {x["k"]: x for x in cox.cox_fit(spark.createDataFrame(both), ["k"], ["x", "z"]).collect()}
    assert "tiny" not in r  # below the size guard
    for k, g in both[both["k"] != "tiny"].groupby("k"):
        b, se = brute_cox(g["duration"].to_numpy(), g["event"].to_numpy(), g[["x", "z"]].to_numpy())
        assert np.allclose(r[k]["coef"], b, atol=1e-6) and np.allclose(r[k]["se"], se, atol=1e-5)


def test_cox_separable_data_fails_loudly(spark):
    d = pd.DataFrame({"duration": np.arange(1.0, 41), "event": 1, "x": (np.arange(40) < 20).astype(float)})
    r = cox.cox_fit(spark.createDataFrame(d), [], ["x"]).first()
    assert r["status"] == "fit_failed"


def test_group_cox_reference_is_worst_median(spark, cohort):
    r = sv.group_cox(spark.createDataFrame(cohort)).toPandas().set_index("label")
    worst = cohort.groupby("label")["duration"].median().idxmin()
    assert (r["worst"] == worst).all() and r.loc[worst, "log_hr"] == 0
    others = [g for g in "abc" if g != worst]
    x = np.stack([(cohort["label"] == g).to_numpy(float) for g in others], 1)
    b, _ = brute_cox(cohort["duration"].to_numpy(), cohort["event"].to_numpy(), x)
    assert np.allclose(r.loc[others, "log_hr"], b, atol=1e-6)


def test_kaplan_meier_by_hand(spark):
    d = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 0), ("g", 2.0, 1), ("g", 3.0, 1), ("h", 5.0, 0)], "label string, duration double, event int")
    r = {(x["label"], x["duration"]): x["survival"] for x in sv.kaplan_meier(d, ["label"]).collect()}
    assert r[("g", 1.0)] == pytest.approx(0.75) and r[("g", 2.0)] == pytest.approx(0.5) and r[("g", 3.0)] == 0 and r[("h", 5.0)] == 1


def test_logrank_identical_groups_is_zero_and_matches_pinv(spark, cohort):
    same = pd.concat([cohort.assign(label="p"), cohort.assign(label="q")])
    assert sv.logrank(spark.createDataFrame(same)).first()["chi2"] == pytest.approx(0, abs=1e-9)
    t, e, g = (cohort[c].to_numpy() for c in ("duration", "event", "label"))
    z, v = np.zeros(3), np.zeros((3, 3))
    for tt in np.unique(t[e == 1]):
        n = np.array([((t >= tt) & (g == k)).sum() for k in "abc"], float)
        d = np.array([((t == tt) & (e == 1) & (g == k)).sum() for k in "abc"], float)
        N, D = n.sum(), d.sum()
        z += d - D * n / N
        if N > 1:
            v += D * (N - D) / (N - 1) * (np.diag(n / N) - np.outer(n, n) / N ** 2)
    r = sv.logrank(spark.createDataFrame(cohort)).first()
    assert r["df"] == 2 and r["chi2"] == pytest.approx(z[:2] @ np.linalg.inv(v[:2, :2]) @ z[:2], rel=1e-9)


def test_concordance_matches_pair_enumeration(spark, cohort):
    c = cohort.head(80)
    m = c["label"].map(c.groupby("label")["duration"].median()).to_numpy()
    t, e = c["duration"].to_numpy(), c["event"].to_numpy()
    num = den = 0.0
    for i in range(80):
        for j in range(80):
            if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                den += 1
                num += 1.0 if m[j] > m[i] else 0.5 if m[j] == m[i] else 0.0
    assert sv.concordance(spark.createDataFrame(c)).first()["c_index"] == pytest.approx(num / den)


def test_concordance_reads_its_rows_once(spark, cohort):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = spark.createDataFrame(cohort.head(80)).select("label", "duration", "event")
    assert sv.concordance(df.mapInPandas(note, df.schema)).count() == 1 and seen.value == 80


def test_survival_table_rules(spark):
    rows = [("a", "Dead", "10", None), ("b", "deceased (x)", "bad", "5"), ("c", "Alive", "3", "7"), ("d", None, None, "0"), ("e", "alive", None, "NaN"), ("f", "alive", None, "-2")]
    got = {r["sample_id"]: (r["duration"], r["event"]) for r in sv.survival_table(spark.createDataFrame(rows, "sample_id string, vital_status string, days_to_death string, days_to_last_follow_up string")).collect()}
    assert got == {"a": (10.0, 1), "c": (7.0, 0)}


def test_signature_and_replication(spark):
    rng = np.random.default_rng(5)
    n = 160
    risk = rng.normal(size=(n, 3))
    t = np.ceil(rng.exponential(100 * np.exp(-1.0 * risk.mean(1))))
    rows = [(i, f"G{j}", float(risk[i, j])) for i in range(n) for j in range(3)]
    e = spark.createDataFrame(rows, "sample_id int, feature string, value double")
    s = spark.createDataFrame([(i, float(t[i]), 1) for i in range(n)], "sample_id int, duration double, event int")
    a, b = "sample_id < 80", "sample_id >= 80"
    genes = e.select("feature").distinct()
    r = sv.survival_replication(e.where(a), s.where(a), e.where(b), s.where(b), genes, [("c", ["G0"], "adv")]).first()
    assert r["n_risk"] == 3 and r["direction_ok"] and r["hr"] < 1 and r["verdict"] == "replicates" and 0 < r["score"] <= 1
    assert r["reason"] is None
    few = sv.survival_replication(e.where(a), s.where(a), e.where(b), s.where("sample_id >= 150"), genes, [("c", ["G0"], "adv")]).collect()
    assert [(x["score"], x["verdict"], x["hr"], x["reason"]) for x in few] == [(0.0, None, None, "only 10 samples with expression and survival")]
    one = sv.survival_replication(e.where(a), s.where(a), e.where(b), s.where(b), genes.where("feature = 'G1'"), [("c", ["G0"], "adv")]).collect()
    assert [(x["score"], x["n_risk"], x["reason"]) for x in one] == [(0.0, 1, "only 1 genes with a direction and external expression")]
    d = sv.directions(e, s)
    assert {x["direction"] for x in d.collect()} == {-1}
    assert sv.signature(e, d).count() == n


def test_folds_are_balanced_and_complete(spark):
    f = sv.folds(spark.range(103).withColumnRenamed("id", "sample_id"), 5, 1).toPandas()
    assert f["sample_id"].nunique() == 103 and set(f.groupby("fold").size()) == {20, 21}


def test_bootstrap_has_the_cohort_size_in_each_replicate(spark):
    b = sv.bootstrap_weights(spark.range(50).withColumnRenamed("id", "sample_id"), 3, 1).groupBy("rep").count().collect()
    assert {r["count"] for r in b} == {50}


def test_cohort_inputs_are_computed_once(spark, tmp_path):
    """Both cohorts of the replication read stored tables, not the joins behind them."""
    from cohortia.queries import q_survival as q
    days = "make_timestamp(2020, 1, 1, 0, 0, 0) + make_dt_interval(CAST({} AS INT))"
    spark.range(60).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey", days.format("0") + " AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(60).selectExpr("id AS l_orderkey", "id % 4 AS l_partkey", "CAST(id AS DOUBLE) AS l_quantity", days.format("1 + id") + " AS l_shipdate",
                               "IF(id % 3 = 0, 'R', 'N') AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4).selectExpr("id AS p_partkey", "'B' || id AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    for df in q._two_cohorts(spark, str(tmp_path)):
        assert df.count() > 0 and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
