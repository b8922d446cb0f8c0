"""The bucketed running scheme against pandas, with a hot key, heavy ties and nulls."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortia.operators import ordered


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 3000
    return pd.DataFrame({
        "id": range(n), "key": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdefgh"), n)),
        "v": np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(1000, 0.5, n), 2))})


def test_average_ranks_match_pandas(spark, skewed):
    got = ordered.add_rank(spark.createDataFrame(skewed), ["key"], "v", "rk").toPandas().set_index("id")["rk"]
    want = skewed.set_index("id").groupby("key")["v"].rank(method="average")
    assert np.allclose(got.sort_index(), want.sort_index())


def test_quantiles_match_numpy(spark, skewed):
    got = ordered.quantiles(spark.createDataFrame(skewed), ["key"], "v", {"a": 0.05, "m": 0.5, "z": 0.9}).toPandas().set_index("key")
    want = skewed.groupby("key")["v"].quantile([0.05, 0.5, 0.9]).unstack()
    assert np.allclose(got[["a", "m", "z"]].sort_index(), want.sort_index())


def test_running_sum_strict_and_descending(spark, skewed):
    cells = spark.createDataFrame(skewed.groupby(["key", "v"]).size().rename("n").reset_index())
    b = ordered.with_bucket(cells, "v", ordered.bucket_edges(cells, "v", 7))
    r = ordered.running(b, ["key"], ["v"], {"s": ("sum", "n")}, descending=True, strict=True).toPandas()
    for k, g in r.groupby("key"):
        g = g.sort_values("v", ascending=False)
        assert (g["s"].to_numpy() == g["n"].cumsum().to_numpy() - g["n"].to_numpy()).all()


def test_any_edges_give_the_same_result(spark, skewed):
    cells = spark.createDataFrame(skewed.groupby(["key", "v"]).size().rename("n").reset_index())
    outs = [ordered.running(ordered.with_bucket(cells, "v", e), ["key"], ["v"], {"s": ("sum", "n")}).toPandas().sort_values(["key", "v"])["s"].tolist()
            for e in ([], [0.0], [999.9, 1000.0, 1000.1])]
    assert outs[0] == outs[1] == outs[2]


def test_draw_order_is_a_bijection_and_follows_md5(spark):
    import hashlib
    ids = [f"s{i}" for i in range(500)]
    got = ordered.draw_order(spark.createDataFrame([(i,) for i in ids], "id string"), [], 9, ["id"]).toPandas()
    want = sorted(ids, key=lambda i: (hashlib.md5(f"9|{i}".encode()).hexdigest(), i))
    assert got.sort_values("rn")["id"].tolist() == want and sorted(got["rn"]) == list(range(1, 501))


def _bh(p):
    p = np.asarray(p)
    o = np.argsort(p)
    q = p[o] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[o] = np.minimum.accumulate(q[::-1])[::-1]
    return np.minimum(out, 1)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1).map(lambda x: round(x, 2)), min_size=1, max_size=40))
def test_bh_matches_definition_and_is_monotone(spark, ps):
    df = spark.createDataFrame([("f", i, float(p)) for i, p in enumerate(ps)] + [("f", -1, None)], "fam string, i int, p double")
    got = ordered.bh_fdr(df, ["fam"]).toPandas().sort_values("i")
    assert got[got["i"] == -1]["fdr"].isna().all()
    g = got[got["i"] >= 0]
    assert np.allclose(g["fdr"], _bh(ps))
    assert (g.sort_values("p")["fdr"].diff().dropna() >= -1e-12).all()


def test_quantile_bins_are_edge_based(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    got = ordered.quantile_bins(df, [], "v", 4).toPandas()
    want = pd.qcut(pd.Series(range(11), dtype=float), 4, labels=False)
    assert got.dropna().sort_values("v")["bin"].astype(int).tolist() == want.tolist() and got["bin"].isna().sum() == 1


def test_hot_key_is_spread_over_buckets(spark, skewed):
    df = spark.createDataFrame(skewed).where("v > 0")
    b = ordered.with_bucket(df, "v", ordered.bucket_edges(df, "v", 16)).groupBy("key", "_b").count()
    assert b.agg(F.max("count")).first()[0] < 0.2 * df.count()
