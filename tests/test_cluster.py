"""Clustering, agreement and fusion: planted signal, invariants, NumPy references."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import cluster as cl
from cohortia.operators import fusion


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(2)
    g = np.repeat([0, 1, 2], 20)
    x = rng.normal(size=(60, 12))
    x[:, :4] += 6 * np.eye(3)[g] @ rng.normal(size=(3, 4))
    return x, g


def _vec(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id int, vec array<double>")


def _grp(spark, g):
    return spark.createDataFrame([(i, f"g{v}") for i, v in enumerate(g)], "sample_id int, label string")


def test_ari_and_nmi_invariants(spark):
    a = [i % 3 for i in range(60)]
    df = spark.createDataFrame([(v, (v + 1) % 3, (i * 7) % 4) for i, v in enumerate(a)], "a int, perm int, other int")
    assert cl.adjusted_rand(df, "a", "perm").first()["ari"] == pytest.approx(1) and cl.normalised_mutual_info(df, "a", "perm").first()["nmi"] == pytest.approx(1)
    assert abs(cl.adjusted_rand(df, "a", "other").first()["ari"]) < 0.1
    one = df.withColumn("c", F.lit(1))
    assert cl.adjusted_rand(one, "c", "c").first()["ari"] == 1.0 and cl.normalised_mutual_info(one, "c", "c").first()["nmi"] == 1.0


def test_silhouette_matches_brute_force_over_blocks(spark, planted):
    x, g = planted
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(60):
        a = d[i, (g == g[i]) & (np.arange(60) != i)].mean()
        b = min(d[i, g == k].mean() for k in set(g) - {g[i]})
        s.append((b - a) / max(a, b))
    got = cl.silhouette_samples(_vec(spark, x).join(_grp(spark, g), "sample_id"), block=13).toPandas().set_index("sample_id")["s"].sort_index()
    assert np.allclose(got, s, atol=1e-9) and got.between(-1, 1).all()


def test_silhouettes_of_several_labelings_from_one_pass(spark, planted, monkeypatch):
    """Also a label that nobody has, a label of one sample, and a single label."""
    x, g = planted
    labels = np.stack([g, np.arange(60) % 2, np.where(np.arange(60) == 7, 1, 0), np.zeros(60, int)], axis=1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for lab in labels.T:
        s = []
        for i in range(60):
            mine = (lab == lab[i]) & (np.arange(60) != i)
            rest = [d[i, lab == k].mean() for k in set(lab) - {lab[i]}]
            s.append((min(rest) - d[i, mine].mean()) / max(min(rest), d[i, mine].mean()) if mine.any() and rest else 0.0)
        want.append(np.mean(s))
    df = spark.createDataFrame([(i, [int(a) for a in lab], [float(a) for a in r]) for i, (lab, r) in enumerate(zip(labels, x))], "sample_id int, labels array<int>, vec array<double>")
    got = {r["ix"]: (r["silhouette"], r["n"]) for r in cl.silhouettes(df, [4, 2, 2, 1], block=13).collect()}
    assert [got[i][1] for i in range(4)] == [60] * 4 and np.allclose([got[i][0] for i in range(4)], want, atol=1e-9)


def test_k_scan_computes_distances_once(spark, planted, monkeypatch):
    x, _ = planted
    passes, real = [], cl.silhouettes
    monkeypatch.setattr(cl, "silhouettes", lambda *a, **k: (passes.append(1), real(*a, **k))[1])
    monkeypatch.setattr(cl, "_all_pairs", lambda *a, **k: pytest.fail("a pass of all pairs for one k"))
    v = _vec(spark, x)
    got = {r["k"]: r for r in cl.k_scan(v, [2, 3]).collect()}
    assert passes == [1] and sorted(got) == [2, 3] and got[3]["min_size"] == 20 and got[3]["eligible"]
    monkeypatch.undo()
    for k in (2, 3):
        lab = cl.kmeans(v, k).withColumnRenamed("cluster", "label").join(v, "sample_id")
        assert got[k]["silhouette"] == pytest.approx(cl.silhouette(lab).first()["silhouette"], abs=1e-9)
        assert got[k]["ch"] == pytest.approx(cl.calinski_harabasz(lab).first()["ch"], rel=1e-9)


def test_nearest_neighbours_over_blocks(spark, planted):
    x, _ = planted
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = cl.nearest_neighbours(_vec(spark, x), 4, block=9).toPandas()
    assert {i: set(v["neighbour"]) for i, v in got.groupby("sample_id")} == {i: set(np.argsort(d[i])[:4]) for i in range(60)}


@pytest.mark.parametrize("limit", [4096, 4])
def test_pca_matches_numpy_on_both_routes(spark, planted, limit, monkeypatch):
    monkeypatch.setattr(cl, "DENSE_PCA_LIMIT", limit)
    x, _ = planted
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    sign = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])
    sc, ratio = cl.pca_scores(_vec(spark, x), 3)
    got = np.vstack(sc.toPandas().sort_values("sample_id")["vec"].to_numpy())
    assert np.allclose(got, u[:, :3] * s[:3] * sign, atol=1e-6) and np.allclose(ratio[:3], (s ** 2 / (s ** 2).sum())[:3], atol=1e-6)


def test_kmeans_and_bootstrap_recover_planted_groups(spark, planted):
    x, g = planted
    v, grp = _vec(spark, x), _grp(spark, g)
    assert cl.adjusted_rand(cl.kmeans(v, 3).join(grp, "sample_id"), "label", "cluster").first()["ari"] > 0.9
    b = cl.bootstrap_stability(v, grp, reps=4).toPandas()
    assert len(b) == 4 and (b["n"] == 48).all() and b["ari"].min() > 0.9


def _snf_reference(views, kk, iters=20):
    """Plain NumPy form of the fused affinity (test oracle only)."""
    ws, ps = [], []
    for x in views:
        d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
        np.fill_diagonal(d, np.inf)
        sg = np.sort(d, 1)[:, :kk].mean(1)
        np.fill_diagonal(d, 0)
        w = np.exp(-d / (0.5 * ((sg[:, None] + sg[None]) / 2 + 1e-10)))
        np.fill_diagonal(w, 0)
        w /= w.sum(1, keepdims=True)
        p = np.zeros_like(w)
        for i in range(len(w)):
            t = np.argsort(w[i])[-kk:]
            p[i, t] = w[i, t]
        ws.append(w)
        ps.append(p / p.sum(1, keepdims=True))
    for _ in range(iters):
        new = [ws[i] @ (sum(q for j, q in enumerate(ps) if j != i) / (len(ps) - 1)) @ ws[i].T for i in range(len(ps))]
        ps = [q / q.sum(1, keepdims=True) for q in new]
    return sum(ps) / len(ps)


def test_network_fusion_over_blocks(spark, planted, monkeypatch):
    x, g = planted
    y = np.random.default_rng(8).normal(size=(60, 5))
    y[:, :3] += 4 * np.eye(3)[g]
    caught = {}
    real = fusion._spectral

    def spy(fused, sizes, order, block, k, n, seed):
        caught["m"], caught["o"] = fused.toPandas(), order.toPandas()
        return real(fused, sizes, order, block, k, n, seed)
    monkeypatch.setattr(fusion, "_spectral", spy)
    labels, factors = fusion.network_fusion({"a": _vec(spark, x), "b": _vec(spark, y)}, 3, n_iter=4, block=23)
    o = caught["o"].set_index("ix")["sample_id"].sort_index().to_numpy()
    got = np.zeros((60, 60))
    for r in caught["m"].itertuples():
        c = min(23, 60 - 23 * r.jb)
        b = np.frombuffer(r.data).reshape(-1, c)
        got[23 * r.ib:23 * r.ib + len(b), 23 * r.jb:23 * r.jb + c] = b
    want = _snf_reference([x[o], y[o]], 7, 4)
    assert np.allclose(got, (want + want.T) / 2, atol=1e-10)
    assert cl.adjusted_rand(labels.join(_grp(spark, g), "sample_id"), "label", "cluster").first()["ari"] > 0.9
    assert factors.count() == 60


def test_fusion_of_two_views_stores_no_matrix(spark, monkeypatch):
    rng, n = np.random.default_rng(5), 400
    a, b = rng.normal(size=(n, 40)), rng.normal(size=(n, 50))
    tables = Path(spark.conf.get("spark.checkpoint.dir")) / "tables"
    before, caught = set(tables.glob("*")), {}
    monkeypatch.setattr(fusion, "_spectral", lambda fused, sizes, order, *rest: caught.update(m=fused.toPandas(), o=order.toPandas()))
    fusion.network_fusion({"a": _vec(spark, a), "b": _vec(spark, b)}, 3, n_iter=8, block=100)
    stored = sum(f.stat().st_size for t in set(tables.glob("*")) - before for f in t.glob("*.parquet"))
    assert stored < 8 * 2 * 8 * n * n  # what the iterations alone took as matrices
    o = caught["o"].set_index("ix")["sample_id"].sort_index().to_numpy()
    got = np.block([[np.frombuffer(r.data).reshape(100, 100) for r in g.sort_values("jb").itertuples()] for _, g in caught["m"].groupby("ib")])
    want = _snf_reference([a[o], b[o]], 20, 8)
    assert np.allclose(got, (want + want.T) / 2, atol=1e-12)


def test_fusion_of_two_views_passes_each_pair_once(spark, monkeypatch):
    """Odd number of steps, views of unlike groups: 2 x 5 + 1 multiplications for each width of columns tried, and few columns to the eigenvectors."""
    rng, n = np.random.default_rng(11), 90
    a, b = rng.normal(size=(n, 6)), rng.normal(size=(n, 9))
    a[:, :3] += 5 * np.eye(3)[np.arange(n) % 3]
    b[:, :2] += 4 * np.eye(2)[np.arange(n) // 45]
    caught, steps, pairs = {}, [], []
    step, product = fusion._Chain.step, fusion._Chain._product
    monkeypatch.setattr(fusion._Chain, "step", lambda self, *x, **y: (steps.append(y), step(self, *x, **y))[1])
    monkeypatch.setattr(fusion._Chain, "_product", lambda self, *x: (pairs.append(product(self, *x).count()), product(self, *x))[1])
    monkeypatch.setattr(fusion, "_spectral", lambda fused, sizes, order, *rest: caught.update(f=fused, o=order.toPandas()))
    fusion.network_fusion({"a": _vec(spark, a), "b": _vec(spark, b)}, 3, n_iter=5, block=30)
    assert sum(bool(y) for y in steps) == 1 and (len(steps) - 6) % 5 == 0 and pairs == [9, 9, *[6] * len(steps)]
    o = caught["o"].set_index("ix")["sample_id"].sort_index().to_numpy()
    want = _snf_reference([a[o], b[o]], 9, 5)
    got = np.block([[np.frombuffer(r.data).reshape(30, 30) for r in g.sort_values("jb").itertuples()] for _, g in caught["f"].toPandas().groupby("ib")])
    assert np.allclose(got, (want + want.T) / 2, atol=1e-11)
    y = spark.createDataFrame([(i, bytearray(np.eye(90)[30 * i:30 * i + 30, :2].tobytes())) for i in range(3)], "blk int, data binary")
    times = {r["blk"]: np.frombuffer(r["data"]).reshape(30, 2) for r in caught["f"].times(y, 2).collect()}
    assert np.allclose(np.vstack([times[i] for i in range(3)]), got[:, :2], atol=1e-13)


def test_multimodal_entry_guards(spark, planted):
    e = spark.createDataFrame([(1, "f", 1.0)], "sample_id int, feature string, value double")
    with pytest.raises(ValueError):
        fusion.multimodal_cluster({"expression": e, "cna": None})


def test_sample_vectors_impute_and_constant(spark):
    e = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 5.0), (2, "b", 5.0), (1, "c", 2.0)], "sample_id int, feature string, value double")
    got = {r["sample_id"]: r["vec"] for r in cl.sample_vectors(e).collect()}
    assert got == {1: [-1.0, 0.0, 0.0], 2: [1.0, 0.0, 0.0]}


def test_replicate_kmeans_costs_add_up_over_partitions(spark):
    """Four groups, each in partitions of its own; the first start falls into a worse minimum, the second into the right one."""
    rng = np.random.default_rng(4)
    spots = [(0, 0), (0, 10), (40, 0), (40, 10)]
    rows = [(f"{g}_{i}", [float(a) for a in np.array(c) + rng.normal(0, 0.1, 2)]) for g, c in enumerate(spots) for i in range(20)]
    v = spark.createDataFrame(rows, "sample_id string, vec array<double>").repartitionByRange(4, "sample_id")
    bad, good = ["0_0", "0_1", "1_0", "2_0"], ["0_2", "1_2", "2_2", "3_2"]
    rest = [s for s, _ in rows if s not in bad + good]
    members = spark.createDataFrame([(0, s, i + 1) for i, s in enumerate(bad + good + rest)], "rep int, sample_id string, rn int")
    got = {r["sample_id"]: r["cluster"] for r in cl.replicate_kmeans(v, members, 4, 1, n_init=2).collect()}
    assert len(got) == 80 and len({(s[0], c) for s, c in got.items()}) == 4 == len(set(got.values()))


def test_replicates_over_splits_without_rows(spark):
    rows = [(i, str(i % 2), [float(i % 2) * 9 + i / 100, 1.0]) for i in range(40)]
    x = spark.createDataFrame(rows, "sample_id long, label string, vec array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # most splits of a file then hold no row group
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = cl.bootstrap_stability(x.select("sample_id", "vec"), x.select("sample_id", "label"), reps=3).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r["rep"] for r in got) == [0, 1, 2] and all(r["ari"] == 1.0 for r in got)


def test_copies_are_at_zero_and_ties_go_to_the_smaller_neighbour(spark):
    v = np.random.default_rng(3).normal(size=(3, 16)) * 1e3
    x = _vec(spark, np.repeat(v, 12, axis=0))
    got = cl.nearest_neighbours(x, 4, block=7).toPandas()
    for i, g in got.groupby("sample_id"):
        first = i // 12 * 12
        assert list(g["dist"]) == [0.0] * 4 and set(g["neighbour"]) == set([j for j in range(first, first + 12) if j != i][:4])


def test_all_pairs_move_no_vectors(spark, planted, capsys):
    x, g = planted
    for df in (cl.nearest_neighbours(_vec(spark, x), 4, block=9), cl.silhouette_samples(_vec(spark, x).join(_grp(spark, g), "sample_id"), block=9)):
        df.explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" in plan and "CoGroup" not in plan
