"""Networks, text joins, blinding and streams on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from cohortia.functions import text as tx
from cohortia.operators import blinding as bl
from cohortia.operators import network as net
from cohortia.streaming import runlog


@pytest.fixture(scope="module")
def graph(spark):
    # t1 - hub - t2 is short but the hub is dear; t1 - a - b - t2 is the cheap detour; t3 hangs on b
    e = [("t1", "hub"), ("hub", "t2"), ("t1", "a"), ("a", "b"), ("b", "t2"), ("b", "t3")] + [("hub", f"l{i}") for i in range(12)]
    return spark.createDataFrame(e + [("t2", "hub"), ("a", "a")], "src string, dst string")


def test_degree_weights_and_detour(spark, graph):
    w = net.degree_weights(graph)
    d = {(r["u"], r["v"]): r["weight"] for r in w.collect()}
    assert d[("hub", "t1")] == 8.0 and d[("a", "b")] == 2.5 and len(d) == 18
    assert {r["weight"] for r in net.degree_weights(graph, penalty=False).collect()} == {1.0}
    terms = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("absent",)], "node string")
    t = net.steiner_tree(w, terms)
    got = {(r["u"], r["v"]) for r in t.collect()}
    assert got == {("a", "t1"), ("a", "b"), ("b", "t2"), ("b", "t3")}
    s = net.steiner_summary(t, terms, spark.createDataFrame([("t1", 2.0)], "node string, prize double"))
    assert {r["node"]: r["role"] for r in s.collect()} == {"t1": "terminal", "t2": "terminal", "t3": "terminal", "a": "connector", "b": "connector"}


def test_nearest_terminal_distances(spark, graph):
    w = net.degree_weights(graph)
    adj = {}
    for r in w.collect():
        adj.setdefault(r["u"], {})[r["v"]] = r["weight"]
        adj.setdefault(r["v"], {})[r["u"]] = r["weight"]
    dist = {n: 0.0 if n in ("t1", "t3") else float("inf") for n in adj}
    for _ in adj:
        for a, b in itertools.product(adj, adj):
            if b in adj[a]:
                dist[b] = min(dist[b], dist[a] + adj[a][b])
    got = {r["node"]: r["dist"] for r in net.nearest_terminal(w, spark.createDataFrame([("t1",), ("t3",)], "node string")).collect()}
    assert got == pytest.approx(dist)


def test_too_many_terminals_is_refused(spark, graph):
    with pytest.raises(ValueError):
        net.steiner_tree(net.degree_weights(graph), spark.range(5).select(F.col("id").cast("string").alias("node")), max_terminals=3)


def test_containment_is_exact_for_any_length(spark):
    items = ["alpha beta gamma delta", "beta", "gamma delta", "pha beta gam", "x  y z", "absent words here now", "delta epsilon."]
    docs = ["alpha beta gamma delta epsilon.", "x  y z", "x y z", "alphabeta", ""]
    i = spark.createDataFrame(list(enumerate(items)), "item int, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    got = {(r["item"], r["doc"]) for r in tx.contained_in(i, d, "item", "doc").collect()}
    assert got == {(a, b) for a, x in enumerate(items) for b, y in enumerate(docs) if x in y}


def test_token_replacement_keeps_the_rest(spark):
    m = spark.createDataFrame([("GENE_00001", "TP53")], "t string, r string")
    d = spark.createDataFrame([(1, "a GENE_00001, GENE_00002\nGENE_00001"), (2, "none"), (3, None)], "id int, text string")
    got = {r["id"]: r["text"] for r in tx.replace_tokens(d, "id", "text", m, r"GENE_\d{5}", "t", "r").collect()}
    assert got == {1: "a TP53, GENE_00002\nTP53", 2: "none", 3: None}


def test_fenced_reply(spark):
    d = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 2}',), ("broken",)], "s string")
    assert [r[0] for r in d.select(tx.parse_reply(F.col("s"), "a INT")["a"]).collect()] == [1, 2, None]


def test_masking(spark):
    m = spark.createDataFrame([(1, "x", "III", "f", 3.0), (2, "y", "II", "m", 4.0), (3, "x", None, "f", 5.0)], "sample_id int, site string, tumor_stage string, sex string, age double")
    t, book = bl.mask_clinical(m, {"site": True, "age": False})
    assert set(t.columns) == {"sample_id", "CLIN_00", "CLIN_01", "tumor_stage"}
    rows = {r["sample_id"]: r for r in t.collect()}
    assert rows[1]["CLIN_01"] == "CAT_0" and rows[2]["CLIN_01"] == "CAT_1" and rows[1]["tumor_stage"] == "CAT_1" and rows[3]["tumor_stage"] is None and rows[2]["CLIN_00"] == 4.0
    assert {(r["anon"], r["code"], r["value"]) for r in book.collect()} == {("CLIN_00", None, None), ("CLIN_01", "CAT_0", "x"), ("CLIN_01", "CAT_1", "y")}
    t2, b2 = bl.mask_clinical(m, {"site": True}, rename_clinical=False)
    assert "site" in t2.columns and b2.count() == 0


def test_anonymise_is_invertible_and_leak_free(spark):
    e = spark.createDataFrame([(f"P{i}", f"G{j}", 1.0) for i in range(7) for j in range(3)], "sample_id string, feature string, value double")
    v, m = bl.anonymise_samples({"e": e}, e.select("sample_id").limit(21), 1)
    assert m.select("anon").distinct().count() == 7 and v["e"].count() == 21
    assert v["e"].where(~F.col("sample_id").rlike(r"^SAMPLE_\d{4}$")).count() == 0
    g, gm = bl.anonymise_genes({"a": e, "b": e.where("feature = 'G1'")}, 1)
    assert gm.count() == 3 and g["b"].select("feature").distinct().count() == 1


def test_swap_round_robin(spark):
    v = spark.createDataFrame([(i, float(i)) for i in range(10)], "sample_id int, v double")
    g = spark.createDataFrame([(i, "A" if i < 6 else "B" if i < 9 else "C") for i in range(10)], "sample_id int, label string")
    out = {r["sample_id"]: r["v"] for r in bl.swap_between_groups(v, g, "A", "B", 1, ["v"]).collect()}
    assert out[9] == 9.0 and sorted(out[i] for i in range(6)) == [6, 6, 7, 7, 8, 8] and len({out[i] for i in (6, 7, 8)}) == 3 and all(out[i] < 6 for i in (6, 7, 8))


def test_many_nodes_are_not_broadcast(spark):
    # 260,000 node names are a file of a few MB, which Catalyst would broadcast to every task
    chain = spark.range(260_000).selectExpr("concat('n', id) src", "concat('n', id + 1) dst")
    w = net.degree_weights(chain)
    assert "Broadcast" not in w._jdf.queryExecution().executedPlan().toString()
    assert {(r["weight"], r["n"]) for r in w.groupBy("weight").agg(F.count("*").alias("n")).collect()} == {(2.0, 259_998), (1.5, 2)}


def test_amplification_wins(spark):
    c = spark.createDataFrame([("s", "p", "amp", 1.0), ("s", "q", "del", 2.0), ("r", "q", "del", 1.0), ("r", "p", "amp", 0.0)], "sample_id string, peak string, kind string, level double")
    pg = spark.createDataFrame([("amp", "p", "G"), ("del", "q", "G")], "kind string, peak string, gene string")
    assert {(r["sample_id"], r["call"]) for r in bl.cna_from_peaks(c, pg).collect()} == {("s", 1), ("r", -1)}


def test_calls_are_placed_by_sample_before_they_become_genes(spark):
    c = spark.range(4000).selectExpr("id % 50 sample_id", "concat('p', id % 20) peak", "IF(id % 3 = 0, 'amp', 'del') kind", "1.0D level")
    pg = spark.range(2000).selectExpr("IF(id % 2 = 0, 'amp', 'del') kind", "concat('p', id % 20) peak", "concat('g', id % 70) gene")
    got = bl.cna_from_peaks(c, pg)
    want = c.join(pg.distinct(), ["kind", "peak"]).groupBy("sample_id", "gene").agg(F.max((F.col("kind") == "amp").cast("int")).alias("a"))
    assert {tuple(r) for r in got.collect()} == {(r[0], r[1], 1 if r[2] else -1) for r in want.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("gene" not in x for x in moved)


def test_stream_drops_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    schema = "ts timestamp, arm string, input_tokens long, output_tokens long, exec_time_s double, is_error boolean"

    def put(rows):
        spark.createDataFrame([(t, "a", 1, 1, 0.5, False) for t in rows], "ts string, arm string, input_tokens long, output_tokens long, exec_time_s double, is_error boolean").withColumn(
            "ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        return runlog.drain(runlog.rollup_stream(spark.readStream.schema(schema).parquet(str(src))), "r", str(tmp_path))
    put(["2024-01-01 00:10:00", "2024-01-01 06:00:00"])
    assert [r["n"] for r in run().collect()] == [1]
    put(["2024-01-01 00:20:00", "2024-01-01 12:00:00"])  # the first is later than the watermark
    assert sorted((r["start"].hour, r["n"]) for r in run().collect()) == [(0, 1), (6, 1)]


def test_stream_gate_keeps_its_counter_between_runs(spark, tmp_path):
    src = tmp_path / "in"
    schema = "key string, ts timestamp, seq long, payload string"

    def put(rows):
        spark.createDataFrame([("k", "2024-01-01 00:00:00", s, p) for s, p in rows], "key string, ts string, seq long, payload string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        return runlog.drain(runlog.gate_stream(spark.readStream.schema(schema).parquet(str(src)), "payload = 'x'", 2), "g", str(tmp_path))
    put([(1, "x"), (2, "y")])
    assert run().count() == 0
    put([(3, "x"), (4, "y")])
    assert sorted(r["seq"] for r in run().collect()) == [3, 4]


def test_stream_gate_sorts_a_key_over_several_arrow_batches(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(40_000).select(F.lit("k").alias("key"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("ts"), (40_000 - F.col("id")).alias("seq"), F.lit("x").alias("payload"))
    rows.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    got = runlog.drain(runlog.gate_stream(stream, "payload = 'x'", 39_990), "g", str(tmp_path))
    assert sorted(r["seq"] for r in got.collect()) == list(range(39_990, 40_001))


def test_stored_gate_deals_a_hot_key_over_buckets(spark, tmp_path, monkeypatch):
    """A key with all rows, a null key and null sequence numbers; the query takes this route and no stream."""
    rows = [("k", (i * 7919) % 5000, "x" if i % 3 else "y") for i in range(5000)] + [(None, i, "x") for i in range(4)] + [("s", None, "x"), ("s", 1, "x"), ("s", 2, "y")]
    df = spark.createDataFrame(rows, "key string, seq long, payload string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    df.repartition(7).write.parquet(str(tmp_path / "log"))
    got = {(r["key"], r["seq"]) for r in runlog.gate_stored(spark.read.parquet(str(tmp_path / "log")), "payload = 'x'", 2).collect()}
    k = sorted((s, p) for key, s, p in rows if key == "k")
    second = [s for s, p in k if p == "x"][1]
    assert got == {("k", s) for s, _ in k if s >= second} | {(None, i) for i in range(1, 4)} | {("s", None)}
    monkeypatch.delattr(runlog, "gate_stream")
    from __spark_entry__ import queries
    assert queries()["stream_event_gate"](spark, "/root/testdata/sf0.001").count() > 0


def test_backfill_keeps_the_open_windows(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(f"2024-01-01 {t}:00", "a", 1, 2, 0.5, False) for t in ("00:10", "06:00", "06:30", "07:00")],
                                 "ts string, arm string, input_tokens long, output_tokens long, exec_time_s double, is_error boolean").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(src))
    closed = runlog.drain(runlog.rollup_stream(spark.readStream.schema(rows.schema).parquet(str(src))), "r", str(tmp_path))
    assert closed.count() == 1
    got = runlog.with_open_windows(closed, spark.read.parquet(str(src)))
    assert sorted((r["start"].hour, r["n"]) for r in got.collect()) == [(0, 1), (6, 2), (7, 1)]
