"""Readers on small messy files."""

import json

import pytest
from pyspark.sql import functions as F

from cohortia.plans import panels as pn
from cohortia.plans import resources as rs
from cohortia.plans import transcripts as tr
from cohortia.sources import readers as rd
from cohortia.sources import sinks


@pytest.fixture()
def run_dir(tmp_path):
    ep = tmp_path / "run1" / "g2_brca_s1"
    ep.mkdir(parents=True)
    msgs = [
        {"role": "user", "content": "Start. \"quoted\" text"},
        {"role": "assistant", "content": [{"type": "thinking", "thinking": "think"}, {"type": "text", "text": "say"},
                                          {"type": "tool_use", "id": "t1", "name": "run_code", "input": {"code": "# WHY: look\n# Stage 1: QC\nx=1"}},
                                          {"type": "tool_use", "id": "t2", "name": "record_observation", "input": {"current_hypothesis": "h"}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "Error: b"}]},
                                     {"type": "tool_result", "tool_use_id": "t2", "content": "plain"}]},
        {"role": "assistant", "content": [{"type": "tool_use", "id": "t3", "name": "run_code", "input": {"code": "y"}}]}]
    (ep / "g2_brca_s1.json").write_text(json.dumps({"cohort": "BRCA", "messages": msgs, "discovery": {"proposed_grouping": {"s1": "A", "s2": "B"}, "top_genes": ["X"]}, "wall_time_s": 20,
                                                    "run_log": {"usage_log": [{"turn": 0, "input_tokens": 5, "output_tokens": 2}, {"turn": 1, "input_tokens": None}], "timing_log": [{"call_num": 0, "exec_time_s": 1.5, "is_error": True}]}}))
    (ep / "g2_brca_s1_v3scores.json").write_text("{}")
    (ep / "elsewhere.json").write_text("{}")
    (ep / "g2_brca_s1_j1.json").write_text(json.dumps({"identity": "derived", "rigor": ""}))
    return str(tmp_path)


def test_episode_to_calls_and_resources(spark, run_dir):
    e = rd.read_episodes(spark, run_dir)
    assert [(r["episode"], r["run"]) for r in e.collect()] == [("g2_brca_s1", "run1")]
    b = rd.message_blocks(e)
    assert b.where("msg_ix = 0").first()["text"] == "Start. \"quoted\" text"
    c = {r["call_num"]: r for r in tr.trace_calls(b).collect()}
    assert [c[i]["tool"] for i in range(3)] == ["run_code", "record_observation", "run_code"]
    assert c[0]["reasoning"] == "think say" and c[1]["reasoning"] == "" and c[0]["output"] == "a Error: b" and c[2]["output"] == "" and c[0]["input_lines"] == 3
    f = {r["call_num"]: r for r in tr.call_features(tr.trace_calls(b)).collect()}
    assert f[0]["why"] == "look" and f[0]["stage_num"] == 1 and f[0]["stage_label"] == "QC" and f[0]["is_error"] and f[2]["stage_num"] is None
    assert {(r["sample_id"], r["label"]) for r in rd.grouping_table(e).collect()} == {("s1", "A"), ("s2", "B")}
    u, t, w = rd.run_log_tables(e)
    r = rs.summarise_episodes(u, t, w).first()
    assert r["input_tokens"] == 5 and r["n_turns"] == 2 and r["n_turns_with_usage"] == 1 and r["tokens_reported"]
    assert r["api_s"] is None and not r["api_time_measured"] and r["pct_api"] is None and r["exec_s"] == 1.5 and r["n_exec_errors"] == 1


def test_verdicts_and_integrity(spark, run_dir):
    v = rd.read_verdicts(spark, run_dir, "_j1.json", "1")
    dom = spark.createDataFrame([("identity", "recalled")], "field string, value string")
    assert {r["problem"] for r in pn.verdict_problems(v, dom, ["identity", "rigor"]).collect()} == {"missing rigor", "illegal identity=derived"}


def test_zero_episode_audit_fails(spark):
    none = spark.createDataFrame([], "episode string")
    hits = spark.createDataFrame([], "episode string, kind string")
    assert tr.audit_verdict(none, hits).first()["passed"] is False
    some = spark.createDataFrame([("e",)], "episode string")
    assert tr.audit_verdict(some, hits).first()["passed"] is True


def test_audit_exempts_by_design_disclosure(spark):
    t = spark.createDataFrame([("e0", 0, "harness", "this is breast cancer"), ("e2", 0, "harness", "this is breast cancer"), ("e2", 1, "echoed", "CONFIRMING BREAST CANCER"), ("e3", 1, "echoed", "mislead")],
                              "episode string, msg_ix int, author string, text string")
    lab = spark.createDataFrame([(e, f"{a}_brca_s1", a, "brca", None, "s1") for e, a in (("e0", "g0"), ("e2", "g2"), ("e3", "g3a"))], "episode string, label string, arm string, cohort string, planted string, seed string")
    syn = spark.createDataFrame([("brca", "breast")], "cohort string, pattern string")
    got = {(r["episode"], r["kind"], r["n_hits"]) for r in tr.blinding_audit(t, lab, syn).collect()}
    assert got == {("e2", "TRUE COHORT", 1), ("e3", "MISLEAD KEYWORD", 1)}


def test_gmt_skips_short_lines(spark, tmp_path):
    (tmp_path / "hallmark.gmt").write_text("set_a\turl\tG1\tG2\nshort\turl\n")
    assert {(r["collection"], r["set_name"], r["gene"]) for r in rd.read_gmt(spark, str(tmp_path)).collect()} == {("hallmark", "SET_A", "G1"), ("hallmark", "SET_A", "G2")}


def test_manifest_long_files_and_headers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"file_id": "f", "file_name": "a.txt", "cases": [{"submitter_id": "S1"}]}]))
    d = tmp_path / "meth"
    d.mkdir()
    (d / "a.txt").write_text("cg1\t0.5\ncg2\tNA\n")
    m = rd.read_manifest(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in rd.read_long_files(spark, str(d), m, ("cpg_id", "beta")).collect()] == [("S1", "cg1", 0.5)]
    (tmp_path / "ref.gct").write_text("#1.2\n2\t2\nName\tDescription\tT1\nG1\td\t3\n")
    r = rd.read_reference(spark, [str(tmp_path / "none"), str(tmp_path / "ref.gct")], {"gene": ["Name"], "t1": ["T1"]}, skip_until="Name")
    assert [tuple(x) for x in r.collect()] == [("G1", "3")]
    assert rd.read_reference(spark, [str(tmp_path / "none")], {}) is None


def test_peak_genes(spark, tmp_path):
    (tmp_path / "amp.txt").write_text("cytoband\t1q1\t2p2\nq value\t0.1\t0.2\nresidual q value\t0.1\t0.2\nwide peak boundaries\tx\ty\ngenes in wide peak\tG1\tLOC1\n\tG2\t\n")
    got = {(r["kind"], r["peak"], r["gene"]) for r in rd.read_peak_genes(spark, str(tmp_path / "amp.txt"), "amp").collect()}
    assert got == {("amp", "1q1", "G1"), ("amp", "1q1", "G2")}


def test_maf_and_sample_files(spark, tmp_path):
    (tmp_path / "x.maf").write_text("#v\nHugo_Symbol\tVariant_Classification\tTumor_Sample_Barcode\nTP53\tMissense_Mutation\tTCGA-AA-0001-01A\nTP53\tNonsense_Mutation\tTCGA-AA-0001-01B\nKRAS\tSilent\tTCGA-AA-0001-01A\n")
    assert [tuple(r) for r in rd.read_maf(spark, str(tmp_path / "x.maf")).collect()] == [("TCGA-AA-0001", "TP53")]
    d = tmp_path / "expr"
    d.mkdir()
    (d / "s.tsv").write_text("# c\ngene_name\tgene_type\ttpm\nA\tprotein_coding\t1\nA\tprotein_coding\t2\nB\tlncRNA\t9\n")
    m = spark.createDataFrame([("s.tsv", "S1")], "file_name string, sample_id string")
    r = rd.read_sample_files(spark, str(d), m, "tpm", log1p=False).collect()
    assert [tuple(x) for x in r] == [("S1", "A", 3.0)]


def test_cache_is_written_once(spark, tmp_path):
    p = str(tmp_path / "c")
    df = spark.range(3)
    assert sinks.write_cache(df, p) and not sinks.write_cache(df.limit(1), p) and spark.read.parquet(p).count() == 3
    assert sinks.write_cache(df.limit(1), p, force=True) and spark.read.parquet(p).count() == 1
    sinks.write_sealed(df.withColumn("sealed", F.col("id") == 0), str(tmp_path / "pub"), str(tmp_path / "sec"))
    assert spark.read.parquet(str(tmp_path / "pub")).count() == 2 and spark.read.parquet(str(tmp_path / "sec")).count() == 1
