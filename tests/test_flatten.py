"""Flattening of targets, row by row."""

from cohortia.plans import targets as tg
from cohortia.queries import q_targets


def test_flattening_never_collects_a_gene(spark, tmp_path, capsys):
    part = spark.range(40).selectExpr("id AS p_partkey", "'n' || id AS p_name", "CASE WHEN id % 4 > 0 THEN 'B' || id % 4 END AS p_brand", "'T' AS p_type",
                                      "CAST(id % 10 AS INT) AS p_size", "CAST(990 + id AS DOUBLE) AS p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    for q in (q_targets.flat_tract, q_targets.flat_drugs):
        q(spark, str(tmp_path)).explain()
        assert "collect_list" not in capsys.readouterr().out
    flat = q_targets.flat_tract(spark, str(tmp_path)).collect()
    assert len(flat) == 40 and sum(r["gene_symbol"] is None for r in flat) == 10 and any(r["has_approved_drug"] for r in flat if r["gene_symbol"] is None)


def test_drug_rows_keep_a_disease_once_per_row(spark):
    kind = "gene_symbol string, rows array<struct<drug_id:string,drug_name:string,stage:string,diseases array<struct<id:string,name:string>>>>".replace("diseases array", "diseases:array")
    dz = [("d1", "x"), ("d1", "y"), ("", "z"), (None, "z"), ("d2", None)]
    t = spark.createDataFrame([("g", [("a", "A", "PHASE_2", dz), ("a", "A", "PHASE_2", dz[:1]), ("b", "B", None, []), ("c", "C", "APPROVAL", None)])], kind)
    got = sorted((r["drug_id"], r["disease_id"], r["disease_name"], r["max_phase_num"]) for r in tg.flatten_drugs(t).collect())
    assert got == [("a", "", "z", 2), ("a", "d1", "x", 2), ("a", "d1", "x", 2), ("a", "d2", "", 2), ("b", "", "", 0), ("c", "", "", 4)]
