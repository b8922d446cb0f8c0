"""Readers and sinks as round trips: a file layout is derived from the tables, written to the shared folder, read back."""

import uuid

from pyspark.sql import functions as F

from cohortia.operators import reshape as rs
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import COUNTS, counts, table, with_sql
from cohortia.session import checkpoint_dir
from cohortia.sources import readers as rd
from cohortia.sources import sinks
from cohortia.streaming import runlog


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/derived/{name}_{uuid.uuid4().hex}"


_WIDE = with_sql(COUNTS, body="SELECT sample_id, feature, value FROM (SELECT DISTINCT sample_id FROM counts) CROSS JOIN (SELECT DISTINCT feature FROM counts) LEFT JOIN counts USING (sample_id, feature)")


def _wide(spark, d):
    return rs.pivot(counts(spark, d), ["sample_id"], "feature", "value")


@query("read_matrix", _WIDE)
def matrix(spark, d):
    p = scratch(spark, "matrix")
    sinks.write_cache(_wide(spark, d).withColumnRenamed("sample_id", "case_id"), p)
    assert rd.read_matrix(spark, p + "_absent", "case_id") is None
    return rd.read_matrix(spark, p, "case_id")


@query("read_omics_csv", _WIDE.replace("sample_id, feature, value FROM", "sample_id::VARCHAR AS sample_id, feature, value FROM", 1))
def omics(spark, d):
    p = scratch(spark, "omics")
    w = _wide(spark, d).withColumnRenamed("sample_id", "ModelID")
    flag = F.explode(F.array(F.lit("Yes"), F.lit("No")))
    sinks.write_table(w.select(F.lit(0).alias("ix"), "*", flag.alias("IsDefaultEntryForModel"), F.lit("x").alias("SequencingID")), p, ",")
    return rd.read_omics_csv(spark, p, meta_columns=["SequencingID"])


@query("read_drug_matrix", _WIDE.replace("sample_id, feature, value FROM", "feature AS sample_id, sample_id::VARCHAR AS feature, value FROM", 1))
def drug(spark, d):
    p = scratch(spark, "drug")
    sinks.write_table(_wide(spark, d), p, ",")
    return rd.read_drug_matrix(spark, p + "_absent", p)


@query("read_sample_files", f"""SELECT 'case-' || c_custkey AS sample_id, p_name AS feature, {r('ln(1 + sum(l_quantity))')} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN (SELECT c_custkey % 20 AS c_custkey, c_custkey AS k FROM customer) ON k = o_custkey WHERE p_size % 2 = 0 GROUP BY 1, 2""")
def sample_files(spark, d):
    p = scratch(spark, "files")
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = j.select((F.col("o_custkey") % 20).alias("case"), F.col("p_name").alias("gene_name"), F.when(F.col("p_size") % 2 == 0, "protein_coding").otherwise("lncRNA").alias("gene_type"), F.col("l_quantity").alias("tpm"))
    rows.repartition("case").write.partitionBy("case").option("header", True).option("sep", "\t").csv(p)
    manifest = table(spark, d, "customer").select((F.col("c_custkey") % 20).cast("string").alias("file_name")).distinct().withColumn("sample_id", F.concat(F.lit("case-"), F.col("file_name")))
    return rounded(rd.read_sample_files(spark, p, manifest, "tpm", file_key=r"case=(\d+)/"))


@query("read_clinical", "SELECT c_custkey::VARCHAR AS sample_id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS stage, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name FROM customer")
def clinical(spark, d):
    p = scratch(spark, "clinical")
    c = table(spark, d, "customer")
    sinks.write_table(c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("stage"), F.col("c_name").alias("name")), p)
    return rd.read_clinical(spark, p, c.select(F.col("c_custkey").cast("string").alias("sample_id")), "case_id")


@query("read_cases", "SELECT c_name AS sample_id, c_mktsegment AS gender, NULL::VARCHAR AS race, CASE WHEN c_custkey % 2 = 0 THEN 'Dead' ELSE 'Alive' END AS vital_status, c_acctbal AS days_to_death, CASE WHEN c_custkey % 3 <> 0 THEN 'first' END AS primary_diagnosis, NULL::VARCHAR AS tumor_stage, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END::DOUBLE AS age_at_diagnosis, NULL::DOUBLE AS days_to_last_follow_up FROM customer")
def cases(spark, d):
    p = scratch(spark, "cases")
    dx = F.array(F.struct(F.lit("first").alias("primary_diagnosis"), F.col("c_nationkey").alias("age_at_diagnosis")), F.struct(F.lit("second").alias("primary_diagnosis"), F.lit(99).alias("age_at_diagnosis")))
    c = table(spark, d, "customer").select(F.col("c_name").alias("submitter_id"), F.struct(F.col("c_mktsegment").alias("gender"), F.when(F.col("c_custkey") % 2 == 0, "Dead").otherwise("Alive").alias("vital_status"), F.col("c_acctbal").alias("days_to_death")).alias("demographic"),
                                          F.when(F.col("c_custkey") % 3 != 0, dx).alias("diagnoses"))
    sinks.write_json(c, p)
    return rd.flatten_cases(spark.read.schema(rd.CASE_SCHEMA).json(p))


@query("read_maf", "SELECT DISTINCT substr('TCGA-' || lpad(o_custkey::VARCHAR, 9, '0'), 1, 12) AS sample_id, p_name AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def maf(spark, d):
    p = scratch(spark, "maf")
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cls = F.when(F.col("l_returnflag") == "R", "Missense_Mutation").otherwise("Silent")
    sinks.write_table(j.select(F.col("p_name").alias("Hugo_Symbol"), cls.alias("Variant_Classification"), F.concat(F.lit("TCGA-"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("Tumor_Sample_Barcode")), p)
    return rd.read_maf(spark, p)


@query("read_gene_sets", "SELECT DISTINCT 'SET ' || upper(p_type) AS set_name, p_name AS gene FROM part")
def gmt(spark, d):
    p = scratch(spark, "gmt")
    lines = table(spark, d, "part").select("p_type", "p_name").distinct().groupBy("p_type").agg(F.concat_ws("\t", F.concat(F.lit("set "), F.first("p_type")), F.lit("url"), F.concat_ws("\t", F.collect_list("p_name"))).alias("value"))
    lines.select("value").union(spark.range(1).select(F.lit("short\tline"))).write.text(p)
    return rd.parse_gmt(spark.read.text(p))


@query("read_peak_calls", "SELECT 'amp' AS kind, c_mktsegment AS peak, 'S' || (c_nationkey % 6) AS sample_id, sum((c_acctbal > 5000)::INT)::DOUBLE AS level FROM customer GROUP BY 2, 3")
def peaks(spark, d):
    p = scratch(spark, "peaks")
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("Descriptor"), F.concat(F.lit("S"), (F.col("c_nationkey") % 6).cast("string")).alias("s"), (F.col("c_acctbal") > 5000).cast("int").alias("v"))
    w = rs.pivot(c, ["Descriptor"], "s", "v", "sum")
    u = w.withColumn("Unique Name", F.lit("Amplification Peak 1")).union(w.withColumn("Unique Name", F.lit("Amplification Peak 1 - CN values")))
    sinks.write_table(u, p)
    return rd.read_peak_calls(spark, p)


@query("read_gene_calls", "SELECT p_name AS gene, substr('SAMPLE-00000' || i, 1, 12) AS sample_id, (CASE WHEN (arg_min(p_size, p_partkey) + i) % 5 = 0 THEN NULL ELSE (arg_min(p_size, p_partkey) + i) % 5 - 2 END)::TINYINT AS call FROM part CROSS JOIN range(4) t(i) GROUP BY p_name, i")
def calls(spark, d):
    p = scratch(spark, "calls")
    cols = [F.when((F.col("p_size") + i) % 5 == 0, "NA").otherwise(((F.col("p_size") + i) % 5 - 2).cast("string")).alias(f"SAMPLE-00000{i}-01") for i in range(4)]
    sinks.write_table(table(spark, d, "part").orderBy("p_partkey").coalesce(1).select(F.col("p_name").alias("Hugo_Symbol"), F.lit(1).alias("Entrez_Gene_Id"), *cols), p)
    return rd.read_gene_calls(spark, p)


@query("read_reference_aliases", "SELECT p_name AS gene, p_type AS tissue FROM part")
def reference(spark, d):
    p = scratch(spark, "reference")
    sinks.write_table(table(spark, d, "part").select(F.col("p_name").alias("Gene Symbol"), F.col("p_type").alias("Tissue"), "p_size"), p)
    return rd.read_reference(spark, [p + "_absent", p], {"gene": ["Hugo Symbol", "gene symbol"], "tissue": ["tissue"], "missing": ["nothing"]})


@query("census_scan", "SELECT p_name AS gene, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def census(spark, d):
    p = scratch(spark, "census")
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sinks.write_table(j.select(F.col("p_name").alias("GENE_SYMBOL"), F.col("l_suppkey").alias("COSMIC_SAMPLE_ID"), "l_tax"), p)
    return rd.read_census(spark, p, ["GENE_SYMBOL", "COSMIC_SAMPLE_ID"]).distinct().groupBy(F.col("GENE_SYMBOL").alias("gene")).agg(F.count(F.lit(1)).alias("n"))


@query("write_partitioned_cache", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1")
def cache(spark, d):
    p = scratch(spark, "cache")
    first = sinks.write_cache(table(spark, d, "orders"), p, ["o_orderstatus"])
    second = sinks.write_cache(table(spark, d, "orders").limit(0), p, ["o_orderstatus"])  # skipped: the cache is complete
    assert first and not second
    return rounded(spark.read.parquet(p).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("write_json_rows", "SELECT n_nationkey, n_name FROM nation")
def json_rows(spark, d):
    p = scratch(spark, "json")
    sinks.write_json(table(spark, d, "nation").select("n_nationkey", "n_name"), p)
    return spark.read.schema("n_nationkey int, n_name string").json(p)


@query("resume_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.pending(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


# ---- streams ------------------------------------------------------------------------------------------------------

def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_run_log_rollup", """SELECT start, arm, count(*) AS n, sum(k)::BIGINT AS input_tokens, sum(k * 2)::BIGINT AS output_tokens, round(sum(value), 4) + 0.0 AS exec_s, count(*) FILTER (event_type = 'error') AS n_errors FROM (
 SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, 'g' || (user_id % 3) AS arm, (props::JSON->>'$.k')::BIGINT AS k, value, event_type FROM events) GROUP BY 1, 2""")
def stream_rollup(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")


    def log(e):
        return e.select("ts", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("arm"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.col("value").alias("exec_time_s"), (F.col("event_type") == "error").alias("is_error"))
    closed = runlog.drain(runlog.rollup_stream(log(_event_stream(spark, d))), "rollup", scratch(spark, "stream"))
    return rounded(runlog.with_open_windows(closed, log(table(spark, d, "events"))), 4)


@query("stream_event_gate", "SELECT user_id::VARCHAR AS key, event_id AS seq FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events) WHERE seen >= 3")
def stream_gate(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return runlog.gate_stored(s, "payload = 'purchase'", 3).select("key", "seq")
