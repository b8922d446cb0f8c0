"""Blinding, labels, splits, swaps and random partitions."""

from pyspark.sql import functions as F

from cohortia.operators import blinding as bl
from cohortia.operators import reshape as rs
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import COUNTS, SEGMENT, SURV_CUST, counts, presence, segment, surv_cust, table, with_sql


def _ids(name, src, col, prefix, width, seed):
    return f"{name} AS (SELECT {col} AS real, '{prefix}' || lpad((row_number() OVER (ORDER BY md5('{seed}|' || {col}), {col}) - 1)::VARCHAR, {width}, '0') AS anon FROM (SELECT DISTINCT {col} FROM {src}))"


@query("anonymise_samples", with_sql(_ids("m", "customer", "c_custkey", "SAMPLE_", 6, 42), body="SELECT anon AS sample_id, feature, value FROM (SELECT o_custkey AS k, o_orderpriority AS feature, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2) JOIN m ON real = k").replace(", 6, '0')", ", greatest(4, length((row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1)::VARCHAR))::INT, '0')"))
def anon_samples(spark, d):
    v = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    views, _ = bl.anonymise_samples({"expression": v}, table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")), 42)
    return views["expression"]


@query("anonymise_genes", with_sql("u AS (SELECT p_name AS g FROM part UNION SELECT p_brand FROM part)", _ids("m", "u", "g", "GENE_", 5, 42), body="SELECT anon AS feature, count(*) AS n FROM (SELECT p_name AS x FROM part UNION ALL SELECT p_brand FROM part) JOIN m ON real = x GROUP BY 1"))
def anon_genes(spark, d):
    p = table(spark, d, "part")
    views, _ = bl.anonymise_genes({"a": p.select(F.col("p_name").alias("feature")), "b": p.select(F.col("p_brand").alias("feature"))}, 42)
    return views["a"].union(views["b"]).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


_CODE = "'CAT_' || (dense_rank() OVER (ORDER BY {c}) - 1)"


def _meta(spark, d):
    n = table(spark, d, "nation")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("tumor_stage"), F.col("n_name").alias("site"),
        F.col("c_acctbal").alias("age"), F.col("c_name").alias("race"))


@query("mask_clinical", f"SELECT c_custkey AS sample_id, {_CODE.format(c='c_mktsegment')} AS tumor_stage, c_acctbal AS \"CLIN_00\", {_CODE.format(c='n_name')} AS \"CLIN_01\" FROM customer JOIN nation ON c_nationkey = n_nationkey")
def mask(spark, d):
    return bl.mask_clinical(_meta(spark, d), {"site": True, "age": False})[0]


@query("clinical_codebook", f"SELECT 'CLIN_01' AS anon, 'site' AS real_name, {_CODE.format(c='n_name')} AS code, n_name AS value FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'CLIN_00', 'age', NULL, NULL")
def codebook(spark, d):
    return bl.mask_clinical(_meta(spark, d), {"site": True, "age": False})[1]


@query("rename_by_map", "SELECT CASE WHEN c_nationkey < 20 THEN 'N_' || c_nationkey ELSE c_nationkey::VARCHAR END AS c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def rename(spark, d):
    m = table(spark, d, "nation").where("n_nationkey < 20").select("n_nationkey", F.concat(F.lit("N_"), F.col("n_nationkey").cast("string")).alias("anon"))
    return rs.rename_by_map(table(spark, d, "customer").select("c_nationkey"), m, "c_nationkey", "n_nationkey", "anon").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("category_labels", """WITH ok AS (SELECT c_nationkey AS k FROM customer GROUP BY 1 HAVING count(*) >= 30), ch AS (SELECT k, row_number() OVER (ORDER BY md5('9|' || k), k) AS rn FROM ok)
 SELECT c_custkey AS sample_id, 'Context_' || chr(64 + rn::INT) AS label FROM customer JOIN ch ON k = c_nationkey WHERE rn <= 3""")
def category(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), "c_nationkey")
    return bl.frequent_category_labels(c, "c_nationkey", 3, 9)


@query("mutation_labels", with_sql(COUNTS, body="SELECT c_custkey AS sample_id, CASE WHEN c_custkey IN (SELECT sample_id FROM counts WHERE feature = 'Brand#7' AND value > 60) THEN 'Context_Mutant' ELSE 'Context_WT' END AS label FROM customer"))
def mutation(spark, d):
    return bl.mutation_labels(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")), presence(spark, d), "Brand#7")


@query("response_tertiles", with_sql(COUNTS, "b AS (SELECT feature FROM counts GROUP BY 1 ORDER BY count(*) DESC, feature LIMIT 1)", "x AS (SELECT * FROM counts SEMI JOIN b USING (feature))",
       "q AS (SELECT quantile_cont(value, 1/3) AS a, quantile_cont(value, 2/3) AS b FROM x)",
       body="SELECT sample_id, feature AS drug, CASE WHEN value <= a THEN 'Context_Sensitive' WHEN value <= b THEN 'Context_Intermediate' ELSE 'Context_Resistant' END AS label FROM x CROSS JOIN q"))
def tertiles(spark, d):
    return bl.response_labels(counts(spark, d))


@query("sealed_split", "SELECT c_custkey AS sample_id, 'Context_' || chr((64 + dense_rank() OVER (ORDER BY c_mktsegment))::INT) AS label, row_number() OVER (ORDER BY md5('13|' || c_custkey), c_custkey) <= greatest(1, floor(count(*) OVER () * 0.2)) AS sealed FROM customer")
def sealed(spark, d):
    return bl.sealed_split(segment(spark, d), 13)


@query("decoy_codebook", "SELECT c_custkey AS sample_id, 'SAMPLE_' || CASE WHEN length((row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR) >= 4 THEN (row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR ELSE lpad((row_number() OVER (ORDER BY c_custkey) - 1)::VARCHAR, 4, '0') END AS decoy FROM customer")
def decoy(spark, d):
    return bl.decoy_codebook(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")))


_SWAP = """g AS (SELECT sample_id, duration, event, label FROM surv_cust JOIN segment USING (sample_id) WHERE label IN ('BUILDING', 'MACHINERY')),
rc AS (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY md5('3|' || label || '|' || sample_id), sample_id) AS i FROM g),
dn AS (SELECT label, duration, event, row_number() OVER (PARTITION BY label ORDER BY md5('4|' || label || '|' || sample_id), sample_id) AS i, count(*) OVER (PARTITION BY label) AS sz FROM g),
sw AS (SELECT rc.sample_id, dn.duration, dn.event FROM rc JOIN dn ON dn.label <> rc.label AND dn.i = (rc.i - 1) % dn.sz + 1
  UNION ALL SELECT sample_id, duration, event FROM surv_cust ANTI JOIN g USING (sample_id))"""


@query("swap_survival", with_sql(SURV_CUST, SEGMENT, _SWAP, body="SELECT * FROM sw"))
def swap(spark, d):
    return bl.swap_between_groups(surv_cust(spark, d), segment(spark, d), "BUILDING", "MACHINERY", 3, ["duration", "event"])


@query("swap_check", with_sql(SURV_CUST, SEGMENT, _SWAP, body=f"SELECT label, {r('avg(b.duration)')} AS mean_before, {r('avg(sw.duration)')} AS mean_after FROM segment JOIN surv_cust b USING (sample_id) JOIN sw USING (sample_id) GROUP BY 1"))
def swap_check(spark, d):
    s, g = surv_cust(spark, d), segment(spark, d)
    return rounded(bl.swap_check(s, bl.swap_between_groups(s, g, "BUILDING", "MACHINERY", 3, ["duration", "event"]), g, "duration"))


@query("random_partitions", """WITH o AS (SELECT rep, s_suppkey AS sample_id, row_number() OVER (PARTITION BY rep ORDER BY md5('2|' || rep || '|' || s_suppkey), s_suppkey) AS rn, [2, 3, 4][(('0x' || substr(md5('2|k|' || rep), 1, 8))::BIGINT % 3) + 1] AS k FROM supplier CROSS JOIN range(6) t(rep))
 SELECT rep::INT AS rep, sample_id, 'Cluster_' || ((rn - 1) % k) AS label FROM o""")
def partitions(spark, d):
    return bl.random_partitions(table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id")), 6, 2)


@query("random_gene_sets", "SELECT rep::INT AS rep, gene FROM (SELECT rep, gene, row_number() OVER (PARTITION BY rep ORDER BY md5('8|' || rep || '|' || gene), gene) AS rn FROM (SELECT DISTINCT p_brand AS gene FROM part) CROSS JOIN range(7) t(rep)) WHERE rn <= 5")
def gene_sets(spark, d):
    return bl.random_gene_sets(table(spark, d, "part").select(F.col("p_brand").alias("gene")), 7, 8, 5)


@query("cna_from_peaks", """WITH ev AS (SELECT o_custkey AS sample_id, p_name AS gene, l_returnflag = 'R' AS amp FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT p_brand, p_name FROM part UNION SELECT 'Brand#1', 'extra') p
  ON p.p_brand = 'Brand#' || (l_partkey % 25 + 1) WHERE l_returnflag IN ('R', 'A') AND l_quantity > 25) SELECT sample_id, gene, CASE WHEN bool_or(amp) THEN 1 ELSE -1 END AS call FROM ev GROUP BY 1, 2""")
def peaks(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "amp").otherwise("del")
    li = table(spark, d, "lineitem").where("l_returnflag IN ('R', 'A')").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    calls = li.select(F.col("o_custkey").alias("sample_id"), F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25 + 1).cast("string")).alias("peak"), kind.alias("kind"), (F.col("l_quantity") - 25).alias("level"))
    pg = table(spark, d, "part").select(F.col("p_brand").alias("peak"), F.col("p_name").alias("gene"), F.explode(F.array(F.lit("amp"), F.lit("del"))).alias("kind"))
    extra = pg.where("peak = 'Brand#1'").select("peak", F.lit("extra").alias("gene"), "kind").distinct()
    return bl.cna_from_peaks(calls, pg, extra)
