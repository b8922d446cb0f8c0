"""Input shapes derived from the test tables, once for Spark and once as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def expr(spark, d) -> DataFrame:
    """Vectors as an expression matrix in long form."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding"))
    return e.select("sample_id", F.format_string("F%02d", "pos").alias("feature"), F.col("col").cast("double").alias("value"))


EXPR = """expr AS (SELECT sample_id, 'F' || lpad(i::VARCHAR, 2, '0') AS feature, v::DOUBLE AS value FROM (
  SELECT vec_id AS sample_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))"""


def grp(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("label"))


GRP = "grp AS (SELECT vec_id AS sample_id, label::VARCHAR AS label FROM embeddings)"


def counts(spark, d) -> DataFrame:
    """Customer x brand quantities as a count matrix in long form. Pre-aggregated on part before the second join."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("sample_id"), F.col("p_brand").alias("feature"))
            .agg(F.sum("l_quantity").alias("value")))


COUNTS = """counts AS (SELECT o_custkey AS sample_id, p_brand AS feature, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def segment(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("label"))


SEGMENT = "segment AS (SELECT c_custkey AS sample_id, c_mktsegment AS label FROM customer)"


def presence(spark, d, min_qty: float = 60.0) -> DataFrame:
    """Positive calls: customer and brand with a summed quantity above a threshold."""
    return counts(spark, d).where(F.col("value") > min_qty).select("sample_id", F.col("feature").alias("gene"))


PRESENCE = "presence AS (SELECT sample_id, feature AS gene FROM counts WHERE value > 60.0)"


def surv_lines(spark, d) -> DataFrame:
    """One row per order line: duration in days (many <= 0, to be dropped), event, group, covariate."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_discount", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"),
        F.datediff("l_shipdate", "o_orderdate").cast("double").alias("duration"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"), F.col("o_orderpriority").alias("label"),
        F.col("l_discount").alias("x"), F.col("l_quantity").alias("q")).where("duration > 0")


SURV_LINES = """surv_lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS sample_id,
  date_diff('day', o_orderdate, l_shipdate)::DOUBLE AS duration, (l_returnflag = 'R')::INT AS event,
  o_orderpriority AS label, l_discount AS x, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 0)"""


def surv_cust(spark, d) -> DataFrame:
    """One row per customer: follow-up from the mean positive delay, event by the share of returned lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    dd = F.datediff("l_shipdate", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(dd > 0).groupBy(
        F.col("o_custkey").alias("sample_id")).agg(
        F.floor(F.sum(dd) / F.count(F.lit(1))).cast("double").alias("duration"),
        (F.sum((F.col("l_returnflag") == "R").cast("int")) * 3 > F.count(F.lit(1))).cast("int").alias("event"))


SURV_CUST = """surv_cust AS (SELECT o_custkey AS sample_id,
  floor(sum(date_diff('day', o_orderdate, l_shipdate)) / count(*))::DOUBLE AS duration,
  (sum((l_returnflag = 'R')::INT) * 3 > count(*))::INT AS event
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 0 GROUP BY 1)"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
