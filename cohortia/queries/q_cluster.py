"""Clustering and its indices over the vectors."""

from pyspark.sql import functions as F

from cohortia.operators import cluster as cl
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import COUNTS, EXPR, GRP, SEGMENT, counts, expr, grp, segment, table, with_sql


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


_TWO = "two AS (SELECT c_custkey, c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'N' || (c_nationkey % 4) END AS b FROM customer)"


def _two(spark, d):
    b = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("N"), (F.col("c_nationkey") % 4).cast("string")))
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), b.alias("b"), F.col("c_nationkey").alias("g"))


@query("adjusted_rand_index", with_sql(_TWO, "c AS (SELECT a, b, count(*) AS n FROM two GROUP BY 1, 2)", "s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb, (SELECT sum(n) FROM c) AS n)",
       body=f"SELECT n::BIGINT AS n, {r('(ab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))')} AS ari FROM s"))
def ari(spark, d):
    return rounded(cl.adjusted_rand(_two(spark, d), "a", "b"))




def _entropy(name, cols, src):
    return f"{name} AS (SELECT k, -sum(x / n * ln(x / n)) AS h FROM (SELECT k, {cols}, sum(c) AS x, any_value(n) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY k) AS n FROM {src}) GROUP BY ALL) GROUP BY 1)"


def nmi_sql(src):
    """src(k, a, b) -> table nm(k, n, nmi)."""
    return [f"cc AS (SELECT k, a, b, count(*)::DOUBLE AS c FROM {src} GROUP BY ALL)", _entropy("ha", "a", "cc"), _entropy("hb", "b", "cc"), _entropy("hab", "a, b", "cc"),
            "nm AS (SELECT k, n, (ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2) AS nmi FROM ha JOIN hb USING (k) JOIN hab USING (k) JOIN (SELECT k, sum(c)::BIGINT AS n FROM cc GROUP BY 1) USING (k))"]


@query("normalised_mutual_info", with_sql(_TWO, "sr AS (SELECT 1 AS k, a, b FROM two)", *nmi_sql("sr"), body=f"SELECT n, {r('nmi')} AS nmi FROM nm"))
def nmi(spark, d):
    return rounded(cl.normalised_mutual_info(_two(spark, d), "a", "b"))


@query("best_reference_scheme", with_sql("sr AS (SELECT unnest(['nation', 'parity', 'balance']) AS k, c_mktsegment AS a, unnest(['N' || (c_nationkey % 4), 'P' || (c_custkey % 2), 'B' || (CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'low' END)]) AS b FROM customer)", *nmi_sql("sr"),
       body=f"SELECT arg_max(k, nmi) AS best_scheme, {r('max(nmi)')} AS best_nmi, count(*) AS n_schemes FROM nm"))
def scheme(spark, d):
    c = table(spark, d, "customer")
    recs = F.inline(F.array(F.struct(F.lit("nation").alias("scheme"), F.concat(F.lit("N"), (F.col("c_nationkey") % 4).cast("string")).alias("truth")),
                            F.struct(F.lit("parity").alias("scheme"), F.concat(F.lit("P"), (F.col("c_custkey") % 2).cast("string")).alias("truth")),
                            F.struct(F.lit("balance").alias("scheme"), F.concat(F.lit("B"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("low")).alias("truth"))))
    return rounded(cl.best_scheme(segment(spark, d), c.select(F.col("c_custkey").alias("sample_id"), recs)))


@query("silhouette", """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 p AS (SELECT a.vec_id, a.label, b.label AS ol, avg(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS m FROM x a JOIN x b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
 s AS (SELECT vec_id, max(m) FILTER (ol = label) AS a, min(m) FILTER (ol <> label) AS b FROM p GROUP BY 1)
 SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0.0 AS silhouette, count(*) AS n FROM s""")
def silhouette(spark, d):
    return rounded(cl.silhouette(vectors(spark, d).join(grp(spark, d), "sample_id")))


@query("calinski_harabasz", with_sql(EXPR, GRP, "g AS (SELECT label, feature, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM expr JOIN grp USING (sample_id) GROUP BY 1, 2)",
       "t AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS nn FROM g GROUP BY 1)", body=f"SELECT {r('sum(n * (m - gm) ^ 2) / (count(DISTINCT label) - 1) / (sum(ss) / (max(nn) - count(DISTINCT label)))')} AS ch, count(DISTINCT label) AS k, min(n) AS min_size FROM g JOIN t USING (feature)"))
def ch(spark, d):
    return rounded(cl.calinski_harabasz(vectors(spark, d).join(grp(spark, d), "sample_id").select("label", "vec")))


@query("pca_variance", with_sql(EXPR, body=f"SELECT count(DISTINCT sample_id) AS n, {r('sum(v)', 4)} AS total_variance FROM (SELECT var_samp(value) AS v FROM expr GROUP BY feature) CROSS JOIN (SELECT DISTINCT sample_id FROM expr)").replace("sum(v)", "sum(v) / count(DISTINCT sample_id)"))
def pca(spark, d):
    sc, ratios = cl.pca_scores(vectors(spark, d), 64)  # all components: their variances add up to the total variance
    e = sc.select("sample_id", F.posexplode("vec").alias("pc", "v")).groupBy("pc").agg(F.var_samp("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return rounded(e.agg(F.max("n").alias("n"), F.sum("v").alias("total_variance")), 4)


@query("pca_scores")
def pca_rows(spark, d):
    sc, _ = cl.pca_scores(vectors(spark, d), 3)
    return rounded(sc.select("sample_id", *[F.element_at("vec", i).alias(f"pc{i}") for i in (1, 2, 3)]), 4)


@query("kmeans_clusters")
def kmeans(spark, d):
    return cl.kmeans(vectors(spark, d), 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("k_scan")
def k_scan(spark, d):
    return rounded(cl.k_scan(vectors(spark, d), [2, 3, 4, 5]))


@query("bootstrap_stability")
def bootstrap(spark, d):
    return rounded(cl.bootstrap_stability(vectors(spark, d), grp(spark, d), reps=10))


@query("recluster_concordance")
def recluster(spark, d):
    return rounded(cl.recluster_concordance(counts(spark, d), segment(spark, d)))


@query("pole_groups")
def poles(spark, d):
    return cl.pole_groups(counts(spark, d), 20, 5).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("modality_eligibility")
def eligibility(spark, d):
    n = table(spark, d, "customer").count()
    return rounded(cl.modality_eligibility(counts(spark, d), n, min_features=20, min_pc1=0.04))


_AX = """ax AS (SELECT sample_id, max(value) FILTER (feature = 'F00') AS x, max(value) FILTER (feature = 'F01') AS y FROM expr GROUP BY 1),
q AS (SELECT quantile_cont(x, 0.25) x1, quantile_cont(x, 0.5) x2, quantile_cont(x, 0.75) x3, quantile_cont(y, 0.25) y1, quantile_cont(y, 0.5) y2, quantile_cont(y, 0.75) y3 FROM ax),
sr AS (SELECT 1 AS k, (x > x1)::INT + (x > x2)::INT + (x > x3)::INT AS a, (y > y1)::INT + (y > y2)::INT + (y > y3)::INT AS b FROM ax CROSS JOIN q),
rk AS (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM ax)"""


@query("axis_alignment", with_sql(EXPR, _AX, *nmi_sql("sr"), body=f"SELECT n, {r('nmi')} AS nmi, (SELECT {r('corr(rx, ry)')} FROM rk) AS rho FROM nm"))
def axis(spark, d):
    e = expr(spark, d)
    def one(f):
        return e.where(F.col("feature") == f).select("sample_id", F.col("value").alias("score"))
    return rounded(cl.axis_alignment(one("F00"), one("F01")).drop("p"))


def _halves(spark, d):
    e = expr(spark, d)
    return {"expression": e.where("feature < 'F32'"), "second": e.where("feature >= 'F32'")}


@query("network_fusion_clusters")
def snf(spark, d):
    from cohortia.operators.fusion import multimodal_cluster
    out = multimodal_cluster(_halves(spark, d), k=4, method="snf")
    return out["labels"].groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("concatenated_components_clusters")
def concat_pca(spark, d):
    from cohortia.operators.fusion import multimodal_cluster
    out = multimodal_cluster(_halves(spark, d), k=4, method="concat_pca")
    return rounded(out["nmi_vs_expr_only"])


@query("nearest_neighbours", """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x a JOIN x b ON a.vec_id <> b.vec_id)
 SELECT i AS sample_id, j AS neighbour, round(d, 5) + 0.0 AS dist FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 5""")
def neighbours(spark, d):
    return rounded(cl.nearest_neighbours(vectors(spark, d), 5), 5)
