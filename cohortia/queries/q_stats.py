"""Per-feature statistics: screens, exact tests, rank tests, FDR."""

from pyspark.sql import functions as F

from cohortia.operators import ordered, stats
from cohortia.queries import sqltails as st
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import (COUNTS, EXPR, GRP, PRESENCE, SEGMENT, SURV_CUST, counts, expr, grp, presence,
                                     segment, surv_cust, table, with_sql)

_ANOVA = """m AS (SELECT feature, label, count(*) AS n, avg(value) AS mu, var_pop(value) * count(*) AS ss, sum(value) AS t
  FROM expr JOIN grp USING (sample_id) GROUP BY 1, 2 HAVING count(*) >= 3),
a AS (SELECT feature, sum(n)::BIGINT AS n, count(*) AS k, sum(ss) AS ssw, sum(n * mu * mu) - sum(t) ^ 2 / sum(n) AS ssb FROM m GROUP BY 1),
anova AS (SELECT feature, (ssb / (k - 1)) / (ssw / (n - k)) AS f, (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2, n FROM a WHERE k >= 2)"""

_BH = """{name} AS (SELECT *, min(p * m / rk) OVER (PARTITION BY {fam} ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS fdr FROM (
  SELECT *, count(*) OVER (PARTITION BY {fam}) AS m, count(*) OVER (PARTITION BY {fam} ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk FROM {src}))"""


def bh_cte(name, src, fam="1"):
    return _BH.format(name=name, src=src, fam=fam)


@query("anova_f", with_sql(EXPR, GRP, _ANOVA, body=f"SELECT feature, {r('f')} AS f, df1, df2, n, {r(st.f_sf('f', 'df1', 'df2'))} AS p FROM anova"))
def anova_f(spark, d):
    return rounded(stats.anova(expr(spark, d), grp(spark, d)))


@query("anova_fdr", with_sql(EXPR, GRP, _ANOVA, f"ap AS (SELECT *, {st.f_sf('f', 'df1', 'df2')} AS p FROM anova)", bh_cte("q", "ap"),
                             body=f"SELECT feature, {r('f')} AS f, {r('p')} AS p, {r('fdr')} AS fdr, fdr < 0.05 AS significant FROM q"))
def anova_fdr(spark, d):
    a = ordered.bh_fdr(stats.anova(expr(spark, d), grp(spark, d)), [])
    return rounded(a.select("feature", "f", "p", "fdr", (F.col("fdr") < 0.05).alias("significant")))


_RANKS = """ranks AS (SELECT feature, label, rank() OVER w + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY feature, value) AS ties, count(*) OVER (PARTITION BY feature) AS nt
  FROM {src} WINDOW w AS (PARTITION BY feature ORDER BY value))"""
_CG = "cg AS (SELECT * FROM counts JOIN segment USING (sample_id))"


@query("kruskal_wallis", with_sql(COUNTS, SEGMENT, _CG, _RANKS.format(src="cg"), body=f"""
SELECT feature, {r('h')} AS h, (k - 1)::BIGINT AS df, {r(st.chi2_sf('h', '(k - 1)'))} AS p FROM (
  SELECT feature, (12.0 / (max(nt) * (max(nt) + 1)) * sum(rs * rs / n) - 3.0 * (max(nt) + 1)) /
    (1 - sum(tie) / (max(nt)::DOUBLE ^ 3 - max(nt))) AS h, count(*) AS k
  FROM (SELECT feature, label, sum(rk) AS rs, count(*) AS n, max(nt) AS nt, sum(ties::DOUBLE * ties - 1) AS tie FROM ranks GROUP BY 1, 2) GROUP BY 1)"""))
def kruskal_wallis(spark, d):
    return rounded(stats.kruskal(counts(spark, d), segment(spark, d)))


@query("auc_one_vs_rest", with_sql(COUNTS, SEGMENT, _CG, _RANKS.format(src="cg"), body=f"""
SELECT feature, label, {r('auc')} AS auc, {r('greatest(auc, 1 - auc)')} AS folded_auc FROM (
  SELECT feature, label, (sum(rk) - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(nt) - count(*))) AS auc FROM ranks GROUP BY 1, 2)"""))
def auc(spark, d):
    return rounded(stats.auc_one_vs_rest(counts(spark, d), segment(spark, d)))


_SPEAR = """sx AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM sp),
sr AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM sx GROUP BY 1)"""


@query("spearman_survival_time", with_sql(COUNTS, SURV_CUST, "sp AS (SELECT feature, value AS x, duration AS y FROM counts JOIN surv_cust USING (sample_id))", _SPEAR,
       body=f"SELECT feature, n, {r('rho')} AS rho, {r(st.t_sf2('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)'))} AS p FROM sr"))
def spearman_time(spark, d):
    return rounded(stats.survival_spearman(counts(spark, d), surv_cust(spark, d)))


_2X2 = """pg AS (SELECT gene, label, count(*) AS k FROM presence JOIN segment USING (sample_id) GROUP BY 1, 2),
sz AS (SELECT label, count(*) AS n_in, sum(count(*)) OVER () AS n_all FROM segment GROUP BY 1),
tt AS (SELECT g.gene, sz.label, coalesce(k, 0) AS a, n_in - coalesce(k, 0) AS b, pos - coalesce(k, 0) AS c, n_all - n_in - pos + coalesce(k, 0) AS d
  FROM (SELECT gene, sum(k) AS pos FROM pg GROUP BY 1) g CROSS JOIN sz LEFT JOIN pg ON pg.gene = g.gene AND pg.label = sz.label)"""


@query("fisher_enrichment", with_sql(COUNTS, SEGMENT, PRESENCE, _2X2, f"fp AS (SELECT *, {st.fisher2('a', 'b', 'c', 'd')} AS p FROM tt)", bh_cte("q", "fp"),
       body=f"SELECT gene, label, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, {r('p')} AS p, {r('a * d / nullif(b * c, 0)')} AS odds_ratio, {r('fdr')} AS fdr FROM q"))
def fisher(spark, d):
    return rounded(stats.fisher_enrichment(presence(spark, d), segment(spark, d)))


@query("driver_enrichment_score", with_sql(COUNTS, SEGMENT, PRESENCE, _2X2, f"fp AS (SELECT *, {st.fisher2('a', 'b', 'c', 'd')} AS p FROM tt WHERE gene IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5','Brand#6'))", bh_cte("q", "fp"),
       body=f"SELECT count(DISTINCT gene) AS n_drivers_tested, count(*) FILTER (fdr < 0.05) AS n_significant, {r('least(count(*) FILTER (fdr < 0.05) / 5.0, 1.0)')} AS score FROM q"))
def driver_score(spark, d):
    from cohortia.plans.scores import driver_enrichment
    drivers = table(spark, d, "part").where(F.col("p_brand").rlike("^Brand#[1-6]$")).select(F.col("p_brand").alias("gene")).distinct()
    return rounded(driver_enrichment(presence(spark, d), segment(spark, d), drivers))


@query("cna_enrichment", with_sql(COUNTS, SEGMENT, """presence AS (SELECT c.sample_id, feature AS gene FROM counts c WHERE value > 80 OR value < 10)""",
       "cov AS (SELECT DISTINCT sample_id FROM presence)", _2X2.replace("FROM segment GROUP", "FROM segment SEMI JOIN cov USING (sample_id) GROUP"),
       f"fp AS (SELECT *, {st.fisher2('a', 'b', 'c', 'd')} AS p FROM tt WHERE a + c >= 1 AND b + d >= 1)", """rd AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY round(p, 12), label) AS rn FROM fp)""",
       body=f"SELECT gene, {r('p')} AS best_p, p < 0.05 AS passed FROM rd WHERE rn = 1"))
def cna(spark, d):
    v = F.col("value")
    c = counts(spark, d).select("sample_id", F.col("feature").alias("gene"), F.when(v > 80, 1).when(v < 10, -1).otherwise(0).alias("call"))
    return rounded(stats.cna_enrichment(c, segment(spark, d)).select("gene", "best_p", "passed"))


@query("methylation_evidence", with_sql(EXPR, "x AS (SELECT sample_id, feature AS gene, value AS x FROM expr WHERE feature IN ('F00','F01','F02','F03'))",
       "c AS (SELECT gene, feature AS cpg, count(*) AS n, corr(x, value) AS r FROM x JOIN expr USING (sample_id) WHERE feature >= 'F10' GROUP BY 1, 2)",
       f"cp AS (SELECT *, {st.t_sf2('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')} AS p FROM c)", bh_cte("q", "cp", "gene"),
       body=f"""SELECT gene, arg_max(cpg, abs(r)) AS best_cpg, {r('arg_max(r, abs(r))')} AS best_r, {r('arg_max(p, abs(r))')} AS best_p, {r('arg_max(fdr, abs(r))')} AS best_fdr,
count(*) AS n_cpgs, max(abs(r)) >= 0.3 AND arg_max(fdr, abs(r)) < 0.05 AS passed FROM q GROUP BY 1"""))
def methylation(spark, d):
    e = expr(spark, d)
    genes = e.where(F.col("feature") < "F04").select("feature").distinct()
    return rounded(stats.methylation_evidence(e, e.where(F.col("feature") >= "F10"), genes))


@query("bh_fdr", """SELECT brand, round(p, 8) AS p, (round(fdr, 6) + 0.0) AS fdr FROM (
  SELECT *, min(p * m / rk) OVER (PARTITION BY brand ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS fdr FROM (
   SELECT *, count(*) OVER (PARTITION BY brand) AS m, count(*) OVER (PARTITION BY brand ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk FROM (
    SELECT p_brand AS brand, p_size / 64.0 AS p FROM part)))""")
def bh(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") / 64.0).alias("p"))
    return ordered.bh_fdr(p, ["brand"]).select("brand", F.round("p", 8).alias("p"), F.round("fdr", 6).alias("fdr"))


@query("over_representation", with_sql("s AS (SELECT DISTINCT p_type AS set_name, p_name AS gene FROM part)",
       "h AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_size > 48)",
       "k AS (SELECT set_name, count(*) AS n_set, count(h.gene) AS k FROM s LEFT JOIN h USING (gene) GROUP BY 1)",
       body=f"SELECT set_name, n_set, k, n_draw, {r(st.hyper_sf('k', '200', 'n_set', 'n_draw'))} AS p FROM k CROSS JOIN (SELECT count(*) AS n_draw FROM h)"))
def ora(spark, d):
    p = table(spark, d, "part")
    return rounded(stats.over_representation(p.where("p_size > 48").select(F.col("p_name").alias("gene")),
                                             p.select(F.col("p_type").alias("set_name"), F.col("p_name").alias("gene")), 200))


@query("mann_whitney_u", with_sql("e AS (SELECT user_id % 7 AS arm, value, event_type = 'purchase' AS hit FROM events WHERE value IS NOT NULL)",
       "k AS (SELECT *, rank() OVER (PARTITION BY arm ORDER BY value) + (count(*) OVER (PARTITION BY arm, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY arm, value) AS ties FROM e)",
       "s AS (SELECT arm, count(*) FILTER (hit) AS n1, count(*) FILTER (NOT hit) AS n2, sum(rk) FILTER (hit) AS r1, sum(ties::DOUBLE * ties - 1) AS tie FROM k GROUP BY 1)",
       "u AS (SELECT arm, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM s)",
       body=f"SELECT arm, n1, n2, {r('u')} AS u, {r('(abs(u - n1 * n2 / 2.0) - 0.5) / sd')} AS z FROM u"))
def mwu(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("arm"), "value", "event_type")
    return rounded(stats.mann_whitney(e, ["arm"], "value", "event_type", "purchase", with_p=False))


@query("wilcoxon_signed_rank", with_sql("e AS (SELECT event_type, (value - 20.0) AS x FROM events WHERE (value - 20.0) <> 0)",
       "k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY abs(x)) + (count(*) OVER (PARTITION BY event_type, abs(x)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY event_type, abs(x)) AS ties FROM e)",
       "s AS (SELECT event_type, count(*) AS n, coalesce(sum(rk) FILTER (x > 0), 0) AS w_pos, coalesce(sum(rk) FILTER (x < 0), 0) AS w_neg, sum(ties::DOUBLE * ties - 1) AS tie FROM k GROUP BY 1)",
       body=f"SELECT event_type, n, {r('w_pos')} AS w_pos, {r('w_neg')} AS w_neg, {r('(least(w_pos, w_neg) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24.0 - tie / 48.0)')} AS z FROM s"))
def wilcoxon(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") - 20.0).alias("x"))
    return rounded(stats.wilcoxon_signed_rank(e, ["event_type"], "x", with_p=False))


@query("cohens_d", f"""SELECT feature, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, {r('avg(value) FILTER (a)')} AS mean_a, {r('avg(value) FILTER (NOT a)')} AS mean_b,
 {r('(avg(value) FILTER (a) - avg(value) FILTER (NOT a)) / sqrt((var_pop(value) FILTER (a) + var_pop(value) FILTER (NOT a)) / 2)')} AS d FROM (
  WITH {EXPR}, {GRP} SELECT feature, value, label < '5' AS a FROM expr JOIN grp USING (sample_id)) GROUP BY 1""")
def cohen(spark, d):
    return rounded(stats.cohens_d(expr(spark, d).join(grp(spark, d), "sample_id"), ["feature"], "value", F.col("label") < "5"))


def _mean_ci_sql(arm):
    """t quantiles by halving on the closed form of the t distribution for whole degrees of freedom (a sum of cosines)."""
    odd = "2 / pi() * (th + sin(th) * coalesce(list_sum([exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * j + 1) FOR j IN range(0, (v - 1) // 2)]), 0))"
    even = "sin(th) * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(th), 2 * j) FOR j IN range(0, v // 2)])"
    return f"""WITH RECURSIVE g AS (SELECT event_type, {arm} AS arm, count(value) AS n, avg(value) AS mean, stddev(value) AS sd FROM events GROUP BY 1, 2),
b AS (SELECT DISTINCT n - 1 AS v, 0 AS i, 0::DOUBLE AS lo, 16::DOUBLE AS hi FROM g WHERE n > 1
 UNION ALL SELECT v, i + 1, CASE WHEN a < 0.95 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN a < 0.95 THEN hi ELSE (lo + hi) / 2 END FROM (
  SELECT *, CASE WHEN v % 2 = 1 THEN {odd} ELSE {even} END AS a FROM (SELECT *, atan((lo + hi) / 2 / sqrt(v)) AS th FROM b WHERE i < 50)))
SELECT event_type, arm, n, {r('mean')} AS mean, {r('sd')} AS sd, {r('(lo + hi) / 2 * sd / sqrt(n)')} AS ci95 FROM g LEFT JOIN (SELECT v, lo, hi FROM b WHERE i = 50) ON v = n - 1"""


@query("mean_ci_small_groups", _mean_ci_sql("user_id"))
def mean_ci_small(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("arm"), "value")
    return rounded(stats.mean_ci(e, ["event_type", "arm"], "value"))


@query("mean_ci", _mean_ci_sql("user_id % 3"))
def mean_ci(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("arm"), "value")
    return rounded(stats.mean_ci(e, ["event_type", "arm"], "value"))


@query("mean_separation", f"""SELECT event_type, {r('a - b')} AS diff, {r('(a - b) / sqrt(va / na + vb / nb)')} AS z FROM (
 SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b, var_samp(value) FILTER (user_id % 2 = 0) AS va,
 var_samp(value) FILTER (user_id % 2 = 1) AS vb, count(value) FILTER (user_id % 2 = 0) AS na, count(value) FILTER (user_id % 2 = 1) AS nb FROM events GROUP BY 1)""")
def separation(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("arm"), "value")
    return rounded(stats.separation(stats.mean_ci(e, ["event_type", "arm"], "value"), ["event_type"], "arm", 0, 1))


_PAIRS = """rk AS (SELECT sample_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM expr WHERE feature < 'F12'),
pr AS (SELECT x.feature AS a, y.feature AS b, corr(x.rk, y.rk) AS rho, count(*) AS n FROM rk x JOIN rk y ON x.sample_id = y.sample_id AND x.feature < y.feature GROUP BY 1, 2)"""


@query("spearman_pairs", with_sql(EXPR, _PAIRS, body=f"SELECT a, b, {r('rho')} AS rho, n FROM pr"))
def pairs(spark, d):
    e = expr(spark, d)
    return rounded(stats.pair_spearman(e, e.where("feature < 'F12'").select("feature").distinct()))


_COH = """coh AS (SELECT sample_id, feature, value, (sample_id % 2)::INT AS cohort FROM expr WHERE feature < 'F12'),
rk AS (SELECT cohort, sample_id, feature, rank() OVER (PARTITION BY cohort, feature ORDER BY value) + (count(*) OVER (PARTITION BY cohort, feature, value) - 1) / 2.0 AS rk FROM coh),
pr AS (SELECT x.cohort, x.feature AS a, y.feature AS b, corr(x.rk, y.rk) AS rho FROM rk x JOIN rk y ON x.sample_id = y.sample_id AND x.feature < y.feature GROUP BY 1, 2, 3),
v AS (SELECT a, b, max(rho) FILTER (cohort = 0) AS x, max(rho) FILTER (cohort = 1) AS y FROM pr GROUP BY 1, 2),
vr AS (SELECT *, rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM v)"""


@query("matrix_agreement", with_sql(EXPR, _COH, body=f"SELECT count(*) AS n, {r('corr(rx, ry)')} AS matrix_rho, {r('avg((sign(x) = sign(y))::INT)')} AS sign_concordance FROM vr"))
def agreement(spark, d):
    e = expr(spark, d).withColumn("cohort", (F.col("sample_id") % 2).cast("int"))
    p = stats.pair_spearman(e, e.where("feature < 'F12'").select("feature").distinct(), by=["cohort"])
    return rounded(stats.matrix_agreement(p, "cohort", 0, 1))


@query("marker_table", with_sql(EXPR, GRP, "j AS (SELECT * FROM expr JOIN grp USING (sample_id))", "l AS (SELECT DISTINCT label AS g FROM grp)", body=f"""
SELECT feature, g AS label, {r('avg(value) FILTER (label = g)')} AS mean_in, {r('avg(value) FILTER (label <> g)')} AS mean_out,
{r('avg(value) FILTER (label = g) - avg(value) FILTER (label <> g)')} AS diff,
{r('(avg(value) FILTER (label = g) - avg(value) FILTER (label <> g)) / sqrt((var_pop(value) FILTER (label = g) + var_pop(value) FILTER (label <> g)) / 2)')} AS effect FROM j CROSS JOIN l GROUP BY 1, 2"""))
def markers(spark, d):
    return rounded(stats.marker_table(expr(spark, d), grp(spark, d)))


@query("two_hit", with_sql(COUNTS, SEGMENT, body="""SELECT feature AS gene, label, count(*) AS n_two_hit FROM counts JOIN segment USING (sample_id)
 WHERE value > 60 AND (value > 80 OR value < 10) GROUP BY 1, 2"""))
def two_hit(spark, d):
    v = F.col("value")
    c = counts(spark, d).select("sample_id", F.col("feature").alias("gene"), F.when(v > 80, 1).when(v < 10, -1).otherwise(0).alias("call"))
    return stats.two_hit(presence(spark, d), c, segment(spark, d))


@query("metric_battery", with_sql("w AS (SELECT user_id, avg(value) AS v, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)",
       "sp AS (SELECT 'errors_vs_value' AS feature, e AS x, v AS y FROM w UNION ALL SELECT 'calls_vs_errors', n, e FROM w UNION ALL SELECT 'calls_vs_value', n, v FROM w)", _SPEAR,
       "ex AS (SELECT * FROM (VALUES ('errors_vs_value', -1), ('calls_vs_errors', 1), ('calls_vs_value', 1)) t(feature, expected))",
       body=f"SELECT feature AS metric_pair, n, {r('rho')} AS rho, expected, sign(rho) = expected AS as_expected FROM sr JOIN ex USING (feature)"))
def battery(spark, d):
    from cohortia.plans.scores import metric_battery
    w = table(spark, d, "events").groupBy("user_id").agg(
        F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).cast("double").alias("e"))
    return rounded(metric_battery(w, [("errors_vs_value", "e", "v", -1), ("calls_vs_errors", "n", "e", 1), ("calls_vs_value", "n", "v", 1)]).drop("p"))
