"""Component scores of the rubrics, and null calibration."""

from pyspark.sql import functions as F

from cohortia.operators import stats
from cohortia.plans import scores as sc
from cohortia.queries import sqltails as st
from cohortia.queries.q_survival import cox_sql
from cohortia.queries.q_stats import _ANOVA, _SPEAR, bh_cte
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import (COUNTS, EXPR, GRP, SEGMENT, SURV_CUST, counts, expr, grp, segment, surv_cust, table,
                                     with_sql)
from cohortia.session import cut_lineage


@query("structure_validity_score")
def structure(spark, d):
    return rounded(sc.structure_validity(expr(spark, d), grp(spark, d), reps=10))


_CI = ["s AS (SELECT sample_id, duration, event, label FROM surv_cust JOIN segment USING (sample_id))", "md AS (SELECT label, quantile_cont(duration, 0.5) AS med FROM s GROUP BY 1)",
       "t AS (SELECT label, med, duration, count(*) AS n, sum(event) AS d FROM s JOIN md USING (label) GROUP BY 1, 2, 3)",
       """ci AS (SELECT sum(a.d * (CASE WHEN b.duration > a.duration THEN b.n ELSE b.n - b.d END) * CASE WHEN b.med > a.med THEN 1.0 WHEN b.med = a.med THEN 0.5 ELSE 0 END)
  / sum(a.d * (CASE WHEN b.duration > a.duration THEN b.n ELSE b.n - b.d END)) AS c FROM t a JOIN t b ON b.duration >= a.duration WHERE a.d > 0)""",
       "ex AS (SELECT arg_max(label, (med, label)) AS best, arg_min(label, (med, label)) AS worst FROM md)",
       "zz AS (SELECT 1 AS key, duration, event, (label = best)::INT::DOUBLE AS x FROM s CROSS JOIN ex WHERE label = best OR label = worst)"]


@query("clinical_signal_score", with_sql(SURV_CUST, SEGMENT, *_CI, *cox_sql("zz"),
       body=f"""SELECT (SELECT count(*) FROM s) AS n, (SELECT sum(event)::BIGINT FROM s) AS n_events, (SELECT count(DISTINCT label) FROM s) AS n_groups, {r('c', 5)} AS c_index, {r('greatest(c, 1 - c)', 5)} AS folded, {r('abs(coef)', 5)} AS log_hr,
 {r('0.6 * least(greatest((greatest(c, 1 - c) - 0.5) / 0.3, 0), 1) + 0.4 * least(abs(coef) / 2, 1)', 5)} AS score, 'ok' AS status FROM ci CROSS JOIN fit"""))
def clinical(spark, d):
    return rounded(sc.clinical_signal(surv_cust(spark, d), segment(spark, d)), 5)


@query("survival_stratification_score")
def stratification(spark, d):
    return rounded(sc.survival_stratification(surv_cust(spark, d), segment(spark, d)))


_CX = "cx AS (SELECT sample_id, feature, value FROM counts)"
_EVID = [COUNTS, SEGMENT, SURV_CUST, _ANOVA.replace("FROM expr JOIN grp", "FROM counts JOIN segment"), f"ap AS (SELECT feature, {st.f_sf('f', 'df1', 'df2')} AS p FROM anova)", bh_cte("qa", "ap"),
         "sp AS (SELECT feature, value AS x, duration AS y FROM counts JOIN surv_cust USING (sample_id))", _SPEAR,
         f"zp AS (SELECT feature, {st.t_sf2('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} AS p FROM sr)", bh_cte("qz", "zp"),
         "ev AS (SELECT feature, qa.p AS de_p, qa.fdr AS de_fdr, qz.p AS surv_p, qz.fdr AS surv_fdr FROM qa JOIN qz USING (feature))"]


def _genes(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("feature")).distinct()


@query("gene_evidence", with_sql(*_EVID, body=f"SELECT feature, {r('de_p')} AS de_p, {r('de_fdr')} AS de_fdr, {r('surv_p')} AS surv_p, {r('surv_fdr')} AS surv_fdr FROM ev"))
def evidence(spark, d):
    return rounded(sc.gene_evidence(counts(spark, d), segment(spark, d), surv_cust(spark, d), _genes(spark, d)).select("feature", "de_p", "de_fdr", "surv_p", "surv_fdr"))


def _full_evidence(spark, d):
    c = counts(spark, d)
    v = F.col("value")
    meth = c.select("sample_id", F.concat(F.lit("cg_"), "feature").alias("feature"), "value")
    cna = c.select("sample_id", F.col("feature").alias("gene"), F.when(v > 80, 1).when(v < 10, -1).otherwise(0).alias("call"))
    genes = _genes(spark, d).union(table(spark, d, "nation").select("n_name"))
    return sc.gene_evidence(c, segment(spark, d), surv_cust(spark, d), genes, meth, cna)


_FULL = [*_EVID, "pr AS (SELECT a.feature AS ga, b.feature AS gb, abs(corr(a.value, b.value)) AS r FROM counts a JOIN counts b USING (sample_id) GROUP BY 1, 2)",
         # with a thousand shared samples any |r| >= 0.3 has an FDR far below 0.05, so the size condition decides
         "mt AS (SELECT ga AS feature, max(r) >= 0.3 AS modal FROM pr GROUP BY 1)", "gl AS (SELECT DISTINCT p_brand AS feature FROM part UNION ALL SELECT n_name FROM nation)",
         "fe AS (SELECT feature, ev.de_p IS NOT NULL AS valid, de_p, de_fdr, surv_p, surv_fdr, coalesce(modal, false) AS modal FROM gl LEFT JOIN ev USING (feature) LEFT JOIN mt USING (feature))"]


@query("provenance_score", with_sql(*_FULL, body=f"SELECT count(*) AS n_genes, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND (coalesce(de_fdr, 1) < 0.05)::INT + (coalesce(surv_fdr, 1) < 0.05)::INT + modal::INT >= 2) AS n_passing, {r('avg((valid AND (coalesce(de_fdr, 1) < 0.05)::INT + (coalesce(surv_fdr, 1) < 0.05)::INT + modal::INT >= 2)::INT)')} AS score FROM fe"))
def provenance(spark, d):
    return rounded(sc.provenance_integrity(_full_evidence(spark, d)))


@query("cross_modal_score", with_sql(*_FULL, body=f"SELECT count(*) AS n_genes, count(*) FILTER (valid AND modal AND (coalesce(de_p, 1) < 0.05 OR coalesce(surv_p, 1) < 0.05)) AS n_with_both, {r('avg((valid AND modal AND (coalesce(de_p, 1) < 0.05 OR coalesce(surv_p, 1) < 0.05))::INT)')} AS score FROM fe"))
def cross_modal(spark, d):
    return rounded(sc.cross_modal_support(_full_evidence(spark, d)))


@query("marker_evidence_score", with_sql(EXPR, GRP, "g AS (SELECT 'F' || lpad(i::VARCHAR, 2, '0') AS feature, i FROM range(0, 80, 4) t(i))",
       "ok AS (SELECT feature, i FROM g WHERE feature IN (SELECT feature FROM expr))", "f15 AS (SELECT feature FROM ok ORDER BY i LIMIT 15)",
       "rk AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY feature) AS nt FROM expr SEMI JOIN f15 USING (feature) JOIN grp USING (sample_id))",
       "au AS (SELECT feature, label, (sum(rk) - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(nt) - count(*))) AS a FROM rk GROUP BY 1, 2 HAVING count(*) >= 3)",
       "m AS (SELECT avg(a) AS mean_auc FROM (SELECT avg(greatest(a, 1 - a)) AS a FROM au GROUP BY feature))",
       "z AS (SELECT (SELECT count(*) FROM ok) / (SELECT count(*) FROM g) AS validity, mean_auc, (SELECT avg((feature < 'F20')::INT) FROM ok) AS driver_overlap FROM m)",
       body=f"SELECT {r('validity')} AS validity, {r('mean_auc')} AS mean_auc, {r('driver_overlap')} AS driver_overlap, {r('0.4 * validity + 0.4 * least(greatest((mean_auc - 0.5) * 2, 0), 1) + 0.2 * driver_overlap')} AS score FROM z"))
def marker(spark, d):
    e = expr(spark, d)
    genes = spark.range(0, 80, 4).select(F.format_string("F%02d", "id").alias("feature"), F.col("id").alias("position"))
    drivers = e.where("feature < 'F20'").select(F.col("feature").alias("gene")).distinct()
    return rounded(sc.marker_evidence(e, grp(spark, d), genes, drivers))


@query("pathway_validity_score", with_sql("s AS (SELECT DISTINCT upper(p_type) || '_SET' AS set_name, p_name AS gene FROM part)", "h AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_size > 48)",
       "pw AS (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'unknown pathway' ELSE lower(p_type) || ' set' END AS name FROM part)",
       "mt AS (SELECT name, min(set_name) AS set_name FROM pw JOIN (SELECT DISTINCT set_name FROM s) ON contains(set_name, replace(upper(name), ' ', '_')) OR contains(replace(upper(name), ' ', '_'), set_name) GROUP BY 1)",
       "k AS (SELECT set_name, count(*) AS n_set, count(h.gene) AS k, (SELECT count(*) FROM h) AS n_draw FROM s LEFT JOIN h USING (gene) GROUP BY 1)",
       f"o AS (SELECT set_name, k, {st.hyper_sf('k', '20000', 'n_set', 'n_draw')} AS p FROM k)",
       body=f"SELECT (SELECT count(*) FROM pw) AS n_submitted, count(*) AS n_valid, count(*) FILTER (k > 0 AND p < 0.05) AS n_enriched, {r('0.6 * count(*) / (SELECT count(*) FROM pw) + 0.4 * count(*) FILTER (k > 0 AND p < 0.05) / greatest(count(*), 1)')} AS score FROM mt JOIN o USING (set_name)"))
def pathway(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.when(F.col("p_type") == "PROMO", "unknown pathway").otherwise(F.concat(F.lower("p_type"), F.lit(" set"))).alias("name"))
    sets = p.select(F.concat(F.upper("p_type"), F.lit("_SET")).alias("set_name"), F.col("p_name").alias("gene")).distinct()
    return rounded(sc.pathway_validity(names, p.where("p_size > 48").select(F.col("p_name").alias("gene")), sets))


@query("coexpression_replication_score")
def coexpression(spark, d):
    c = cut_lineage(counts(spark, d))  # read by all three cohorts
    third = F.col("sample_id") % 3
    return rounded(sc.coexpression_replication(c.where(third == 0), surv_cust(spark, d), c.where(third == 1), c.where(third == 2), _genes(spark, d)))


@query("null_provenance", with_sql(*_EVID, "gs AS (SELECT rep::INT AS rep, feature FROM (SELECT rep, feature, row_number() OVER (PARTITION BY rep ORDER BY md5('4|' || rep || '|' || feature), feature) AS rn FROM (SELECT feature FROM ev) CROSS JOIN range(50) t(rep)) WHERE rn <= 15)",
       body=f"SELECT rep, {r('avg(((de_fdr < 0.05)::INT + (surv_fdr < 0.05)::INT >= 2)::INT)')} AS score FROM gs JOIN ev USING (feature) GROUP BY 1"))
def null_prov(spark, d):
    return rounded(sc.null_provenance(counts(spark, d), surv_cust(spark, d), segment(spark, d), 50, 4))


@query("null_stratification")
def null_strat(spark, d):
    return rounded(sc.null_stratification(surv_cust(spark, d), 6, 4))
