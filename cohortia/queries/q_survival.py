"""Survival analysis over order lines (one row per line) and customers (one row per sample)."""

from pyspark.sql import functions as F

from cohortia.operators import cox, ordered
from cohortia.operators import survival as sv
from cohortia.queries import sqltails as st
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import COUNTS, SURV_CUST, SURV_LINES, counts, surv_cust, surv_lines, table, with_sql
from cohortia.session import cut_lineage


def cox_sql(src: str, iters: int = 9) -> list[str]:
    """Unrolled Newton steps for one-covariate Cox with Efron ties, as common table expressions ending in ``fit``."""
    out = [f"b0 AS MATERIALIZED (SELECT key, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS inf FROM {src} GROUP BY 1)"]
    for i in range(iters):
        out.append(f"""c{i} AS MATERIALIZED (SELECT key, duration, sum(exp(beta*x)) AS s0, sum(x*exp(beta*x)) AS s1, sum(x*x*exp(beta*x)) AS s2,
  sum(event) AS d, sum(event*exp(beta*x)) AS e0, sum(event*x*exp(beta*x)) AS e1, sum(event*x*x*exp(beta*x)) AS e2, sum(event*x) AS dx
  FROM {src} JOIN b{i} USING (key) GROUP BY 1, 2)""")
        out.append(f"""k{i} AS MATERIALIZED (SELECT key, d, e0, e1, e2, dx, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2
  FROM c{i} WINDOW w AS (PARTITION BY key ORDER BY duration DESC))""")
        out.append(f"""u{i} AS MATERIALIZED (SELECT key, sum(dx - list_sum(list_transform(range(d::BIGINT), lambda z: (s1 - z/d*e1)/(s0 - z/d*e0)))) AS u,
  sum(list_sum(list_transform(range(d::BIGINT), lambda z: (s2 - z/d*e2)/(s0 - z/d*e0) - ((s1 - z/d*e1)/(s0 - z/d*e0))^2))) AS inf
  FROM k{i} WHERE d > 0 GROUP BY 1)""")
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT key, beta + u/u{i}.inf AS beta, u{i}.inf AS inf FROM b{i} JOIN u{i} USING (key))")
    out.append(f"fit AS (SELECT key, beta AS coef, 1/sqrt(inf) AS se FROM b{iters})")
    return out


def cox2_sql(src: str, iters: int = 8) -> list[str]:
    """Unrolled Newton steps for two covariates x, y with Efron ties; the 2 x 2 system is solved by Cramer's rule."""
    w = "exp(b1*x + b2*y)"
    moments = {"s0": "1", "sx": "x", "sy": "y", "sxx": "x*x", "sxy": "x*y", "syy": "y*y"}
    out = [f"b0 AS MATERIALIZED (SELECT key, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS i11, 0.0::DOUBLE AS i12, 0.0::DOUBLE AS i22 FROM {src} GROUP BY 1)"]
    for i in range(iters):
        cell = ", ".join(f"sum({m}*{w}) AS {k}, sum(event*{m}*{w}) AS e{k}" for k, m in moments.items())
        out.append(f"c{i} AS MATERIALIZED (SELECT key, duration, {cell}, sum(event) AS d, sum(event*x) AS dx, sum(event*y) AS dy FROM {src} JOIN b{i} USING (key) GROUP BY 1, 2)")
        run = ", ".join(f"sum({k}) OVER w AS {k}" for k in moments)
        out.append(f"k{i} AS MATERIALIZED (SELECT key, d, dx, dy, {', '.join('e' + k for k in moments)}, {run} FROM c{i} WINDOW w AS (PARTITION BY key ORDER BY duration DESC))")

        def at(k):
            return f"(({k} - z/d*e{k})/(s0 - z/d*es0))"

        def tot(body):
            return f"list_sum(list_transform(range(d::BIGINT), lambda z: {body}))"
        out.append(f"""u{i} AS MATERIALIZED (SELECT key, sum(dx - {tot(at('sx'))}) AS u1, sum(dy - {tot(at('sy'))}) AS u2, sum({tot(at('sxx') + ' - ' + at('sx') + '*' + at('sx'))}) AS i11,
  sum({tot(at('sxy') + ' - ' + at('sx') + '*' + at('sy'))}) AS i12, sum({tot(at('syy') + ' - ' + at('sy') + '*' + at('sy'))}) AS i22 FROM k{i} WHERE d > 0 GROUP BY 1)""")
        det = f"(u{i}.i11*u{i}.i22 - u{i}.i12*u{i}.i12)"
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT key, b1 + (u1*u{i}.i22 - u2*u{i}.i12)/{det} AS b1, b2 + (u2*u{i}.i11 - u1*u{i}.i12)/{det} AS b2, u{i}.i11, u{i}.i12, u{i}.i22 FROM b{i} JOIN u{i} USING (key))")
    out.append(f"fit2 AS (SELECT key, b1 AS coef, sqrt(i22/(i11*i22 - i12*i12)) AS se FROM b{iters})")
    return out


def _meta(spark, d):
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate")
    text = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(days.cast("string"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"),
        F.when(F.col("l_returnflag") == "R", "Deceased").when(F.col("l_returnflag") == "A", "Alive").alias("vital_status"),
        text.alias("days_to_death"), (days + 5).alias("days_to_last_follow_up"))


@query("survival_table", """SELECT sample_id, duration, event FROM (
 SELECT concat_ws('-', l_orderkey, l_linenumber) AS sample_id, (l_returnflag = 'R')::INT AS event,
 CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 7 THEN NULL ELSE date_diff('day', o_orderdate, l_shipdate)::DOUBLE END
 ELSE (date_diff('day', o_orderdate, l_shipdate) + 5)::DOUBLE END AS duration
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE duration > 0""")
def survival_table(spark, d):
    return sv.survival_table(_meta(spark, d))


_RISK = """t AS (SELECT label, duration, count(*) AS n, sum(event)::BIGINT AS d FROM surv_lines GROUP BY 1, 2),
rk AS (SELECT label, duration, d, sum(n) OVER (PARTITION BY label ORDER BY duration DESC)::BIGINT AS at_risk FROM t)"""


@query("kaplan_meier", with_sql(SURV_LINES, _RISK, body=f"""SELECT label, duration, at_risk, d,
 {r("CASE WHEN min(at_risk - d) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END")} AS survival
 FROM rk WINDOW w AS (PARTITION BY label ORDER BY duration)"""))
def kaplan_meier(spark, d):
    return rounded(sv.kaplan_meier(surv_lines(spark, d), ["label"]))


_G3 = "CASE WHEN x < 0.03 THEN 'a' WHEN x < 0.07 THEN 'b' ELSE 'c' END"
_LR = f"""g3 AS (SELECT label AS key, duration, event, {_G3} AS label FROM surv_lines),
t AS (SELECT key, duration, count(*) FILTER (label='a') AS na, count(*) FILTER (label='b') AS nb, count(*) FILTER (label='c') AS nc,
  sum(event) FILTER (label='b') AS db, sum(event) FILTER (label='c') AS dc, sum(event) AS d FROM g3 GROUP BY 1, 2),
rk AS (SELECT key, d::DOUBLE AS d, coalesce(db, 0) AS db, coalesce(dc, 0) AS dc, (sum(na+nb+nc) OVER w)::DOUBLE AS n, (sum(nb) OVER w)::DOUBLE AS rb, (sum(nc) OVER w)::DOUBLE AS rc
  FROM t WINDOW w AS (PARTITION BY key ORDER BY duration DESC)),
zv AS (SELECT key, sum(db - d*rb/n) AS z1, sum(dc - d*rc/n) AS z2, sum(f*rb*(n-rb)) AS v11, sum(f*rc*(n-rc)) AS v22, -sum(f*rb*rc) AS v12
  FROM (SELECT *, CASE WHEN n > 1 THEN d*(n-d)/(n-1)/(n*n) ELSE 0 END AS f FROM rk WHERE d > 0) GROUP BY 1),
q AS (SELECT key, (z1*z1*v22 - 2*z1*z2*v12 + z2*z2*v11)/(v11*v22 - v12*v12) AS chi2 FROM zv)"""


@query("logrank_test", with_sql(SURV_LINES, _LR, body=f"SELECT key, {r('chi2')} AS chi2, 2::BIGINT AS df, {r('exp(-chi2 / 2)')} AS p FROM q"))
def logrank(spark, d):
    s = surv_lines(spark, d).withColumn("key", F.col("label")).withColumn("label", F.expr(_G3))
    return rounded(sv.logrank(s.select("key", "duration", "event", "label"), ["key"]))


@query("logrank_five_groups")
def logrank5(spark, d):
    return rounded(sv.logrank(surv_lines(spark, d)))


@query("group_median_survival", with_sql(SURV_LINES, body=f"SELECT label, count(*) AS n, {r('quantile_cont(duration, 0.5)')} AS median, sum(event)::BIGINT AS events FROM surv_lines GROUP BY 1"))
def medians(spark, d):
    return rounded(sv.group_medians(surv_lines(spark, d)))


@query("concordance_index", with_sql(SURV_LINES, "s AS (SELECT label AS grp, " + _G3 + " AS label, duration, event FROM surv_lines)",
       "m AS (SELECT grp, label, quantile_cont(duration, 0.5) AS med FROM s GROUP BY 1, 2)",
       "t AS (SELECT grp, label, med, duration, count(*) AS n, sum(event) AS d FROM s JOIN m USING (grp, label) GROUP BY 1, 2, 3, 4)",
       """p AS (SELECT a.grp, sum(a.d * (CASE WHEN b.duration > a.duration THEN b.n ELSE b.n - b.d END)) AS pairs,
  sum(a.d * (CASE WHEN b.duration > a.duration THEN b.n ELSE b.n - b.d END) * CASE WHEN b.med > a.med THEN 1.0 WHEN b.med = a.med THEN 0.5 ELSE 0 END) AS c
  FROM t a JOIN t b ON a.grp = b.grp AND b.duration >= a.duration WHERE a.d > 0 GROUP BY 1)""",
       body=f"SELECT grp, {r('c / pairs')} AS c_index, {r('greatest(c / pairs, 1 - c / pairs)')} AS folded, pairs::DOUBLE AS pairs FROM p"))
def concordance(spark, d):
    s = surv_lines(spark, d).select(F.col("label").alias("grp"), F.expr(_G3).alias("label"), "duration", "event")
    return rounded(sv.concordance(s, ["grp"]))


@query("cox_univariate", with_sql(SURV_LINES, """zz AS (SELECT label AS key, duration, event, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x
  FROM surv_lines WINDOW w AS (PARTITION BY label))""", *cox_sql("zz"),
       body=f"SELECT key AS label, {r('coef', 5)} AS coef, {r('exp(coef)', 5)} AS hr, {r('se', 5)} AS se, n, events, 'ok' AS status FROM fit JOIN (SELECT key, count(*) AS n, sum(event)::BIGINT AS events FROM zz GROUP BY 1) USING (key)"))
def cox_uni(spark, d):
    return rounded(cox.cox_univariate(surv_lines(spark, d), ["label"]).drop("p"), 5)


_GX = """gx AS (SELECT feature AS key, duration, event, (value - avg(value) OVER w) / stddev(value) OVER w AS x
  FROM counts JOIN surv_cust USING (sample_id) WINDOW w AS (PARTITION BY feature))"""


@query("gene_cox_screen", with_sql(COUNTS, SURV_CUST, _GX, *cox_sql("gx"),
       body=f"SELECT key AS feature, {r('coef', 5)} AS coef, {r('se', 5)} AS se, CASE WHEN coef > 0 THEN -1 ELSE 1 END AS direction FROM fit"))
def gene_cox(spark, d):
    return rounded(sv.gene_cox(counts(spark, d), surv_cust(spark, d)).select("feature", "coef", "se", "direction"), 5)


@query("top_genes_by_cox", with_sql(COUNTS, SURV_CUST, _GX.replace("stddev(", "stddev_pop("), *cox_sql("gx"),
       "rd AS (SELECT key, coef, row_number() OVER (ORDER BY abs(coef / se) DESC, key) AS rn FROM fit)",
       body="SELECT key AS feature, rn::INT AS position, ((rn - 1) // 5)::BIGINT AS block, CASE WHEN coef > 0 THEN -1 ELSE 1 END AS direction FROM rd WHERE rn <= 15"))
def top_cox(spark, d):
    from cohortia.operators.reshape import top_blocks
    g = sv.gene_cox(counts(spark, d), surv_cust(spark, d), scale="pop", min_n=10, min_events=5)
    return top_blocks(g, F.abs(F.col("coef") / F.col("se")), "feature", 15, 5).select("feature", "position", "block", "direction")


@query("extreme_log_hr", with_sql(SURV_LINES, "m AS (SELECT label, quantile_cont(duration, 0.5) AS med FROM surv_lines GROUP BY 1)",
       "ex AS (SELECT arg_max(label, (med, label)) AS best, arg_min(label, (med, label)) AS worst FROM m)",
       "zz AS (SELECT 1 AS key, duration, event, (label = best)::INT::DOUBLE AS x FROM surv_lines CROSS JOIN ex WHERE label = best OR label = worst)", *cox_sql("zz"),
       body=f"SELECT {r('abs(coef)', 5)} AS log_hr, 'ok' AS status FROM fit"))
def extreme(spark, d):
    return rounded(sv.extreme_log_hr(surv_lines(spark, d)), 5)


@query("hr_vs_worst_group")
def hr_worst(spark, d):
    return rounded(sv.group_cox(surv_lines(spark, d)), 5)


@query("adjusted_cox", with_sql(SURV_LINES, "zz AS (SELECT label AS key, duration, event, q AS x, x AS y FROM surv_lines)", *cox2_sql("zz"),
       body=f"SELECT key AS label, {r('coef', 5)} AS coef, {r('se', 5)} AS se, n, events, 'ok' AS status FROM fit2 JOIN (SELECT key, count(*) AS n, sum(event)::BIGINT AS events FROM zz GROUP BY 1) USING (key)"))
def adjusted(spark, d):
    s = surv_lines(spark, d).select("sample_id", "label", "duration", "event", "x", F.col("q").alias("value"))
    return rounded(cox.cox_fit(s, ["label"], ["value", "x"]).select("label", F.col("coef")[0].alias("coef"), F.col("se")[0].alias("se"), "n", "events", "status"), 5)


_DIRS = "dirs AS (SELECT DISTINCT p_brand AS feature, CASE WHEN right(p_brand, 1) IN ('1','3','5','7','9') THEN 1 ELSE -1 END AS direction FROM part)"


def _dirs(spark, d):
    b = table(spark, d, "part").select(F.col("p_brand").alias("feature")).distinct()
    return b.withColumn("direction", F.when(F.substring("feature", -1, 1).isin("1", "3", "5", "7", "9"), 1).otherwise(-1))


_SIG = """z AS (SELECT sample_id, feature, direction, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM counts JOIN dirs USING (feature) WINDOW w AS (PARTITION BY feature)),
sig AS (SELECT sample_id, coalesce(avg(z) FILTER (direction > 0), 0) - coalesce(avg(z) FILTER (direction < 0), 0) AS score FROM z GROUP BY 1)"""


@query("signature_score", with_sql(COUNTS, _DIRS, _SIG, body=f"SELECT sample_id, {r('score')} AS score FROM sig"))
def signature(spark, d):
    return rounded(sv.signature(counts(spark, d), _dirs(spark, d)))


@query("marker_transfer", with_sql(COUNTS, SURV_CUST, _DIRS, _SIG, "sp AS (SELECT score AS x, duration AS y FROM sig JOIN surv_cust USING (sample_id))",
       "k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM sp)",
       body=f"SELECT count(*) AS n, {r('corr(rx, ry)')} AS rho, CASE WHEN corr(rx, ry) > 0.15 THEN 'replicates' WHEN corr(rx, ry) < -0.15 THEN 'flips' ELSE 'near-zero' END AS interpretation FROM k"))
def transfer(spark, d):
    return rounded(sv.marker_transfer(counts(spark, d), surv_cust(spark, d), _dirs(spark, d)).drop("p"))


@query("leave_one_out_direction", with_sql(COUNTS, _DIRS, _SIG,
       "tot AS (SELECT sample_id, sum(z) FILTER (direction > 0) AS sp, count(*) FILTER (direction > 0) AS np, sum(z) FILTER (direction < 0) AS sr, count(*) FILTER (direction < 0) AS nr FROM z GROUP BY 1)",
       """l AS (SELECT feature, value, (sp - CASE WHEN direction > 0 THEN z ELSE 0 END) / (np - (direction > 0)::INT) - (sr - CASE WHEN direction < 0 THEN z ELSE 0 END) / (nr - (direction < 0)::INT) AS sig
  FROM z JOIN tot USING (sample_id) WHERE np - (direction > 0)::INT > 0 AND nr - (direction < 0)::INT > 0)""",
       "k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY round(sig, 10)) + (count(*) OVER (PARTITION BY feature, round(sig, 10)) - 1) / 2.0 AS ry FROM l)",
       body=f"SELECT feature, direction, {r('rho', 4)} AS rho, sign(rho) = direction AS match FROM (SELECT feature, corr(rx, ry) AS rho FROM k GROUP BY 1) JOIN dirs USING (feature)"))
def loo(spark, d):
    return rounded(sv.loo_direction_match(counts(spark, d), _dirs(spark, d)), 4)


@query("cohort_qc_sheet", with_sql(COUNTS, SURV_CUST, body=f"""SELECT count(*) AS n_samples, {r('quantile_cont(duration, 0.5)')} AS median_follow_up, sum(event)::BIGINT AS n_events,
 (SELECT count(DISTINCT feature) FROM counts) AS n_features, (SELECT {r('avg(sd)')} FROM (SELECT stddev(value) AS sd FROM counts GROUP BY feature)) AS mean_feature_sd FROM surv_cust"""))
def qc(spark, d):
    return rounded(sv.cohort_sheet(counts(spark, d), surv_cust(spark, d)))


@query("cross_validation_folds", """SELECT sample_id, ((row_number() OVER (ORDER BY md5('7|' || sample_id), sample_id) - 1) % 5)::INT AS fold FROM (SELECT c_custkey AS sample_id FROM customer)""")
def folds(spark, d):
    return sv.folds(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")), 5, 7)


@query("bootstrap_resample", """WITH o AS (SELECT s_suppkey AS sample_id, row_number() OVER (ORDER BY md5('11|' || s_suppkey), s_suppkey) AS rn FROM supplier),
 dr AS (SELECT rep, (('0x' || substr(md5('11|' || rep || '|' || rn), 1, 12))::BIGINT % (SELECT count(*) FROM o)) + 1 AS rn FROM o CROSS JOIN range(10) t(rep))
 SELECT rep::INT AS rep, sample_id FROM dr JOIN o USING (rn)""")
def bootstrap(spark, d):
    return sv.bootstrap_weights(table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id")), 10, 11)


@query("bootstrap_sign_stability")
def stability(spark, d):
    return rounded(sv.sign_stability(counts(spark, d), surv_cust(spark, d), 4, 3))


@query("cross_validated_signature")
def cv(spark, d):
    return rounded(sv.cv_signature(counts(spark, d), surv_cust(spark, d), 5, 3))


@query("self_capacity")
def capacity(spark, d):
    return rounded(sv.cv_signature(counts(spark, d), surv_cust(spark, d), 5, 3, top=10))


@query("leave_out_stability")
def leave_out(spark, d):
    return rounded(sv.leave_out_stability(counts(spark, d), surv_cust(spark, d), 5, 3))


def _two_cohorts(spark, d):
    c, s = cut_lineage(counts(spark, d)), cut_lineage(surv_cust(spark, d))  # each is read by both cohorts
    even = F.col("sample_id") % 2 == 0
    return c.where(even), s.where(even), c.where(~even), s.where(~even)


@query("survival_replication")
def replication(spark, d):
    ctl = [("first", ["Brand#1", "Brand#2"], "prot"), ("second", ["Brand#3", "Brand#4", "Brand#5"], "adv")]
    genes = table(spark, d, "part").select(F.col("p_brand").alias("feature")).distinct()
    return rounded(sv.survival_replication(*_two_cohorts(spark, d), genes, ctl))


@query("survival_replication_below_guard", """SELECT 0.0::DOUBLE AS score, NULL::VARCHAR AS verdict, 0::BIGINT AS n_protective, 0::BIGINT AS n_risk,
 CASE WHEN (SELECT count(*) FROM part p JOIN part q ON p.p_type = q.p_brand) = 0 THEN 'only 0 genes with a direction and external expression' END AS reason""")
def replication_below_guard(spark, d):
    """Submitted names that no cohort has measured: the report is there, with score 0 and the reason."""
    genes = table(spark, d, "part").select(F.col("p_type").alias("feature")).distinct()
    ctl = [("first", ["Brand#1", "Brand#2"], "prot")]
    return sv.survival_replication(*_two_cohorts(spark, d), genes, ctl).select("score", "verdict", "n_protective", "n_risk", "reason")


@query("quantile_summary", with_sql(COUNTS, body="SELECT feature, count(*) AS n, " + ", ".join(
    f"{r(f'quantile_cont(value, {p})')} AS p{int(p * 100)}" for p in (0.05, 0.1, 0.5, 0.9, 0.95)) + f", {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS sd FROM counts GROUP BY 1"))
def quantile_summary(spark, d):
    from cohortia.operators.aggregates import quantile_summary as qs
    return rounded(qs(counts(spark, d), ["feature"], "value"))


@query("median_split_logrank", with_sql(SURV_LINES, "m AS (SELECT quantile_cont(q, 0.5) AS med FROM surv_lines)",
       "g2 AS (SELECT duration, event, q > med AS hi FROM surv_lines CROSS JOIN m)",
       "t AS (SELECT duration, count(*) AS n, count(*) FILTER (hi) AS nh, sum(event) AS d, coalesce(sum(event) FILTER (hi), 0) AS dh FROM g2 GROUP BY 1)",
       "rk AS (SELECT d::DOUBLE AS d, dh, (sum(n) OVER w)::DOUBLE AS n, (sum(nh) OVER w)::DOUBLE AS rh FROM t WINDOW w AS (ORDER BY duration DESC))",
       body=f"SELECT {r('sum(dh - d*rh/n)^2 / sum(CASE WHEN n > 1 THEN d*(n-d)/(n-1)/(n*n)*rh*(n-rh) ELSE 0 END)')} AS chi2, 1::BIGINT AS df FROM rk WHERE d > 0"))
def median_split(spark, d):
    s = ordered.quantile_bins(surv_lines(spark, d).select("duration", "event", "q"), [], "q", 2, "label")
    return rounded(sv.logrank(s.select("duration", "event", "label"), with_p=False))
