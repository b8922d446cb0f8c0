"""Rating panels over labelled documents (three hash-perturbed passes) and run logs over events."""

from pyspark.sql import functions as F

from cohortia.plans import panels as pn
from cohortia.plans import resources as rsr
from cohortia.plans import scores as sc
from cohortia.queries import sqltails as st
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import table, with_sql

_VALS = ["data-derived", "recalled-prior", "mixed"]


def votes(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    p = j.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    h = F.substring(F.md5(F.concat_ws("|", F.lit("v"), "pass", "doc_id")), 1, 1)
    val = F.when(h < "3", "mixed").when((h < "6") != (F.col("quality") == 1), "data-derived").otherwise("recalled-prior")
    tox = F.when((h > "d") != (F.col("toxic") == 1), "high").otherwise("low")
    f = F.inline(F.array(F.struct(F.lit("identity").alias("field"), val.alias("value")), F.struct(F.lit("rigor").alias("field"), tox.alias("value"))))
    return p.select(F.col("doc_id").alias("episode"), F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("arm"), F.col("lang").alias("model"), "pass", f)


_VOTES = """vv AS (SELECT doc_id AS episode, 'g' || (doc_id % 3) AS arm, lang AS model, pass::INT AS pass, quality, toxic, substr(md5('v|' || pass || '|' || doc_id), 1, 1) AS h FROM labels JOIN documents USING (doc_id) CROSS JOIN range(1, 4) t(pass)),
votes AS (SELECT episode, arm, model, pass, 'identity' AS field, CASE WHEN h < '3' THEN 'mixed' WHEN (h < '6') <> (quality = 1) THEN 'data-derived' ELSE 'recalled-prior' END AS value FROM vv
 UNION ALL SELECT episode, arm, model, pass, 'rigor', CASE WHEN (h > 'd') <> (toxic = 1) THEN 'high' ELSE 'low' END FROM vv)"""
_MAJ = "cnt AS (SELECT model, arm, episode, field, value, count(*) AS c FROM votes GROUP BY ALL), ep AS (SELECT model, arm, episode, field, sum(c) AS n, max(c) AS top, sum(c * (c - 1)) AS same, count(*) AS k, CASE WHEN count(*) FILTER (c = mx) = 1 THEN any_value(value) FILTER (c = mx) END AS consensus FROM (SELECT *, max(c) OVER (PARTITION BY episode, field) AS mx FROM cnt) GROUP BY ALL)"


@query("judge_agreement", with_sql(_VOTES, body=f"SELECT a.model, a.field, count(*) AS n, count(*) FILTER (a.value = b.value) AS agree, {r('avg((a.value = b.value)::INT)')} AS rate FROM votes a JOIN votes b USING (episode, field) WHERE a.pass = 1 AND b.pass = 2 GROUP BY 1, 2"))
def agreement(spark, d):
    return rounded(pn.agreement(votes(spark, d), 1, 2))


@query("judge_disagreements", with_sql(_VOTES, body="SELECT field, a.value AS va, b.value AS vb, count(*) AS n FROM votes a JOIN votes b USING (episode, field) WHERE a.pass = 1 AND b.pass = 2 AND a.value <> b.value GROUP BY 1, 2, 3"))
def disagreements(spark, d):
    return pn.disagreements(votes(spark, d), 1, 2)


@query("panel_summary", with_sql(_VOTES, _MAJ, body=f"SELECT model, field, count(*) AS n_episodes, count(*) FILTER (top = n) AS unanimous, {r('sum(same) / sum(n * (n - 1))')} AS pairwise, count(*) FILTER (consensus IS NULL) AS no_majority FROM ep GROUP BY 1, 2"))
def panel(spark, d):
    return rounded(pn.panel_summary(votes(spark, d)))


@query("rate_spread", with_sql(_VOTES, _MAJ, "ps AS (SELECT model, pass, avg((value = 'data-derived')::INT) AS r FROM votes WHERE field = 'identity' GROUP BY 1, 2)",
       body=f"SELECT model, (SELECT count(*) FROM ep e WHERE e.model = ps.model AND field = 'identity') AS n, (SELECT {r('''avg((coalesce(consensus, '') = 'data-derived')::INT)''')} FROM ep e WHERE e.model = ps.model AND field = 'identity') AS consensus_rate, (SELECT count(*) FROM ep e WHERE e.model = ps.model AND field = 'identity' AND consensus IS NULL) AS unresolved, {r('min(r)')} AS min_rate, {r('max(r)')} AS max_rate, {r('max(r) - min(r)')} AS spread FROM ps GROUP BY 1"))
def spread(spark, d):
    return rounded(pn.rate_spread(votes(spark, d), "identity", "data-derived"))


@query("coverage_evenness", with_sql(_VOTES, "n AS (SELECT model, pass, count(DISTINCT episode) AS n FROM votes WHERE NOT (pass = 3 AND episode % 10 = 0) GROUP BY 1, 2)", body="SELECT model, count(*) AS passes, min(n) AS fewest, max(n) AS most, min(n) = max(n) AS even FROM n GROUP BY 1"))
def even(spark, d):
    return pn.coverage_evenness(votes(spark, d).where("NOT (pass = 3 AND episode % 10 = 0)"))


@query("field_distributions", with_sql(_VOTES, body="SELECT model, arm, " + ", ".join(f"count(*) FILTER (value = '{v}') AS \"{v}\"" for v in _VALS) + " FROM votes WHERE field = 'identity' GROUP BY 1, 2"))
def distributions(spark, d):
    return pn.distributions(votes(spark, d).where("field = 'identity'"), _VALS, ["model", "arm"])


@query("strategy_cross_tab", with_sql(_VOTES, "x AS (SELECT * FROM votes WHERE field = 'identity')", "g AS (SELECT model, arm, count(*) FILTER (value = 'data-derived') AS \"data-derived\", count(*) FILTER (value = 'recalled-prior') AS \"recalled-prior\", count(*) FILTER (value = 'mixed') AS mixed, count(*) AS n, grouping(arm)::TINYINT AS pooled FROM x GROUP BY GROUPING SETS ((model, arm), (model)))",
       body=f"SELECT g.*, {r('n / CASE WHEN pooled = 1 THEN (SELECT count(*) FROM x) ELSE (SELECT count(*) FROM x WHERE x.arm = g.arm) END')} AS share FROM g"))
def cross(spark, d):
    return rounded(pn.cross_tab(votes(spark, d).where("field = 'identity'"), "model", "value", _VALS))


_EV = "ev AS (SELECT event_id, 'g' || (user_id % 3) AS arm, event_type, value, event_type IN ('click', 'view') AS e FROM events)"


def _ev(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("arm"), "event_type", "value")


@query("process_vs_correct", with_sql(_EV, "m AS (SELECT median(value) AS c FROM ev)", body="SELECT arm, count(*) FILTER (e AND value >= c) AS derived_correct, count(*) FILTER (NOT e AND value >= c) AS recalled_correct, count(*) FILTER (e AND value < c) AS derived_wrong, count(*) FILTER (NOT e AND value < c) AS recalled_wrong, count(*) AS n FROM ev CROSS JOIN m GROUP BY ROLLUP (arm)"))
def process(spark, d):
    return pn.process_vs_correct(_ev(spark, d), F.col("event_type").isin("click", "view"), "value")


@query("rate_shift", with_sql(_VOTES, body=f"""SELECT field, {r("avg((value IN ('data-derived', 'high'))::INT) FILTER (arm = 'g0')")} AS rate_low, {r("avg((value IN ('data-derived', 'high'))::INT) FILTER (arm = 'g2')")} AS rate_high, {r("avg((value IN ('data-derived', 'high'))::INT) FILTER (arm = 'g2') - avg((value IN ('data-derived', 'high'))::INT) FILTER (arm = 'g0')")} AS shift FROM votes GROUP BY 1"""))
def shift(spark, d):
    return rounded(pn.rate_shift(votes(spark, d), "field", F.col("value").isin("data-derived", "high"), "g0", "g2"))


@query("ordinal_score", with_sql(_VOTES, body=f"SELECT episode, {r('''sum(CASE value WHEN 'data-derived' THEN 1.0 WHEN 'recalled-prior' THEN 0.25 WHEN 'high' THEN 1.0 ELSE 0 END * CASE field WHEN 'identity' THEN 2.0 ELSE 1.0 END)''')} AS score FROM votes WHERE pass = 1 GROUP BY 1"))
def ordinal(spark, d):
    lv = votes(spark, d).where("pass = 1").select("episode", F.col("field").alias("decision"), F.col("value").alias("level"))
    return rounded(pn.ordinal_score(lv, {"data-derived": 1.0, "recalled-prior": 0.25, "mixed": 0.0, "high": 1.0}, {"identity": 2.0, "rigor": 1.0}))


_RK = {"data-derived": 2, "mixed": 1, "recalled-prior": 0}
_OUT = "o AS (SELECT episode, model, arm, value AS deriv, n_chars::DOUBLE AS outcome FROM votes JOIN documents ON doc_id = episode WHERE field = 'identity' AND pass = 1)"


def _outcome(spark, d):
    v = votes(spark, d).where("field = 'identity' AND pass = 1")
    return v.join(table(spark, d, "documents").select(F.col("doc_id").alias("episode"), F.col("n_chars").cast("double").alias("outcome")), "episode").withColumnRenamed("value", "deriv")


@query("outcome_by_derivation", with_sql(_VOTES, _OUT, body=f"SELECT deriv, count(*) AS n, {r('avg(outcome)', 4)} AS mean, {r('stddev_pop(outcome)', 4)} AS sd FROM o GROUP BY 1"))
def by_deriv(spark, d):
    return rounded(pn.outcome_by_derivation(_outcome(spark, d), "deriv", "outcome", "data-derived", _RK)["groups"], 4)


@query("outcome_rank_test", with_sql(_VOTES, _OUT, "z AS (SELECT deriv = 'data-derived' AS d, rank() OVER (ORDER BY outcome) + (count(*) OVER (PARTITION BY outcome) - 1) / 2.0 AS rk FROM o WHERE deriv <> 'mixed')", body=f"SELECT count(*) FILTER (d)::DOUBLE AS n1, count(*) FILTER (NOT d)::DOUBLE AS n2, {r('sum(rk) FILTER (d) - count(*) FILTER (d) * (count(*) FILTER (d) + 1) / 2.0')} AS u FROM z"))
def rank_test(spark, d):
    t = pn.outcome_by_derivation(_outcome(spark, d), "deriv", "outcome", "data-derived", _RK)["mann_whitney"]
    return rounded(t.select(F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), "u"))


@query("within_arm_difference", with_sql(_VOTES, _OUT, body=f"SELECT model, arm, count(*) FILTER (deriv = 'data-derived') AS n_derived, count(*) FILTER (deriv <> 'data-derived') AS n_not, {r('''avg(outcome) FILTER (deriv = 'data-derived')''', 4)} AS derived, {r('''avg(outcome) FILTER (deriv <> 'data-derived')''', 4)} AS not_derived, {r('''avg(outcome) FILTER (deriv = 'data-derived') - avg(outcome) FILTER (deriv <> 'data-derived')''', 4)} AS delta FROM o GROUP BY 1, 2 HAVING count(*) FILTER (deriv = 'data-derived') >= 3 AND count(*) FILTER (deriv <> 'data-derived') >= 3"))
def within(spark, d):
    return rounded(pn.within_arm_difference(_outcome(spark, d), F.col("deriv") == "data-derived", "outcome", ["model", "arm"]), 4)


_GATE = "gt AS (SELECT arm, e, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'mislead_cohort' WHEN 'view' THEN CASE WHEN value > 50 THEN 'mislead_cohort' ELSE 'true_cohort' END ELSE 'true_cohort' END AS verdict, event_type <> 'signup' AND value > 15 AS derived FROM ev)"


def _gate(spark, d):
    t, v = F.col("event_type"), F.col("value")
    verdict = F.when(t == "error", "error").when((t == "purchase") | ((t == "view") & (v > 50)), "mislead_cohort").otherwise("true_cohort")
    return _ev(spark, d).select("arm", verdict.alias("verdict"), ((t != "signup") & (v > 15)).alias("derived"))


@query("fooled_by_derivation", with_sql(_EV, _GATE, "t AS (SELECT arm, count(*) FILTER (derived AND verdict = 'mislead_cohort') AS a, count(*) FILTER (derived AND verdict = 'true_cohort') AS b, count(*) FILTER (NOT derived AND verdict = 'mislead_cohort') AS c, count(*) FILTER (NOT derived AND verdict = 'true_cohort') AS d, count(*) FILTER (verdict = 'error') AS excluded_errors FROM gt GROUP BY 1)",
       body=f"SELECT *, {r(st.fisher2('a', 'b', 'c', 'd'))} AS p, {r('a * d / nullif(b * c, 0)')} AS odds_ratio FROM t"))
def fooled(spark, d):
    return rounded(pn.fooled_by_derivation(_gate(spark, d), F.col("derived"), by=["arm"]))


@query("gate_tally", with_sql(_EV, _GATE, body=f"SELECT arm, count(*) AS n, count(*) FILTER (verdict = 'mislead_cohort') AS mislead_cohort, count(*) FILTER (verdict = 'true_cohort') AS true_cohort, count(*) FILTER (verdict = 'error') AS errored, {r('''avg((verdict = 'mislead_cohort')::INT) FILTER (verdict <> 'error')''')} AS rate FROM gt GROUP BY 1"))
def tally(spark, d):
    return rounded(pn.gate_tally(_gate(spark, d), ["mislead_cohort", "true_cohort"]))


@query("verdict_problems", with_sql(_VOTES, body="SELECT episode, pass, 'missing rigor' AS problem FROM votes WHERE field = 'rigor' AND episode % 11 = 0 UNION ALL SELECT episode, pass, 'illegal identity=mixed' FROM votes WHERE field = 'identity' AND value = 'mixed'"))
def problems(spark, d):
    v = votes(spark, d).withColumn("value", F.when((F.col("field") == "rigor") & (F.col("episode") % 11 == 0), "").otherwise(F.col("value")))
    rec = v.groupBy("episode", "pass").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    dom = spark.createDataFrame([("identity", "data-derived"), ("identity", "recalled-prior"), ("rigor", "high"), ("rigor", "low")], "field string, value string")
    return pn.verdict_problems(rec, dom, ["identity", "rigor"])


@query("judge_coverage", with_sql(_VOTES, body="SELECT pass, count(DISTINCT episode) AS judged, (SELECT count(*) FROM documents) AS n_episodes, (SELECT count(*) FROM documents) - count(DISTINCT episode) AS missing FROM votes GROUP BY 1"))
def coverage(spark, d):
    return pn.judge_coverage(votes(spark, d), table(spark, d, "documents").select("doc_id"))


_SC = "sc AS (SELECT user_id % 25 AS arm, event_type = 'view' AS derived, event_type IN ('view', 'click') AS grounded, value > 80 AS cl, value < 1 AS pc, value AS outcome FROM events)"


def _shortcut(spark, d):
    t, v = F.col("event_type"), F.col("value")
    e = table(spark, d, "events").select((F.col("user_id") % 25).alias("arm"), (t == "view").alias("derived"), t.isin("view", "click").alias("grounded"), (v > 80).alias("count_leak"), (v < 1).alias("path_cited"), v.alias("outcome"))
    return pn.shortcut_report(e)


@query("shortcut_report", with_sql(_SC, body=f"SELECT arm, count(*) AS n, count(*) FILTER (derived) AS derived, count(*) FILTER (grounded) AS grounded, count(*) FILTER (cl) AS count_leak, count(*) FILTER (pc) AS path_cited, count(*) FILTER (cl OR pc) AS any_shortcut, {r('avg((cl OR pc)::INT)')} AS shortcut_rate, {r('avg(outcome)')} AS outcome FROM sc GROUP BY 1"))
def shortcut(spark, d):
    return rounded(_shortcut(spark, d))


@query("shortcut_vs_outcome", with_sql(_SC, "a AS (SELECT avg((cl OR pc)::INT) AS x, avg(outcome) AS y FROM sc GROUP BY arm)", "k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) AS ry FROM a)", body=f"SELECT count(*) AS n, {r('corr(rx, ry)')} AS rho FROM k"))
def shortcut_rho(spark, d):
    return rounded(pn.shortcut_vs_outcome(_shortcut(spark, d)).drop("p"))


@query("ablation_deltas", f"SELECT event_type, {r('avg(value) FILTER (user_id % 2 = 0)')} AS mean_detailed, {r('avg(value) FILTER (user_id % 2 = 1)')} AS mean_lean, {r('avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 = 1)')} AS mean_delta, {r('stddev(value) FILTER (user_id % 2 = 0)')} AS sd_detailed, {r('stddev(value) FILTER (user_id % 2 = 1)')} AS sd_lean, {r('stddev(value) FILTER (user_id % 2 = 0) - stddev(value) FILTER (user_id % 2 = 1)')} AS sd_delta FROM events GROUP BY 1")
def ablation(spark, d):
    e = table(spark, d, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "detailed").otherwise("lean"))
    m = e.groupBy("event_type", "side").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"))
    return rounded(pn.ablation_deltas(m, "event_type", "side", "detailed", "lean", ["mean", "sd"]))


@query("component_means", f"WITH m AS (SELECT user_id % 10 AS model, event_type AS component, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1, 2) SELECT component, model, {r('mean')} AS mean, n, {r('max(mean) OVER (PARTITION BY component)')} AS best, mean < 0.95 * max(mean) OVER (PARTITION BY component) AS below_peers FROM m")
def components(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("model"), F.col("event_type").alias("component"), F.col("value").alias("raw"))
    return rounded(pn.component_means(e, ["model"], 0.95))


@query("volume_vs_grounding", with_sql(_VOTES, "v AS (SELECT lang AS cohort, count(*) AS papers FROM documents GROUP BY 1)", body=f"SELECT model AS cohort, count(*) AS n, {r('''avg((value = 'data-derived')::INT)''')} AS grounded_rate, any_value(papers) AS papers FROM votes JOIN v ON cohort = model WHERE field = 'identity' GROUP BY 1"))
def volume(spark, d):
    e = votes(spark, d).where("field = 'identity'").select(F.col("model").alias("cohort"), (F.col("value") == "data-derived").alias("grounded"))
    return rounded(pn.volume_vs_grounding(e, table(spark, d, "documents").groupBy(F.col("lang").alias("cohort")).agg(F.count(F.lit(1)).alias("papers"))))


@query("probe_agreement", with_sql(_VOTES, body=f"SELECT a.field, count(*) AS n, count(*) FILTER (a.value IS NOT DISTINCT FROM b.value) AS agree, {r('avg((a.value IS NOT DISTINCT FROM b.value)::INT)')} AS rate FROM (SELECT * FROM votes WHERE pass = 1) a LEFT JOIN (SELECT * FROM votes WHERE pass = 2 AND episode % 7 <> 0) b USING (episode, field) GROUP BY 1"))
def probes(spark, d):
    v = votes(spark, d).withColumnRenamed("episode", "probe")
    return rounded(pn.probe_agreement(v.where("pass = 1").select("probe", "field", "value"), v.where("pass = 2 AND probe % 7 <> 0").select("probe", "field", "value")))


@query("probe_mismatches", with_sql(_VOTES, body="SELECT a.episode AS probe, field, a.value, b.value AS got FROM (SELECT * FROM votes WHERE pass = 1) a LEFT JOIN (SELECT * FROM votes WHERE pass = 2 AND episode % 7 <> 0) b USING (episode, field) WHERE a.value IS DISTINCT FROM b.value"))
def mismatches(spark, d):
    v = votes(spark, d).withColumnRenamed("episode", "probe")
    return pn.probe_mismatches(v.where("pass = 1").select("probe", "field", "value"), v.where("pass = 2 AND probe % 7 <> 0").select("probe", "field", "value"))


@query("any_vote", with_sql(_VOTES, body="SELECT model, field, value, count(DISTINCT episode) AS n_episodes FROM votes GROUP BY 1, 2, 3"))
def any_vote(spark, d):
    return pn.any_vote(votes(spark, d))


# ---- weighted scores ----------------------------------------------------------------------------------------------

_COMP = """cp AS (SELECT user_id AS episode, CASE event_type WHEN 'view' THEN 'structure_validity' WHEN 'click' THEN 'clinical_signal' WHEN 'purchase' THEN 'pathway_validity' WHEN 'signup' THEN 'mechanism_grounding' ELSE 'marker_evidence' END AS component, least(avg(value) / 100, 1.0) AS raw FROM events GROUP BY 1, 2),
w AS (SELECT * FROM (VALUES ('structure_validity', 2.0), ('clinical_signal', 3.0), ('pathway_validity', 1.0), ('mechanism_grounding', 2.0), ('marker_evidence', 2.0)) t(component, weight))"""


def _components(spark, d):
    names = {"view": "structure_validity", "click": "clinical_signal", "purchase": "pathway_validity", "signup": "mechanism_grounding", "error": "marker_evidence"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table(spark, d, "events").groupBy(F.col("user_id").alias("episode"), F.element_at(m, F.col("event_type")).alias("component")).agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("raw"))


@query("weighted_total", with_sql(_COMP, body=f"SELECT episode, {r('''sum(raw * weight * CASE WHEN episode % 5 = 0 AND component IN ('mechanism_grounding', 'pathway_validity') THEN 0 ELSE 1 END)''')} AS total, {r('''sum(raw * weight * CASE WHEN episode % 5 = 0 AND component IN ('mechanism_grounding', 'pathway_validity') THEN 0 ELSE 1 END) / 14.0''')} AS normalised, episode % 5 = 0 AS gated FROM cp JOIN w USING (component) GROUP BY 1"))
def weighted(spark, d):
    c = _components(spark, d)
    gate = c.select("episode", (F.col("episode") % 5 == 0).alias("fooled")).distinct()
    return rounded(sc.weighted_total(c, gate))


@query("phase_composite", with_sql("p AS (SELECT user_id AS episode, CASE event_type WHEN 'view' THEN 'structure_validity' WHEN 'click' THEN 'survival_stratification' WHEN 'purchase' THEN 'exam_data_lock_quality' WHEN 'signup' THEN 'target_coexpr_replication' ELSE 'target_survival_replication' END AS component, least(avg(value) / 100, 1.0) AS raw FROM events GROUP BY 1, 2)",
       "t AS (SELECT episode, sum(raw * CASE component WHEN 'structure_validity' THEN 2.0 WHEN 'survival_stratification' THEN 3.0 WHEN 'exam_data_lock_quality' THEN 1.0 ELSE 0 END) AS i, sum(raw * CASE component WHEN 'target_coexpr_replication' THEN 2.0 WHEN 'target_survival_replication' THEN 3.0 ELSE 0 END) AS e, count(*) FILTER (component LIKE 'exam%') AS ne, count(*) FILTER (component LIKE 'target%') AS nx FROM p GROUP BY 1)",
       "q AS (SELECT episode, i + e AS total, i / (16.0 + CASE WHEN ne > 0 THEN 3.0 ELSE 0 END) AS internal, CASE WHEN nx > 0 THEN e / 5.0 ELSE 0 END AS external FROM t)",
       body=f"SELECT episode, {r('total')} AS total, {r('internal')} AS internal_norm, {r('external')} AS external_norm, {r('CASE WHEN internal > 0 AND external > 0 THEN sqrt(internal * external) ELSE 0 END')} AS composite FROM q"))
def phases(spark, d):
    names = {"view": "structure_validity", "click": "survival_stratification", "purchase": "exam_data_lock_quality", "signup": "target_coexpr_replication", "error": "target_survival_replication"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("episode"), F.element_at(m, F.col("event_type")).alias("component")).agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("raw"))
    return rounded(sc.phase_composite(c))


@query("support_flags", with_sql("v AS (SELECT doc_id AS episode, unnest(['d1_partition', 'd2_identity', 'd3_mechanism']) AS decision, unnest([0, 1, 2]) AS i, quality, toxic, substr(md5('s|' || doc_id), 1, 3) AS h FROM labels)",
       "x AS (SELECT episode, decision, CASE WHEN substr(h, i + 1, 1) < '6' THEN 'grounded' WHEN substr(h, i + 1, 1) < 'b' THEN 'unsupported' ELSE 'anchored' END AS support, CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 1 THEN 'none' ELSE 'resolved' END AS contradiction FROM v)",
       body=f"SELECT episode, {r('''sum(CASE support WHEN 'grounded' THEN 1.0 WHEN 'unsupported' THEN 0.25 ELSE 0 END * CASE decision WHEN 'd3_mechanism' THEN 1.0 ELSE 2.0 END)''')} AS score, count(*) FILTER ((support = 'grounded' AND contradiction = 'ignored') OR (support = 'anchored' AND contradiction = 'none')) AS n_flags FROM x GROUP BY 1"))
def support(spark, d):
    lab = table(spark, d, "labels")
    h = F.md5(F.concat_ws("|", F.lit("s"), "doc_id"))
    con = F.when(F.col("toxic") == 1, "ignored").when(F.col("quality") == 1, "none").otherwise("resolved")

    def sup(i):
        x = F.substring(h, i + 1, 1)
        return F.when(x < "6", "grounded").when(x < "b", "unsupported").otherwise("anchored")
    recs = F.array(*[F.struct(F.lit(n).alias("decision"), sup(i).alias("support"), con.alias("contradiction")) for i, n in enumerate(("d1_partition", "d2_identity", "d3_mechanism"))])
    lv = lab.select(F.col("doc_id").alias("episode"), F.inline(recs))
    return rounded(sc.support_score(lv).select("episode", "score", F.size("flags").cast("long").alias("n_flags")))


# ---- run logs -----------------------------------------------------------------------------------------------------

_LOG = """us AS (SELECT user_id AS episode, CASE WHEN user_id % 6 <> 0 THEN (props::JSON->>'$.k')::BIGINT END AS input_tokens, CASE WHEN user_id % 6 <> 0 THEN event_id % 50 END AS output_tokens, CASE WHEN user_id % 2 = 0 THEN value END AS api_s FROM events WHERE event_type <> 'error'),
u AS (SELECT episode, count(*) AS n_turns, count(input_tokens) AS nu, coalesce(sum(input_tokens), 0)::BIGINT AS i, coalesce(sum(output_tokens), 0)::BIGINT AS o, sum(api_s) AS api_s FROM us GROUP BY 1),
t AS (SELECT user_id AS episode, count(*) AS ne, sum(value / 10) AS ex, count(*) FILTER (value > 50) AS nt FROM events WHERE event_type IN ('error', 'click') GROUP BY 1),
w AS (SELECT user_id AS episode, sum(value) * 2 AS wall_s FROM events GROUP BY 1)"""


def _episodes(spark, d):
    e = table(spark, d, "events")
    known = F.col("user_id") % 6 != 0
    us = e.where("event_type <> 'error'").select(F.col("user_id").alias("episode"), F.when(known, F.get_json_object("props", "$.k").cast("long")).alias("input_tokens"), F.when(known, F.col("event_id") % 50).alias("output_tokens"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("api_s"), F.lit(0).alias("retries"))
    t = e.where("event_type IN ('error', 'click')").select(F.col("user_id").alias("episode"), (F.col("value") / 10).alias("exec_time_s"), (F.col("event_type") == "error").alias("is_error"), (F.col("value") > 50).alias("timed_out"))
    w = e.groupBy(F.col("user_id").alias("episode")).agg((F.sum("value") * 2).alias("wall_s"))
    return rsr.summarise_episodes(us, t, w)


@query("episode_resources", with_sql(_LOG, body=f"""SELECT episode, coalesce(n_turns, 0) AS n_turns, coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(nu, 0) > 0 AS tokens_reported, api_s IS NOT NULL AS api_time_measured, {r('api_s', 4)} AS api_s, {r('coalesce(ex, 0)', 4)} AS exec_s, coalesce(nt, 0) AS n_exec_timeouts,
 {r('100 * coalesce(ex, 0) / wall_s', 4)} AS pct_exec, {r('100 * api_s / wall_s', 4)} AS pct_api, {r('greatest(0, wall_s - api_s - coalesce(ex, 0))', 4)} AS unaccounted_s FROM w LEFT JOIN u USING (episode) LEFT JOIN t USING (episode)""".replace("(round((greatest(0, wall_s", "(CASE WHEN api_s IS NOT NULL THEN round((greatest(0, wall_s").replace("coalesce(ex, 0)))::DOUBLE, 4) + 0.0) AS unaccounted_s", "coalesce(ex, 0)))::DOUBLE, 4) + 0.0 END) AS unaccounted_s")))
def resources(spark, d):
    return rounded(_episodes(spark, d).select("episode", "n_turns", "input_tokens", "output_tokens", "tokens_reported", "api_time_measured", "api_s", "exec_s", "n_exec_timeouts", "pct_exec", "pct_api", "unaccounted_s"), 4)


@query("resources_by_arm", with_sql(_LOG, "e AS (SELECT (episode % 2)::VARCHAR AS run, (episode % 4)::VARCHAR AS arm, coalesce(nu, 0) > 0 AS ok, coalesce(i, 0) AS i, coalesce(o, 0) AS o, wall_s FROM w LEFT JOIN u USING (episode))",
       body=f"SELECT run, arm, grouping_id(run, arm)::BIGINT AS level, count(*) AS n, count(*) FILTER (ok) AS n_with_tokens, {r('avg(i) FILTER (ok)', 4)} AS mean_input, {r('avg(o) FILTER (ok)', 4)} AS mean_output, {r('avg(wall_s) FILTER (ok)', 4)} AS mean_wall, sum(i)::BIGINT AS total_input, sum(o)::BIGINT AS total_output FROM e GROUP BY ROLLUP (run, arm)"))
def by_arm(spark, d):
    e = _episodes(spark, d).withColumn("run", (F.col("episode") % 2).cast("string")).withColumn("arm", (F.col("episode") % 4).cast("string"))
    return rounded(rsr.by_arm(e), 4)


@query("cost_report", f"""WITH x AS (SELECT role AS model, conv_id, CASE WHEN turn % 3 <> 0 THEN turn * 100 END AS it, CASE WHEN turn % 3 <> 0 THEN turn * 10 END AS ot, text, CASE role WHEN 'user' THEN 3.0 WHEN 'assistant' THEN 15.0 ELSE 1.0 END AS ip, CASE role WHEN 'user' THEN 15.0 WHEN 'assistant' THEN 75.0 ELSE 5.0 END AS op FROM conversations),
 y AS (SELECT model, conv_id, it IS NOT NULL AS m, coalesce(it, length(text) // 4) AS i, coalesce(ot, 0) AS o, (coalesce(it, length(text) // 4) * ip + coalesce(ot, 0) * op) / 1e6 AS c FROM x), e AS (SELECT model, conv_id, sum(i) AS i, sum(o) AS o, sum(c) AS c, sum(CASE WHEN m THEN c ELSE 0 END) AS cm FROM y GROUP BY 1, 2)
 SELECT model, count(*) AS n_episodes, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, {r('sum(c)')} AS cost, {r('sum(cm)')} AS measured_cost, {r('sum(c) - sum(cm)')} AS estimated_cost, {r('avg(c)')} AS cost_per_episode, {r('sum(c) / sum(i + o) * 1e7')} AS cost_per_10m FROM e GROUP BY 1""")
def cost(spark, d):
    prices = spark.createDataFrame([("user", 3.0, 15.0), ("assistant", 15.0, 75.0), ("system", 1.0, 5.0)], "model string, in_price double, out_price double")
    known = F.col("turn") % 3 != 0
    u = table(spark, d, "conversations").select(F.col("role").alias("model"), F.col("conv_id").alias("episode"), F.when(known, F.col("turn") * 100).alias("input_tokens"), F.when(known, F.col("turn") * 10).alias("output_tokens"), "text")
    return rounded(rsr.cost(u, prices, ["model"]))
