"""Transcript analytics over conversations: an assistant turn is a call with its reasoning, the next user turn its result."""

from pyspark.sql import functions as F

from cohortia.functions import text as tx
from cohortia.plans import transcripts as tr
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import table, with_sql

_TOOLS = ["run_code", "record_observation", "submit_data_lock"]


def blocks(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("msg_ix"), "role", "text")
    use_id = F.concat_ws("-", "episode", "msg_ix")
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), ((F.col("episode") + F.col("msg_ix")) % 3 + 1).cast("int"))
    null = F.lit(None).cast("string")
    says = c.where("role = 'assistant'").select("episode", "msg_ix", F.lit(0).alias("block_ix"), "role", F.lit("text").alias("type"), "text", null.alias("name"), null.alias("id"), null.alias("input"), null.alias("tool_use_id"), null.alias("content"))
    uses = c.where("role = 'assistant'").select("episode", "msg_ix", F.lit(1), "role", F.lit("tool_use"), null, tool, use_id, "text", null, null)
    res = c.where("role = 'user'").select("episode", "msg_ix", F.lit(0), "role", F.lit("tool_result"), null, null, null, null, F.concat_ws("-", F.col("episode"), F.col("msg_ix") - 1), "text")
    return says.union(uses).union(res)


_CALLS = """calls AS (SELECT conv_id AS episode, turn AS msg_ix, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS call_num, ['run_code', 'record_observation', 'submit_data_lock'][((conv_id + turn) % 3) + 1] AS tool,
  text AS input, trim(text, ' ') AS reasoning, coalesce((SELECT max(n.text) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND n.role = 'user'), '') AS output FROM conversations c WHERE role = 'assistant')"""
_CODE = {"has_tion": "tion", "has_ing": r"ing\b|ung\b"}
_REAS = {"has_the": r"\bthe\b.*\bthe\b", "has_accent": "é|ü"}


@query("trace_calls", with_sql(_CALLS, body="SELECT episode, call_num, tool, length(reasoning) AS reasoning_chars, (length(input) - length(replace(input, chr(10), '')) + 1) AS input_lines, length(output) AS output_chars, substr(output, 1, 300) AS output_preview FROM calls").replace("length(reasoning) AS", "length(reasoning)::INT AS").replace("+ 1) AS input_lines", "+ 1)::INT AS input_lines").replace("length(output) AS", "length(output)::INT AS"))
def trace(spark, d):
    return tr.trace_calls(blocks(spark, d)).select("episode", "call_num", "tool", "reasoning_chars", "input_lines", "output_chars", "output_preview")


@query("call_features", with_sql(_CALLS, body="""SELECT episode, call_num, tool, substr(regexp_extract(input, '([A-Z][a-z]+) ', 1), 1, 200) AS why, substr(regexp_extract(input, ' ([a-z]+)\\.', 1), 1, 160) AS expects,
 NULL::INT AS stage_num, nullif(trim(regexp_extract(input, '(\\d*)([a-z]{9,})', 2)), '') AS stage_label, regexp_matches(output, 'tion|ung') AS is_error FROM calls"""))
def features(spark, d):
    return tr.call_features(tr.trace_calls(blocks(spark, d)), r"([A-Z][a-z]+) ", r" ([a-z]+)\.", r"(\d*)([a-z]{9,})", "tion|ung")


@query("behaviour_flags", with_sql(_CALLS, body="SELECT episode, bool_or(regexp_matches(lower(input), 'tion')) AS has_tion, bool_or(regexp_matches(lower(input), 'ing\\b|ung\\b')) AS has_ing, bool_or(regexp_matches(lower(reasoning), '\\bthe\\b.*\\bthe\\b')) AS has_the, bool_or(regexp_matches(lower(reasoning), 'é|ü')) AS has_accent FROM calls GROUP BY 1"))
def flags(spark, d):
    return tr.behaviour_flags(tr.trace_calls(blocks(spark, d)), _CODE, _REAS)


@query("behaviour_flags_default", with_sql(_CALLS, body="SELECT episode, " + ", ".join(f"bool_or(regexp_matches(lower(input), '{p}')) AS {n}" for n, p in tr.CODE_FAMILIES.items()) + ", " + ", ".join(f"bool_or(regexp_matches(lower(reasoning), '{p}')) AS {n}" for n, p in tr.REASONING_FAMILIES.items()) + " FROM calls GROUP BY 1"))
def flags_default(spark, d):
    return tr.behaviour_flags(tr.trace_calls(blocks(spark, d)))


@query("statistic_mentions", "SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[:4] AS mentions FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '([a-z]+tion|[a-z]+ing)', 1), lambda x: trim(x)) AS l FROM documents)")
def mentions(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", tr.statistic_mentions(t, "text", "([a-z]+tion|[a-z]+ing)").alias("mentions"))


def _unicode_edges(p):
    """DuckDB's word boundary is ASCII only; spell out the Unicode one that the patterns mean."""
    edge = r"[^\pL\pN_]"
    for w in ("hr", "ci"):
        p = p.replace(rf"\b{w}\b", f"(?:^|{edge}){w}(?:$|{edge})")
    return p.replace(r"[123]\b", f"[123](?:$|{edge})")


@query("report_section_coverage", "SELECT doc_id, n_sections, round(n_sections / 5.0, 6) + 0.0 AS score FROM (SELECT doc_id, (" + " + ".join(f"regexp_matches(lower(text), '{_unicode_edges(p)}')::INT" for p in tr.REPORT_SECTIONS.values()) + ")::INT AS n_sections FROM documents)")
def sections(spark, d):
    return rounded(tr.section_coverage(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "n_sections", "score"))


@query("merge_run_logs", with_sql(_CALLS, "cc AS (SELECT episode, call_num, row_number() OVER (PARTITION BY episode ORDER BY call_num) - 1 AS exec_num FROM calls WHERE tool = 'run_code')",
       body=f"""SELECT c.episode, c.call_num, c.tool, CASE WHEN exec_num < 2 THEN {r('(c.episode * 7 + exec_num) % 50 / 10.0')} END AS exec_time_s, CASE WHEN exec_num < 2 THEN (c.episode + exec_num) % 9 = 0 END AS is_error, length(c.input)::INT AS output_tokens
 FROM calls c LEFT JOIN cc USING (episode, call_num)"""))
def run_logs(spark, d):
    c = tr.trace_calls(blocks(spark, d))
    eps = table(spark, d, "conversations").select(F.col("conv_id").alias("episode")).distinct()
    t = eps.select("episode", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("exec_num"))
    t = t.withColumn("exec_time_s", (F.col("episode") * 7 + F.col("exec_num")) % 50 / 10.0).withColumn("is_error", (F.col("episode") + F.col("exec_num")) % 9 == 0)
    u = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("episode"), F.col("turn").alias("msg_ix"), F.length("text").alias("output_tokens"))
    return rounded(tr.merge_run_logs(c, t, u).select("episode", "call_num", "tool", "exec_time_s", "is_error", "output_tokens"))


@query("text_after_marker", with_sql(_CALLS, "m AS (SELECT episode, min(msg_ix) AS mk FROM calls WHERE tool = 'submit_data_lock' GROUP BY 1)", body="SELECT episode, msg_ix, input AS text FROM calls JOIN m USING (episode) WHERE msg_ix > mk"))
def after(spark, d):
    return tr.text_after_marker(blocks(spark, d), "submit_data_lock").select("episode", "msg_ix", "text")


def _staged(spark, d):
    e = table(spark, d, "events")
    st = F.when(F.col("event_id") % 4 != 0, (F.col("value") * 100).cast("long") % 6)
    return e.select(F.col("user_id").alias("episode"), F.col("event_id").alias("call_num"), st.cast("int").alias("stage_num"), F.when(st.isNotNull(), F.concat(F.lit("Stage "), F.col("event_type"))).alias("stage_label"))


_ST = "st AS (SELECT user_id AS episode, event_id AS call_num, CASE WHEN event_id % 4 <> 0 THEN trunc(value * 100)::BIGINT % 6 END AS stage_num, 'Stage ' || event_type AS stage_label FROM events)"


@query("stage_usage", with_sql(_ST, "n AS (SELECT episode, stage_num, stage_label, count(*) AS k FROM st WHERE stage_num IS NOT NULL GROUP BY 1, 2, 3)", body="SELECT episode, stage_num::INT AS stage_num, sum(k)::BIGINT AS n_calls, arg_min(stage_label, (-k, stage_label)) AS canonical FROM n GROUP BY 1, 2"))
def usage(spark, d):
    return tr.stage_usage(_staged(spark, d))


@query("stage_moves", with_sql(_ST, "l AS (SELECT *, lag(stage_num) OVER (PARTITION BY episode ORDER BY call_num) AS p FROM st WHERE stage_num IS NOT NULL)",
       body="SELECT episode, call_num, p::INT AS from_stage, stage_num::INT AS to_stage, CASE WHEN stage_num > p + 1 THEN 'skip' ELSE 'regression' END AS kind FROM l WHERE stage_num > p + 1 OR stage_num < p"))
def moves(spark, d):
    return tr.stage_moves(_staged(spark, d))


@query("carried_stage", with_sql(_ST, body="SELECT episode, call_num, (last_value(stage_num IGNORE NULLS) OVER (PARTITION BY episode ORDER BY call_num))::INT AS stage_num FROM st"))
def carried(spark, d):
    return tr.carried_stage(_staged(spark, d))


@query("episode_index", with_sql(_CALLS, body="SELECT episode, count(*) AS n_calls, count(*) FILTER (regexp_matches(output, 'Traceback|Error:')) AS n_errors, count(DISTINCT tool) AS n_tools, min(call_num) FILTER (regexp_matches(input, 'tion')) AS first_tion_at, min(call_num) FILTER (regexp_matches(input, 'é')) AS first_accent_at FROM calls GROUP BY 1"))
def index(spark, d):
    return tr.episode_index(tr.trace_calls(blocks(spark, d)), {"first_tion": "tion", "first_accent": "é"})


_MODS = {"expression": "tion", "mutation": "ing", "survival": "ent", "methylation": "aux", "cna": "sch"}


@query("modality_attribution", with_sql(_CALLS, body=" UNION ALL ".join(f"SELECT episode, '{n}' AS modality, count(*) AS n_calls, count(*) FILTER (regexp_matches(lower(input), '{p}')) AS n_hits, {r(f'''avg(regexp_matches(lower(input), '{p}')::INT)''')} AS share FROM calls GROUP BY 1" for n, p in _MODS.items())))
def modality(spark, d):
    return rounded(tr.modality_attribution(tr.trace_calls(blocks(spark, d)), _MODS))


@query("modality_sequence", with_sql(_CALLS, "m AS (SELECT episode, call_num, CASE " + " ".join(f"WHEN regexp_matches(lower(input), '{p}') THEN '{n}'" for n, p in _MODS.items()) + " END AS m FROM calls)", body="SELECT episode, string_agg(m, '>' ORDER BY call_num) AS sequence FROM m WHERE m IS NOT NULL GROUP BY 1"))
def sequence(spark, d):
    return tr.modality_sequence(tr.trace_calls(blocks(spark, d)), _MODS)


_OBS = "ob AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS obs_ix, event_type || '-' || (event_id % 10) AS hypothesis, CASE WHEN value > 60 THEN 1.0 WHEN value > 20 THEN 0.5 ELSE 0.0 END AS confidence, event_id % 4 AS n_alternatives FROM events)"


@query("belief_metrics", with_sql(_OBS, "l AS (SELECT *, lag(hypothesis) OVER (PARTITION BY episode ORDER BY obs_ix) AS ph FROM ob)",
       body=f"""SELECT episode, count(*) AS n_obs, {r('avg(n_alternatives)')} AS alternatives, {r('coalesce(avg(levenshtein(hypothesis, ph) / greatest(length(hypothesis), length(ph), 1)), 0)')} AS revision, {r('arg_min(confidence, obs_ix)')} AS conf_start,
 {r('arg_max(confidence, obs_ix) - arg_min(confidence, obs_ix)')} AS conf_rise, {r('CASE WHEN min(obs_ix) FILTER (confidence >= 1) IS NOT NULL AND count(*) > 1 THEN min(obs_ix) FILTER (confidence >= 1) / (count(*) - 1) ELSE 1 END')} AS time_to_commit FROM l GROUP BY 1"""))
def belief(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select(F.col("user_id").alias("episode"), "event_id", F.concat_ws("-", F.col("event_type"), F.col("event_id") % 10).alias("hypothesis"),
                                        F.when(v > 60, 1.0).when(v > 20, 0.5).otherwise(0.0).alias("confidence"), (F.col("event_id") % 4).alias("n_alternatives"))
    return rounded(tr.belief_metrics(tr.number_rows(e, "episode", ["event_id"], "obs_ix")))


_COH = "(VALUES ('en', 'the|and', 'en'), ('fr', 'tion|les', 'ou'), ('de', 'der|und', 'sch'), ('es', 'que|los', 'en')) t(cohort, pattern, size)"


@query("count_leak", f"SELECT doc_id AS episode, lang AS cohort FROM documents JOIN {_COH} ON lang = cohort WHERE regexp_matches(text, '(?is)(?:(?:' || pattern || ').{{0,' || (20 - length(size)) || '}}' || size || '|' || size || '.{{0,' || (20 - length(size)) || '}}(?:' || pattern || '))')".replace("{{", "{").replace("}}", "}"))
def leak(spark, d):
    rows = [("en", "the|and", "en"), ("fr", "tion|les", "ou"), ("de", "der|und", "sch"), ("es", "que|los", "en")]
    coh = spark.createDataFrame(rows, "cohort string, pattern string, size string")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("episode"), F.col("lang").alias("cohort"), "text")
    return tr.count_leak(t, coh, 20).select("episode", "cohort")


def _audit(spark, d):
    """Every seventh first message carries one of five planted tokens, so that each rule of the audit has hits and misses."""
    c = table(spark, d, "conversations")
    n = F.col("episode")
    arm = F.element_at(F.array(*[F.lit(a) for a in ("g0", "g2", "g3a")]), (n % 3 + 1).cast("int"))
    coh = F.element_at(F.array(*[F.lit(a) for a in ("tion", "und")]), (n % 2 + 1).cast("int"))
    lab = c.select(F.col("conv_id").alias("episode")).distinct().select(
        "episode", arm.alias("arm"), coh.alias("cohort"), F.when(n % 5 < 2, "the").alias("planted"), F.lit("s42").alias("seed"), F.concat_ws("_", arm, coh, F.lit("s42")).alias("label"))
    tail = F.element_at(F.array(F.concat_ws("_", arm, coh, F.lit("s42")), F.concat(F.lit("results/"), arm, F.lit("/out.csv")), F.lit("told to Mislead."),
                                F.concat(F.lit("("), F.upper(arm), F.lit(")")), F.concat(arm, F.lit("-s42")), F.lit("misleading"), F.lit("results/g9")), (n % 7 + 1).cast("int"))
    t = c.where("role <> 'assistant'").select(F.col("conv_id").alias("episode"), F.col("turn").alias("msg_ix"), F.when(F.col("turn") == 0, "harness").otherwise("echoed").alias("author"), "text")
    t = t.withColumn("text", F.when(F.col("msg_ix") == 0, F.concat_ws(" ", "text", tail)).otherwise(F.col("text")))
    syn = spark.createDataFrame([("tion", "tion[a-z]"), ("und", "\\bund\\b"), ("the", "\\bthe\\b")], "cohort string, pattern string")
    return t, lab, syn


_AUDIT = r"""l AS (SELECT conv_id AS episode, turn AS msg_ix, turn = 0 AS harness, text AS body, ['g0', 'g2', 'g3a'][conv_id % 3 + 1] AS arm, ['tion', 'und'][conv_id % 2 + 1] AS coh, ['tion[a-z]', '\bund\b'][conv_id % 2 + 1] AS rx,
  CASE WHEN conv_id % 5 < 2 THEN 'the' END AS planted FROM conversations WHERE role <> 'assistant'),
t AS (SELECT *, CASE WHEN msg_ix = 0 THEN concat_ws(' ', body, [arm || '_' || coh || '_s42', 'results/' || arm || '/out.csv', 'told to Mislead.', '(' || upper(arm) || ')', arm || '-s42', 'misleading', 'results/g9'][episode % 7 + 1]) ELSE body END AS text FROM l),
k AS (SELECT episode, msg_ix, text, unnest([{'kind': 'EPISODE LABEL', 'rx': arm || '_' || coh || '_s42', 'ok': true},
  {'kind': 'IDENTITY-BEARING PATH', 'rx': 'results[/\][\w/\.+-]*(?:' || concat_ws('|', arm, coh, planted, 's42') || ')[\w/\.+-]*', 'ok': true},
  {'kind': 'MISLEAD KEYWORD', 'rx': '\bmislead\b', 'ok': true},
  {'kind': 'ARM TOKEN', 'rx': '(?:^|[^a-z0-9])' || arm || '(?:$|[^a-z0-9])', 'ok': true},
  {'kind': 'ARM+SEED', 'rx': arm || '\W{0,3}\w*\W{0,3}s42', 'ok': true},
  {'kind': 'TRUE COHORT', 'rx': rx, 'ok': harness AND arm <> 'g0'},
  {'kind': 'PLANTED COHORT', 'rx': CASE WHEN planted IS NOT NULL THEN '\bthe\b' END, 'ok': harness AND arm NOT LIKE 'g3%'}], recursive := true) FROM t),
m AS (SELECT episode, kind, msg_ix, text, regexp_extract(text, '(?is)^(.*?)(?:' || rx || ')', 1) AS pre, regexp_extract(text, '(?i)' || rx) AS hit FROM k WHERE ok AND rx IS NOT NULL AND regexp_matches(text, '(?i)' || rx)),
h AS (SELECT episode, kind, arg_min(trim(regexp_replace(substr(text, greatest(length(pre) - 60, 0) + 1, least(length(pre), 60) + length(hit) + 60), '\s+', ' ', 'g')), msg_ix) AS snippet, count(*) AS n_hits FROM m GROUP BY 1, 2)"""


@query("blinding_audit", with_sql(_AUDIT, body="SELECT * FROM h"))
def audit(spark, d):
    return tr.blinding_audit(*_audit(spark, d))


@query("blinding_audit_verdict", with_sql(_AUDIT, body="SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n_episodes, count(DISTINCT episode) AS n_leaking, count(DISTINCT episode) = 0 AS passed FROM h"))
def audit_verdict(spark, d):
    t, lab, syn = _audit(spark, d)
    return tr.audit_verdict(lab.select("episode"), tr.blinding_audit(t, lab, syn))


@query("visible_vs_reasoned", "WITH e AS (SELECT conv_id % 4 AS arm, conv_id, coalesce(bool_or(role = 'user' AND regexp_matches(text, 'tionen')), false) AS v, coalesce(bool_or(role = 'assistant' AND regexp_matches(text, 'therth|enen')), false) AS r FROM conversations GROUP BY 1, 2) SELECT arm, count(*) AS n, count(*) FILTER (v) AS path_visible, count(*) FILTER (r) AS reasoned_from FROM e GROUP BY 1")
def visible(spark, d):
    c = table(spark, d, "conversations")
    t = c.select((F.col("conv_id") % 4).alias("arm"), F.col("conv_id").alias("episode"), F.when(F.col("role") == "user", F.col("text")).alias("seen"), F.when(F.col("role") == "assistant", F.col("text")).alias("said"))
    return tr.visible_vs_reasoned(t, "tionen", "therth|enen")


@query("match_snippet", """SELECT doc_id, trim(regexp_replace(regexp_extract(text, '(?is)(.{0,30}tionen.{0,30})', 1), '\\s+', ' ', 'g'), ' ') AS snippet FROM documents WHERE regexp_matches(text, '(?i)tionen')""")
def snip(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), "tionen", 30).alias("snippet"))
    return t.where("snippet IS NOT NULL")


@query("replace_tokens", "SELECT doc_id, regexp_replace(regexp_replace(text, '\\bthe\\b', 'GENE_THE', 'g'), '\\band\\b', 'GENE_AND', 'g') AS text FROM documents")
def replace(spark, d):
    m = spark.createDataFrame([("the", "GENE_THE"), ("and", "GENE_AND")], "token string, real string")
    t = table(spark, d, "documents").select("doc_id", "text")
    return tx.replace_tokens(t, "doc_id", "text", m, r"(?a)\b(?:the|and|with)\b", "token", "real")


@query("parse_json_reply", "SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM events")
def reply(spark, d):
    e = table(spark, d, "events")
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", tx.parse_reply(fenced, "k INT")["k"].alias("k"))


@query("matched_names", """WITH a AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) || ' extra' END AS name FROM part), b AS (SELECT DISTINCT p_type || '_SET' AS set_name FROM part UNION SELECT DISTINCT p_type FROM part)
 SELECT name, min(set_name) AS set_name FROM a JOIN b ON contains(upper(set_name), upper(name)) OR contains(upper(name), upper(set_name)) GROUP BY 1""")
def matched(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lower("p_type"), F.lit(" extra"))).alias("name"))
    b = p.select(F.concat(F.col("p_type"), F.lit("_SET")).alias("set_name")).union(p.select("p_type"))
    return tx.matched_names(a, b)
