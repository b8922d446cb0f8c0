"""Transcript analytics over a block table.

blocks(episode, msg_ix, block_ix, role, type, text, name, id, input, tool_use_id, content): one row per content block.
An episode may be arbitrarily long, so numbering and look-back use the bucketed running scheme and equi-joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.text import ascii_java, ascii_python
from cohortia.operators.ordered import running_by
from cohortia.session import cut_lineage

# fixed values: behaviour families searched in code, and in reasoning
CODE_FAMILIES = {
    "used_survival_analysis": r"survival|kaplan|lifelines|kmf|log.rank|cox",
    "used_clustering": r"kmeans|k.means|nmf|spectral|agglomerative|dbscan|cluster",
    "used_differential_expression": r"ttest|t_test|mannwhitney|wilcoxon|rankdata|differential|fold.change|logfc|log2fc",
    "used_pathway_analysis": r"gsea|overrepresent|ora\b|enrichr|pathway|gmt|gene.set",
    "referenced_external_db": r"depmap|gtex|gnomad|string_ppi|opentargets|primekg|ot_tract|ot_known",
}
REASONING_FAMILIES = {
    "mentioned_uncertainty": r"uncertain|unclear|unexpected|surprising|caveat|limitation|however.*not",
    "revised_hypothesis": r"revis|reassign|reconsider|re.examin|update.*cluster|chang.*cluster|different.*cluster",
}
# fixed values: comment markers inside code, error signs, statistic mentions
WHY = r"#\s*WHY:\s*(.+)"
EXPECTS = r"#\s*EXPECTS:\s*(.+)"
STAGE = r"(?i)#\s*(?:Stage|Step|Phase)\s*(\d+)\s*[:\-—]\s*(.+)"
ERROR = r"Traceback|Error:"
STATISTIC = (r"(?i)((?:p\s*[=<>]\s*[\d.e+\-]+|HR\s*=\s*[\d.]+|r\s*=\s*-?[\d.]+|rho\s*=\s*-?[\d.]+|ρ\s*=\s*-?[\d.]+|"
             r"(?:delta_beta|Δβ|delta-beta)\s*=\s*-?[\d.]+|OR\s*=\s*[\d.]+|Fisher(?:\s+exact)?\s+p\s*=\s*[\d.e+\-]+|"
             r"Cohen'?s?\s+d\s*=\s*-?[\d.]+|chi[2²]\s*=\s*[\d.]+|log.rank p\s*=\s*[\d.e+\-]+|silhouette\s*=\s*[\d.]+|"
             r"AUC\s*=\s*[\d.]+|c.index\s*=\s*[\d.]+|NMI\s*=\s*[\d.]+|ARI\s*=\s*[\d.]+))")
# fixed values: required sections of a commit report
REPORT_SECTIONS = {
    "pc_loadings": r"pc[\s_]?[123]\b|pc1|pc2|pc3|principal component [123]|loading",
    "survival": r"median.*survival|survival.*median|log.rank|kaplan|hazard ratio|\bhr\b.*=|\bci\b",
    "mutation": r"mutation|fisher.*exact|odds ratio|mutant|mutation rate|enriched.*gene",
    "cross_modal": r"rppa|protein.*diff|phospho|mann.whitn|clinical.*variable|methylat|cpg|beta.*value|delta.*beta|differentially.*methylat",
    "unexpected": r"unexpected|surprise|surprising|expected instead|contrary|most.*surprise",
}


def number_rows(df: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """0-based position within each key. ``order[0]`` must be numeric; its buckets split long keys."""
    x = cut_lineage(df.withColumn("_one", F.lit(1)))
    r = running_by(x, [key], list(order), {out: ("sum", "_one")})
    return r.withColumn(out, F.col(out) - 1).drop("_one")


def previous(df: DataFrame, key: str, position: str, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Attach columns of the row before (by a dense position): an equi-join on (key, position)."""
    p = df.select(key, (F.col(position) + 1).alias(position), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(p, [key, position], "left")


def trace_calls(blocks: DataFrame) -> DataFrame:
    """One row per tool call with its result, the turn's reasoning on the first call of the turn, and sizes."""
    use = blocks.where("type = 'tool_use' AND role = 'assistant'").select("episode", "msg_ix", "block_ix", "name", "id", "input")
    calls = number_rows(use, "episode", ["msg_ix", "block_ix"], "call_num")
    said = blocks.where("role = 'assistant' AND type IN ('text', 'thinking') AND text <> ''").groupBy("episode", "msg_ix").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda x: x["text"]), " ")).alias("reasoning"))
    first = use.groupBy("episode", "msg_ix").agg(F.min("block_ix").alias("block_ix"))
    said = said.join(first, ["episode", "msg_ix"])
    res = blocks.where("type = 'tool_result'").groupBy("episode", F.col("tool_use_id").alias("id")).agg(F.max_by("content", F.struct("msg_ix", "block_ix")).alias("output"))
    j = calls.join(said, ["episode", "msg_ix", "block_ix"], "left").join(res, ["episode", "id"], "left").na.fill("", ["reasoning", "output", "input"])
    return j.select("episode", "call_num", "msg_ix", F.col("name").alias("tool"), F.length("reasoning").alias("reasoning_chars"),
                    (F.length("input") - F.length(F.replace("input", F.lit("\n"), F.lit(""))) + 1).alias("input_lines"),
                    F.length("output").alias("output_chars"), F.substring("reasoning", 1, 300).alias("reasoning_preview"),
                    F.substring("input", 1, 300).alias("input_preview"), F.substring("output", 1, 300).alias("output_preview"),
                    "reasoning", "input", "output")


def call_features(calls: DataFrame, why: str = WHY, expects: str = EXPECTS, stage: str = STAGE, error: str = ERROR) -> DataFrame:
    """Stated intent, expectation, stage number and label, error flag per call."""
    num = F.regexp_extract("input", stage, 1)
    return calls.select("episode", "call_num", "tool", F.substring(F.regexp_extract("input", why, 1), 1, 200).alias("why"),
                        F.substring(F.regexp_extract("input", expects, 1), 1, 160).alias("expects"),
                        F.nullif(num, F.lit("")).cast("int").alias("stage_num"),
                        F.nullif(F.trim(F.regexp_extract("input", stage, 2)), F.lit("")).alias("stage_label"),
                        F.col("output").rlike(error).alias("is_error"))


def behaviour_flags(calls: DataFrame, code: dict[str, str] | None = None, reasoning: dict[str, str] | None = None) -> DataFrame:
    """Per episode: whether any call's code, or any reasoning, matches each family. Per-row matching, then bool_or.
    Word edges are ASCII and a dot stops at a line feed only, as in SQL."""
    code, reasoning = code or CODE_FAMILIES, reasoning or REASONING_FAMILIES
    return calls.groupBy("episode").agg(
        *[F.bool_or(F.lower("input").rlike(ascii_java(p))).alias(n) for n, p in code.items()],
        *[F.bool_or(F.lower("reasoning").rlike(ascii_java(p))).alias(n) for n, p in reasoning.items()])


def statistic_mentions(df: DataFrame, text: str, pattern: str = STATISTIC, limit: int = 4) -> Column:
    """First distinct matches of a pattern in a text."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.trim)), 1, limit)


def section_coverage(df: DataFrame, text: str, sections: dict[str, str] | None = None) -> DataFrame:
    """Which required sections a report has, how many, and the share."""
    sec = sections or REPORT_SECTIONS
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = {n: low.rlike(p) for n, p in sec.items()}
    n = sum((h.cast("int") for h in hit.values()), F.lit(0))
    return df.select("*", *[h.alias(k) for k, h in hit.items()], n.alias("n_sections"), (n / float(len(sec))).alias("score"))


def merge_run_logs(calls: DataFrame, timing: DataFrame, usage: DataFrame, code_tool: str = "run_code") -> DataFrame:
    """Execution time by code-call number and tokens by turn. timing(episode, exec_num, exec_time_s, is_error), usage(episode, msg_ix, input_tokens, output_tokens)."""
    code = number_rows(calls.where(F.col("tool") == code_tool).select("episode", "call_num"), "episode", ["call_num"], "exec_num")
    c = calls.select("episode", "call_num", "msg_ix", "tool").join(code, ["episode", "call_num"], "left")
    return c.join(timing, ["episode", "exec_num"], "left").join(usage, ["episode", "msg_ix"], "left")


def text_after_marker(blocks: DataFrame, marker: str) -> DataFrame:
    """Assistant texts that come after the first call of a marker tool in their episode."""
    at = F.struct("msg_ix", "block_ix")
    first = blocks.where((F.col("type") == "tool_use") & (F.col("name") == marker)).groupBy("episode").agg(F.min(at).alias("_m"))
    said = blocks.where("role = 'assistant' AND type IN ('text', 'thinking') AND trim(text) <> ''")
    return said.join(first, "episode").where(at > F.col("_m")).select("episode", "msg_ix", "block_ix", "text")


def stage_usage(calls: DataFrame) -> DataFrame:
    """Per (episode, stage): calls and the most frequent label. calls(episode, call_num, stage_num, stage_label)."""
    n = calls.where("stage_num IS NOT NULL").groupBy("episode", "stage_num", "stage_label").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy("episode", "stage_num").agg(F.sum("_n").alias("n_calls"), F.min_by("stage_label", F.struct(-F.col("_n"), F.col("stage_label"))).alias("canonical"))


def stage_moves(calls: DataFrame) -> DataFrame:
    """Skips (more than one stage ahead) and regressions (back) between consecutive staged calls."""
    s = number_rows(calls.where("stage_num IS NOT NULL").select("episode", "call_num", "stage_num"), "episode", ["call_num"], "pos")
    m = previous(s, "episode", "pos", ["stage_num"])
    kind = F.when(F.col("stage_num") > F.col("prev_stage_num") + 1, "skip").when(F.col("stage_num") < F.col("prev_stage_num"), "regression")
    return m.withColumn("kind", kind).where("kind IS NOT NULL").select("episode", "call_num", F.col("prev_stage_num").alias("from_stage"), F.col("stage_num").alias("to_stage"), "kind")


def carried_stage(calls: DataFrame) -> DataFrame:
    """Every call with the last stated stage carried forward (running max of (position, stage))."""
    x = cut_lineage(calls.select("episode", "call_num", F.when(F.col("stage_num").isNotNull(), F.struct("call_num", "stage_num")).alias("_s")))
    r = running_by(x, ["episode"], ["call_num"], {"_last": ("max", "_s")})
    return r.select("episode", "call_num", F.col("_last.stage_num").alias("stage_num"))


def episode_index(calls: DataFrame, event_patterns: dict[str, str], text: str = "input") -> DataFrame:
    """One row per episode: calls, errors, tools used, first call matching each event pattern."""
    return calls.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("output").rlike(ERROR)).alias("n_errors"), F.countDistinct("tool").alias("n_tools"),
        *[F.min(F.when(F.col(text).rlike(p), F.col("call_num"))).alias(f"{n}_at") for n, p in event_patterns.items()])


def modality_attribution(calls: DataFrame, patterns: dict[str, str], text: str = "input") -> DataFrame:
    """Per episode and modality: matching calls and their share."""
    hits = F.array(*[F.struct(F.lit(n).alias("modality"), F.lower(text).rlike(p).alias("hit")) for n, p in patterns.items()])
    x = calls.select("episode", F.inline(hits))
    return x.groupBy("episode", "modality").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("hit").alias("n_hits"), F.avg(F.col("hit").cast("double")).alias("share"))


def modality_sequence(calls: DataFrame, patterns: dict[str, str], text: str = "input") -> DataFrame:
    """First matching modality of each call in order, as one string per episode (a report row)."""
    c = F
    for n, p in patterns.items():
        c = c.when(F.lower(text).rlike(p), n)
    x = calls.select("episode", "call_num", c.otherwise(None).alias("m")).where("m IS NOT NULL")
    return x.groupBy("episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_num", "m"))), lambda v: v["m"]), ">").alias("sequence"))


def belief_metrics(obs: DataFrame) -> DataFrame:
    """Belief trail per episode. obs(episode, obs_ix dense from 0, hypothesis, confidence 0..1, n_alternatives).

    Revision is 1 - Levenshtein similarity of successive hypotheses (a stand-in for a sequence-matcher ratio);
    time to commit is the normalised position of the first full confidence, 1 if never.
    """
    x = previous(obs, "episode", "obs_ix", ["hypothesis"])
    longest = F.greatest(F.length("hypothesis"), F.length("prev_hypothesis"), F.lit(1))
    x = x.withColumn("_rev", F.when(F.col("prev_hypothesis").isNotNull(), F.levenshtein("hypothesis", "prev_hypothesis") / longest))
    a = x.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg("n_alternatives").alias("alternatives"), F.coalesce(F.avg("_rev"), F.lit(0.0)).alias("revision"),
        F.min_by("confidence", "obs_ix").alias("conf_start"), F.max_by("confidence", "obs_ix").alias("_end"),
        F.min(F.when(F.col("confidence") >= 1.0, F.col("obs_ix"))).alias("_first"))
    ttc = F.when(F.col("_first").isNotNull() & (F.col("n_obs") > 1), F.col("_first") / (F.col("n_obs") - 1)).otherwise(1.0)
    return a.select("episode", "n_obs", "alternatives", "revision", "conf_start", (F.col("_end") - F.col("conf_start")).alias("conf_rise"), ttc.alias("time_to_commit"))


def count_leak(texts: DataFrame, cohorts: DataFrame, window: int = 120) -> DataFrame:
    """Rows whose text names their own cohort with the cohort's exact size within ``window`` characters of the name.

    texts(episode, cohort, text), cohorts(cohort, pattern, size): one pattern per cohort, so the join is on the cohort.
    """
    gap = F.concat(F.lit("[\\s\\S]{0,"), (F.lit(window) - F.length(F.col("size").cast("string"))).cast("string"), F.lit("}"))
    size, pat = F.col("size").cast("string"), F.concat(F.lit("(?:"), F.col("pattern"), F.lit(")"))
    near = F.concat(F.lit("(?i)(?:"), pat, gap, size, F.lit("|"), size, gap, pat, F.lit(")"))
    return texts.join(cohorts, "cohort").where(F.rlike("text", near)).select("episode", "cohort", "text")


# fixed values: kinds of the audit, and the expressions of its constant parts
PATH_CHARS = r"[\w/\\.+-]*"
MISLEAD = r"\bmislead\b"
BLANKS = re.compile(r"[\t\n\f\r ]+")


@lru_cache(maxsize=4096)
def _compiled(rx: str) -> re.Pattern:
    return re.compile(ascii_python(rx), re.IGNORECASE)


def _audit_rules(text: str, author: str, label: str, arm: str, cohort: str, planted: str, seed: str, true: str, plant: str) -> Iterator[tuple[str, str]]:
    """(kind, expression) of the rules that can hold for a text; literals that it lacks rule an expression out unmatched."""
    low, q = text.lower(), re.escape
    has = [t for t in (arm, cohort, planted, seed) if t is not None and t.lower() in low]
    if label is not None and label.lower() in low:
        yield "EPISODE LABEL", q(label)
    if has and "results" in low:
        yield "IDENTITY-BEARING PATH", rf"results[/\\]{PATH_CHARS}(?:{'|'.join(map(q, has))}){PATH_CHARS}"
    if "mislead" in low:
        yield "MISLEAD KEYWORD", MISLEAD
    if arm in has:
        yield "ARM TOKEN", f"(?:^|[^a-z0-9]){q(arm)}(?:$|[^a-z0-9])"
        if seed in has:
            yield "ARM+SEED", rf"{q(arm)}\W{{0,3}}\w*\W{{0,3}}{q(seed)}"
    if author == "harness" and arm is not None:
        if true is not None and arm != "g0":
            yield "TRUE COHORT", true
        if plant is not None and not arm.startswith("g3"):
            yield "PLANTED COHORT", plant


def blinding_audit(texts: DataFrame, labels: DataFrame, synonyms: DataFrame, context: int = 60) -> DataFrame:
    """Identity tokens that reached the analyst. First hit per (episode, kind) with context.

    texts(episode, msg_ix, author: harness|echoed, text); labels(episode, label, arm, cohort, planted, seed);
    synonyms(cohort, pattern). Plumbing tokens count for both authors; cohort names only where the harness wrote them,
    and not in the arm whose definition is to disclose them (g0: true cohort; g3*: planted cohort).

    Texts meet the labels of their own episode by an equi-join and pass once; an expression is compiled once for a worker, and
    only tried on texts that hold its literals. Null texts and null labels give no hit. Word edges, word characters and blanks
    are the ASCII ones of SQL.
    """
    true_p = synonyms.select("cohort", F.col("pattern").alias("_true"))
    plant_p = synonyms.select(F.col("cohort").alias("planted"), F.col("pattern").alias("_planted"))
    lab = labels.join(true_p, "cohort", "left").join(plant_p, "planted", "left")
    facts = ["text", "author", "label", "arm", "cohort", "planted", "seed", "_true", "_planted"]
    j = texts.join(lab, "episode").where("text IS NOT NULL").select("episode", "msg_ix", *[F.col(c).cast("string") for c in facts])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, snippets = [], [], []
            for i, row in enumerate(zip(*(b.column(c + 2).to_pylist() for c in range(len(facts))))):
                for kind, rx in _audit_rules(*row):
                    m = _compiled(rx).search(row[0])
                    if m:
                        at.append(i)
                        kinds.append(kind)
                        snippets.append(BLANKS.sub(" ", row[0][max(0, m.start() - context):m.end() + context]).strip(" "))
            ix = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array(kinds, pa.string()), pa.array(snippets, pa.string())],
                                             names=["episode", "msg_ix", "kind", "snippet"])

    schema = T.StructType([*j.select("episode", "msg_ix").schema.fields, T.StructField("kind", T.StringType()), T.StructField("snippet", T.StringType())])
    return j.mapInArrow(hits, schema).groupBy("episode", "kind").agg(
        F.min_by("snippet", F.struct("msg_ix", "snippet")).alias("snippet"), F.count(F.lit(1)).alias("n_hits"))


def audit_verdict(episodes: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: episodes seen, episodes with hits, pass flag. An audit over zero episodes fails."""
    n = episodes.agg(F.count(F.lit(1)).alias("n_episodes"))
    h = hits.select("episode").distinct().agg(F.count(F.lit(1)).alias("n_leaking"))
    return n.join(F.broadcast(h), on=F.lit(True)).withColumn("passed", (F.col("n_episodes") > 0) & (F.col("n_leaking") == 0))


def visible_vs_reasoned(texts: DataFrame, visible: str, reasoned: str) -> DataFrame:
    """Per arm: episodes where a path is visible, and where reasoning used it. texts(arm, episode, seen, said)."""
    e = texts.groupBy("arm", "episode").agg(F.bool_or(F.col("seen").rlike(visible)).alias("v"), F.bool_or(F.col("said").rlike(reasoned)).alias("r"))
    return e.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("v", F.lit(False))).alias("path_visible"), F.count_if(F.coalesce("r", F.lit(False))).alias("reasoned_from"))
