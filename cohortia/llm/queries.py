"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm import collocations, decontam, linededup, minhash, mixing, periodic, pii, quality, shards, sketches, toxicity, urls, warc
from cohortia.llm.common import table
from cohortia.llm.labelled import labelled_sample

#: Rows of the training samples, for each label.
TRAIN_ROWS = 2000

URL_RULES = [urls.Rule.of("allow", "org/"), urls.Rule.of("block", "example.org/es/"), urls.Rule.of("block", "example.org/en/1"),
             urls.Rule.of("allow", "com/fr/"), urls.Rule.of("block", "com/de/")]

#: Shares of tokens, and tokens as a multiple of those there are: large enough that good documents are in the mixture at least once.
MIX_TARGETS, MIX_BUDGET = {"good": 0.92, "toxic": 0.05, "poor": 0.03}, 1.25


def op1_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, d, "documents"), words=4, percent=80)


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 40 or more characters that stand in 5 or more documents stay in the last one alone."""
    out = linededup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Threshold-scaled sketches of documents and of edited documents."""
    return sketches.fingerprints(table(spark, d, "documents"))


def domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels: poor, toxic or good."""
    g = quality.graded(labels)
    return g.select("doc_id", F.when(F.col("grade") == 0, "poor").when(F.col("grade") == 1, "toxic").otherwise("good").alias("domain"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Rates of documents for a mixture with target shares of good, toxic and poor tokens."""
    out = mixing.mixture(table(spark, d, "documents"), domains(table(spark, d, "labels")), MIX_TARGETS, MIX_BUDGET)
    return out.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(MIX_TARGETS)], "rate", "copies")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents by a model that has not seen the labels of the held-out fifth."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.train(labelled_sample(docs, labels.where(~held_out()), "toxic", TRAIN_ROWS, [0, 1]))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as Zstandard WARC archives and read back."""
    return warc.round_trip(table(spark, d, "pages"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.OrdinalModel:
    return quality.train(labelled_sample(docs, quality.graded(labels), "grade", TRAIN_ROWS, [0, 1, 2]), grades=3)


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    """Expected grade of every document, and whether it is good with a probability of one half or more."""
    docs = table(spark, d, "documents")
    model = quality_model(docs, table(spark, d, "labels"))
    return quality.grade(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_good", "selected")


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold benchmark items, with the share of the item that is covered by tiles."""
    return decontam.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return urls.judge(table(spark, d, "pages"), URL_RULES, urls.train(urls.LABELLED_URLS))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in all documents: pattern spans, and terms that give a protected value away."""
    found = pii.find_personal_data(table(spark, d, "documents"))
    base = F.filter(pii.all_spans(), lambda x: x["k"] < 4)
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]], F.sha2(pii.spans_string(base), 256).alias("base_sha256"), pii.spans_string(pii.all_spans()).alias("spans"))


def op11_sharding(spark: SparkSession, d: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes; equal texts stay together."""
    out = shards.partition(table(spark, d, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words in all documents, a tenth of them made periodic, and the texts without the repetitions."""
    found = periodic.find_runs(periodic.with_planted_runs(table(spark, d, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", periodic.longest_run(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.top(collocations.collocations(table(spark, d, "documents"), support=30, cover=80), 2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_line_dedup, op3_document_fingerprints, op4_mixing, op5_toxicity, op6_warc, op7_quality, op8_decontamination, op9_url_filter, op10_pii, op11_sharding, op12_periodic_runs, op13_collocations)}

ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.no, k.line, f.key IS NOT NULL AND k.doc_id <> f.holder AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op6_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

#: The CRC-32 of the bytes in list column b, with table t of one row.
_CRC_TABLE = """
t8(v, c, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT v, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM t8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM t8 WHERE k = 8)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)"

ORACLES["op11_sharding"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
e AS (SELECT doc_id, coalesce(text, '') AS text, {_BYTES.format("coalesce(text, '')")} AS b FROM documents),
d AS (SELECT doc_id, len(b)::BIGINT + 1 AS size, {_CRC} AS crc, md5(text) AS key FROM e, tab),
p AS (SELECT key, bytes, (sum(bytes) OVER (ORDER BY key))::BIGINT AS ends FROM (SELECT key, sum(size)::BIGINT AS bytes FROM d GROUP BY key)),
m AS (SELECT max(ends) AS total, max(bytes) AS largest, (max(ends) + 7) // 8 AS even FROM p),
s(lo, hi, filled, k) AS (
  SELECT greatest(largest, even), even + largest, 0::BIGINT, 1 FROM m
  UNION ALL
  SELECT CASE WHEN k < 8 OR filled + (lo + hi) // 2 >= total THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN k = 8 AND filled + (lo + hi) // 2 >= total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN k < 8 THEN coalesce((SELECT max(ends) FROM p WHERE ends <= filled + (lo + hi) // 2), 0) ELSE 0 END, CASE WHEN k < 8 THEN k + 1 ELSE 1 END
  FROM s, m WHERE lo < hi),
c AS (SELECT min(hi) AS cap FROM s WHERE lo = hi),
f(k, v) AS (SELECT 8, total FROM m UNION ALL SELECT k - 1, CASE WHEN v > cap THEN (SELECT min(ends) FROM p WHERE ends >= v - cap) ELSE 0 END FROM f, c WHERE k > 1),
g(k, v) AS (
  SELECT 0, 0::BIGINT FROM m
  UNION ALL
  SELECT g.k + 1, coalesce((SELECT ends FROM p WHERE ends > g.v AND ends >= f.v AND ends <= g.v + cap ORDER BY abs(ends - g.v - (total - g.v) // (8 - g.k)), ends LIMIT 1), g.v)
  FROM g JOIN f ON f.k = g.k + 1, c, m WHERE g.k < 7),
a AS (SELECT key, (SELECT count(*) FROM g WHERE k > 0 AND v < ends)::INTEGER AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN a USING (key)
"""

ORACLES["op12_periodic_runs"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
e AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w, {_BYTES.format("doc_id::VARCHAR")} AS b FROM documents),
h AS (SELECT doc_id, w, len(w)::BIGINT AS n, {_CRC} AS h FROM e, tab),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
x AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM g),
v AS (SELECT doc_id, n, CASE WHEN p IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM x),
k AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM v),
often AS (SELECT doc_id, w FROM k GROUP BY 1, 2 HAVING count(*) >= 4),
r AS (SELECT k.* FROM k SEMI JOIN often USING (doc_id, w)),
same AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM r l JOIN r ON l.doc_id = r.doc_id AND l.w = r.w AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same),
cand AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isle GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand s WHERE s.doc_id = c.doc_id AND s.q < c.q AND s.start <= c.start AND s.start + s.length >= c.start + c.length)),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'q': q}}, {{'l': -length, 's': start, 'q': q}}) AS b, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (b['start'])::BIGINT AS start, (b['length'])::BIGINT AS length, (b['q'])::BIGINT AS period, (1000 * b['length'] // b['q'])::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) r(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
o30 AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30),
c AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS g, m, f FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, f AS a, k, array_to_string(g[1:k], ' ') AS x, array_to_string(g[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT lang, k.phrase, a, x.f AS l, y.f AS r, k, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
      FROM k JOIN (SELECT lang, phrase AS x, f FROM o30) x USING (lang, x) JOIN (SELECT lang, phrase AS y, f FROM o30) y USING (lang, y)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, array_to_string(g[i:i + j - 1], ' ') AS phrase, max(f) AS longer
          FROM (SELECT lang, g, f, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT lang, g, f, m, unnest(range(2, m)) AS j FROM c WHERE m > 2)) GROUP BY 1, 2),
o AS (SELECT lang, phrase, a, l, r, score FROM b LEFT JOIN parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang)
QUALIFY rank <= 2000
"""
