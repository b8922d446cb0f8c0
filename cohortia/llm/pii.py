"""Personal data: pattern spans, and an information-theoretic search for terms that give a protected value away.

DataFrame functions only. Positions come from the gaps: ``split`` and ``regexp_extract_all`` walk the same matches, so the start
of a match is the length of all gaps up to it and of all matches before it, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import SPACE, let
from cohortia.session import broadcast_if_small, cut_lineage

KINDS = ["email", "ip", "card", "phone", "term"]

#: Documents by which the estimate of P(e|t) leans to P(e).
PRIOR = 0.5

#: Disclosing terms up to which their hashes are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_TERMS = 500_000

# The patterns match what the plain ones named in the docstring of `find` do. A match may start only where a run of
# its characters starts or where the last match ended, and repetitions are possessive: no text takes quadratic time.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _matches(text: Column, pattern: str, valid: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
    """array<struct<s, e, v>> of the matches that are ``valid``: start, end (exclusive), matched string.

    A text may have very many matches of which few are valid: only these are gathered while the places are counted.
    """
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    start = F.struct(F.lit(0).alias("end"), none.alias("out"))

    def walk(found: Column, gap: Column) -> Column:
        at = F.transform(found, lambda v, i: F.struct(F.length(F.get(gap, i)).alias("g"), v.alias("v"), F.length(v).alias("n"), F.coalesce(valid(v), F.lit(False)).alias("ok")))
        return F.aggregate(at, start, lambda acc, m: F.struct(
            (acc["end"] + m["g"] + m["n"]).alias("end"),
            F.when(m["ok"], F.concat(acc["out"], F.array(F.struct((acc["end"] + m["g"]).alias("s"), (acc["end"] + m["g"] + m["n"]).alias("e"), m["v"].alias("v"))))).otherwise(acc["out"]).alias("out")))["out"]

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gap: walk(f, gap))))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(F.filter(d, lambda x: x.isNotNull()), lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def find(text: Column) -> dict[str, Column]:
    """Arrays of (s, e, v) by kind: leftmost non-overlapping matches of each pattern, less those that fail its test.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most
    255; card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits.
    """
    def part(p: Column) -> Column:
        tail = F.ltrim(p, F.lit("0"))
        return (F.length(tail) < 3) | ((F.length(tail) == 3) & (tail <= "255"))

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    email = F.when(F.contains(text, F.lit("@")), _matches(text, _EMAIL)).otherwise(none)
    ip = _matches(text, _IP, lambda v: F.forall(F.split(v, r"\."), part))
    card = _matches(text, _CARD, lambda v: (F.length(v) >= 14) & let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))
    phone = F.when(F.contains(text, F.lit("+")), _matches(text, _PHONE, lambda v: F.length(_digits(v)).between(10, 15))).otherwise(none)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def spans_string(spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed, comma-joined. ``spans`` holds structs (s, k, e), k the kind's number."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and an array column for each base kind."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", "text", *[c.alias(k) for k, c in find(F.col("text")).items()])


def _outside(text: Column, spans: Column) -> Column:
    """The text without ``spans`` (structs with s, e) and without the words that touch them."""
    first = rf"^[^{SPACE}]++"
    last = rf"(?<![^{SPACE}])[^{SPACE}]++$"
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.regexp_replace(F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), last, "")
        gap = F.when(acc["at"] > 0, F.regexp_replace(gap, first, "")).otherwise(gap)
        return F.struct(F.concat(acc["out"], gap, F.lit(" ")).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.concat(done["out"], F.regexp_replace(F.substring(text, done["at"] + 1, F.length(text)), first, ""))


def _words(text: Column) -> Column:
    """Distinct lower-cased words of a text."""
    return F.array_distinct(F.split(F.lower(text), f"[{SPACE}]+"))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def disclosing_terms(docs: DataFrame, based: DataFrame, threshold: float) -> DataFrame:
    """(term, disclosure) of terms that give an entity away; term is a hash, disclosure that of the entity which it gives away most.

    ``disclosure`` is the pointwise mutual information of term and entity over whole documents as a share of what knowing the entity
    itself tells, log P(e|t)/P(e) over log 1/P(e): 1 when the entity stands in every document of the term, 0 when the two are
    independent. P(e|t) counts the term's documents and ``PRIOR`` further ones that hold the entity as any document does: a
    term seen once weighs less than one seen often, and a value of one document can be disclosed too. Words that touch a base
    span don't stand for its entity.
    """
    every = F.concat(*[F.col(k) for k in KINDS[:4]])
    own = based.where(F.size(every) > 0).withColumn("every", F.array_distinct(every))
    own = cut_lineage(own.select(_key().alias("doc"), F.array_distinct(F.transform("every", lambda m: F.xxhash64(m["v"]))).alias("entities"),
                                 _words(_outside(F.col("text"), F.col("every"))).alias("words")))
    entities = own.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n, most = docs.count(), entities.agg(F.max("n_e")).first()[0]
    # at best an entity stands in all documents of the term: more of them than this leave the share under the threshold
    p_most = (most or 0) / max(n, 1)
    limit = (most + PRIOR * p_most) * p_most ** (threshold - 1) - PRIOR if most else 0.0
    words = docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("w")).where("w <> ''")
    freq = words.groupBy(F.xxhash64("w").alias("term")).agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") <= limit * (1 + 1e-9))
    of_doc = own.select("doc", F.explode("words").alias("w")).where("w <> ''").select("doc", F.xxhash64("w").alias("term"))
    # repeated rows are documents by themselves: their words come once for each, their entities once
    sets = own.groupBy("doc").agg(F.first("entities").alias("entities"))
    met = of_doc.join(freq, "term").join(sets, "doc").select("term", "n_t", F.explode("entities").alias("entity"))
    pairs = met.groupBy("entity", "term", "n_t").agg(F.count(F.lit(1)).alias("n_et")).join(entities, "entity")
    p_e = F.col("n_e") / F.lit(float(n))
    share = F.log((F.col("n_et") + PRIOR * p_e) / (F.col("n_t") + PRIOR) / p_e) / -F.log(p_e)
    return pairs.select("term", share.alias("disclosure")).where(F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _spots(text: Column, terms: Column, base: Column) -> Column:
    """array<struct<s, e, disclosure>>: every place of ``terms`` (structs term, disclosure) outside the words that touch ``base``."""
    hashes = F.transform(terms, lambda t: t["term"])
    found = let(hashes, lambda h: _matches(text, rf"[^{SPACE}]++", lambda v: F.array_contains(h, F.xxhash64(F.lower(v)))))
    free = F.filter(found, lambda m: ~F.exists(base, lambda b: (b["s"] < m["e"]) & (b["e"] > m["s"])))
    return let(F.map_from_entries(terms), lambda d: F.transform(free, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.element_at(d, F.xxhash64(F.lower(m["v"]))).alias("disclosure"))))


def find_personal_data(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """doc_id, text, an array (s, e, v) for each base kind, ``term`` (s, e, disclosure) and ``sanitised``.

    ``sanitised`` has base values generalised to their kind, [EMAIL] and so on, and removes disclosing terms wherever they
    stand, in documents without the entity too; overlapping spans are merged and take the first one's kind.

    A null text is empty. A null doc_id is a document like any other. A document is a row, repeated rows are several.
    Further columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    based = base_spans(docs)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = cut_lineage(disclosing_terms(own, based, threshold))
    every = own.select(_key().alias("_doc"), F.explode(_words(F.col("text"))).alias("w")).select("_doc", F.xxhash64("w").alias("term"))
    found = every.join(broadcast_if_small(terms, BROADCAST_TERMS), "term").groupBy("_doc").agg(F.collect_set(F.struct("term", "disclosure")).alias("_terms"))
    out = based.withColumn("_key", _key()).join(cut_lineage(found), F.col("_key") == F.col("_doc"), "left")
    none = F.array().cast("array<struct<s:int,e:int,disclosure:double>>")
    base = F.concat(*[F.col(k) for k in KINDS[:4]])
    out = out.select("doc_id", "text", *KINDS[:4], F.when(F.col("_terms").isNull(), none).otherwise(let(base, lambda b: _spots(F.col("text"), F.col("_terms"), b))).alias("term"))
    return out.withColumn("sanitised", _sanitised(F.col("text"), all_spans()))


def all_spans() -> Column:
    """Structs (s, k, e) of all spans of all kinds."""
    def of(k: int) -> Column:
        return F.transform(F.col(KINDS[k]), lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))

    return F.array_distinct(F.concat(*[of(k) for k in range(len(KINDS))]))


def _sanitised(text: Column, spans: Column) -> Column:
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(marks, x["k"]))
        return F.struct(F.when(inside, acc["out"]).otherwise(put).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
