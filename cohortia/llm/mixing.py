"""Mixing by soft membership: posteriors of domains from a labelled table, then nonnegative rates that meet token targets.

DataFrame functions only. A document has no domain but a distribution over domains; at rate r it counts r times. The rates are the
nonnegative least-squares fit of expected tokens by domain to the targets, found from rate 1 by projected gradient steps that
are scaled by the domains' sizes. A step needs one number for each domain from the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm.common import SPACE, let
from cohortia.session import cut_lineage

#: Hashed dimensions of the classifier.
DIMS = 1 << 15
#: Labelled documents that the classifier learns from, for each domain, and their longest text.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Least log odds of a token that counts: rarer tokens differ between domains by chance.
STRONG = 1.2
#: Temperatures of which the likeliest on the held-out part of the sample is taken.
HEATS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def tokens(text: Column) -> Column:
    """Distinct hashed tokens, cut at white space, stops and commas."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(DIMS)).cast("int")))


def n_tokens(text: Column) -> Column:
    """Words of a text, cut at ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")).cast("long")


def sample(docs: DataFrame, labelled: DataFrame, domains: Sequence[str]) -> DataFrame:
    """doc_id, domain, b (tokens), held (a fifth, held out) of the first ``SAMPLE`` labelled documents of each domain by a hash of doc_id."""
    ids = None
    for d in domains:
        part = labelled.select("doc_id", "domain").where((F.col("domain") == d) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        ids = part if ids is None else ids.union(part)
    ids = ids.dropDuplicates(["doc_id"])
    own = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    return cut_lineage(own.join(F.broadcast(ids), "doc_id").select("doc_id", "domain", tokens(F.col("text")).alias("b"), (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).alias("held")))


def _evidence(rows: DataFrame, domains: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (domains x DIMS) of the tokens that a document has, and what each domain gets for those that it lacks.

    A token counts by its log odds in the domain, and for nothing where no domain stands out.

    The counts come to the driver as one row of ``DIMS`` entries.
    """
    n = rows.groupBy().agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n_{k}") for k, d in enumerate(domains)])
    got = rows.select("domain", F.explode("b").alias("i")).groupBy("i").agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c_{k}") for k, d in enumerate(domains)])
    every = rows.sparkSession.range(DIMS).select(F.col("id").cast("int").alias("i")).join(got, "i", "left")
    one = every.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", *[F.coalesce(f"c_{k}", F.lit(0)).alias(f"c_{k}") for k in range(len(domains))]))).alias("c"))
    row = one.join(F.broadcast(n), F.lit(True)).first()
    size = np.array([row[f"n_{k}"] or 0 for k in range(len(domains))], float)
    count = np.array([[c[f"c_{k}"] for c in row["c"]] for k in range(len(domains))], float)
    p = (count + 2) / (size[:, None] + 4)
    logs = np.log(p)
    strong = np.abs(logs - logs.mean(axis=0)).max(axis=0) >= STRONG
    return np.where(strong, logs - np.log1p(-p), 0.0), np.where(strong, np.log1p(-p), 0.0).sum(axis=1)


def _logits(model: tuple[np.ndarray, np.ndarray]) -> list[Column]:
    """Token evidence of each domain, without the prior. The weights, ``DIMS`` numbers for each domain, are constants of the plan: a join
    with their row would copy them into every document's row."""
    def one(k: int) -> Column:
        held = F.split(F.lit(",".join(f"{x:.5g}" for x in model[0][k])), ",").cast("array<double>")
        return F.aggregate("b", F.lit(float(model[1][k])), lambda a, i: a + F.get(held, i))

    return [one(k) for k in range(len(model[1]))]


def _soft(z: Sequence[Column]) -> list[Column]:
    top = F.greatest(*z) if len(z) > 1 else z[0]
    e = [F.exp(x - top) for x in z]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: Sequence[str]) -> DataFrame:
    """``docs`` with ``p``: an array of the probabilities of ``domains``, in their order.

    Naive Bayes on distinct hashed tokens of a bounded sample of ``labelled`` (doc_id, domain); its evidence is divided by a temperature,
    chosen by the likelihood of a held-out fifth of the sample, because tokens are not independent.
    """
    k = len(domains)
    seen = sample(docs, labelled, domains)
    part = _evidence(seen.where("not held"), domains)
    z = seen.where("held").select("domain", F.array(*_logits(part)).alias("z"))

    def right(heat: float) -> Column:
        p = _soft([F.get("z", F.lit(i)) / heat for i in range(k)])
        return F.sum(sum((F.when(F.col("domain") == d, F.log(p[i] + 1e-9)).otherwise(0.0) for i, d in enumerate(domains)), F.lit(0.0)))

    like = z.agg(*[right(h).alias(f"h{i}") for i, h in enumerate(HEATS)]).first()
    heat = max(HEATS, key=lambda h: (like[f"h{HEATS.index(h)}"] is not None, like[f"h{HEATS.index(h)}"] or 0.0))
    model = _evidence(seen, domains)
    scored = docs.select("*", tokens(F.col("text")).alias("b"))
    # the sample is balanced, the collection need not be: the labelled table's own shares are the prior
    n = labelled.groupBy().agg(*[F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"d{i}") for i, d in enumerate(domains)]).first()
    count = [(n[f"d{i}"] or 0) + 1 for i in range(k)]
    prior = [F.log(F.lit(c / sum(count))) for c in count]
    # the evidence once for each row, then the probabilities from it
    scored = scored.select(*docs.columns, F.array(*_logits(model)).alias("_z"))
    p = let(F.col("_z"), lambda z: F.array(*_soft([F.get(z, F.lit(i)) / heat + prior[i] for i in range(k)])))
    return scored.select(*docs.columns, p.alias("p"))


def fit_rates(soft: DataFrame, targets: Sequence[float], tolerance: float = 1e-3, most: int = 30, stored_every: int = 8) -> DataFrame:
    """``soft`` (n, p, further columns) with ``rate``: nonnegative, with sum over rows of rate * n * p[k] nearest to targets[k].

    Projected gradient steps of least squares: rate <- max(0, rate - p . g). The gradient is scaled by the inverse Gram matrix of the rows whose
    rate is above 0 (tokens that each two domains share), so targets are met in a few steps although rates are cut off at 0; a step that
    takes the totals further from the targets is followed by shorter ones. A rate is the fold of the steps so far and is written
    down every ``stored_every`` steps. A step reads the table once and returns some k * k numbers. Ends when every target is met to
    ``tolerance``, when three steps bring next to nothing, or after ``most`` steps, with the rates that came nearest so far: targets can be out of reach.
    """
    k = len(targets)
    state = soft.withColumn("rate", F.lit(1.0)).withColumn("_best", F.lit(1.0))
    steps: list[list[float]] = []
    p = [F.get("p", F.lit(i)) for i in range(k)]

    def rate() -> Column:
        if not steps:
            return F.col("rate")
        held = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])

        def dot(s: Column) -> Column:
            return sum((F.get(s, F.lit(i)) * p[i] for i in range(1, k)), F.get(s, F.lit(0)) * p[0])

        return F.aggregate(held, F.col("rate"), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))

    want = np.array(targets, float)
    length, before, best, idle = 1.0, np.inf, np.inf, 0
    for _ in range(most):
        now = state.withColumn("r", rate()).agg(
            *[F.sum(F.col("n") * p[i] * F.col("r")).alias(f"f{i}") for i in range(k)],
            *[F.sum(F.when(F.col("r") > 0, F.col("n") * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
        off = np.array([now[f"f{i}"] or 0.0 for i in range(k)]) - want
        miss = float((off * off / np.maximum(want, 1e-9)).sum())
        idle = 0 if miss < 0.98 * best else idle + 1
        if miss < best:
            best = miss
            state = state.withColumn("_best", rate())
        if (np.abs(off) <= tolerance * np.maximum(want, 1e-9)).all() or idle >= 3:
            break
        length = length / 2 if miss > before else min(1.0, 2 * length)
        before = miss
        gram = np.array([[now[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        # a domain of next to no tokens can't be scaled up to its target at once: the ridge keeps its steps short
        gram += np.eye(k) * (1e-4 * np.trace(gram) / k + 1e-9)
        steps.append([float(length * x) for x in np.linalg.solve(gram, off)])
        if len(steps) >= stored_every:
            state = cut_lineage(state.withColumn("rate", rate()))
            steps = []
    return state.drop("rate").withColumnRenamed("_best", "rate")


def mixture(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float = 1.0) -> DataFrame:
    """doc_id, text_hash, n_tokens, p (posteriors in the order of ``targets``), rate and copies for every row of ``docs``.

    ``targets`` gives each domain's share of the mixture, ``budget`` the mixture's tokens as a multiple of the table's. ``copies`` is the
    rate rounded up or down by a hash of doc_id and text, so that the mean over documents is the rate.

    Null and empty texts have no tokens: their posterior is the prior. Repeated rows and null ids are rows like others. Further columns
    are ignored. An empty table gives an empty result. Domains without labelled rows get the prior of one row.
    """
    soft = posteriors(docs.select("doc_id", "text"), labelled, list(targets))
    soft = cut_lineage(soft.select("doc_id", F.xxhash64("text").alias("text_hash"), n_tokens(F.col("text")).alias("n"), "p"))
    total = soft.agg(F.sum("n")).first()[0] or 0
    fitted = fit_rates(soft, [budget * total * t / sum(targets.values()) for t in targets.values()])
    u = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return fitted.select("doc_id", "text_hash", F.col("n").alias("n_tokens"), "p", "rate", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float = 1.0) -> DataFrame:
    """The rows of ``docs`` that are in the mixture, with n_tokens, p, rate and copies; rows of no copies are out.

    Columns of ``docs`` named like the new ones are replaced. For the rest see `mixture`.
    """
    own = docs.drop("n_tokens", "p", "rate", "copies")
    got = mixture(own, labelled, targets, budget).where("copies > 0").dropDuplicates(["doc_id", "text_hash"])
    got = got.withColumnsRenamed({"doc_id": "__mix_doc", "text_hash": "__mix_text"})
    out = own.withColumn("__mix_own", F.xxhash64("text")).join(got, F.col("doc_id").eqNullSafe(F.col("__mix_doc")) & (F.col("__mix_own") == F.col("__mix_text")))
    return out.select(*own.columns, "n_tokens", "p", "rate", "copies")
