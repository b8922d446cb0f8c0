"""Shards, runs and collocations against plain versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import collocations, periodic, shards, suffixtree


@pytest.fixture
def clash():
    return [F.lit("mine").alias(c) for c in ("size", "key", "at", "bytes", "shard", "slot", "inside", "before", "_row", "_b", "_p", "f", "phrase", "runs", "start", "period", "n_words", "w", "m", "rank")]


def smallest(sizes, k):
    """The smallest capacity, by trying them all."""
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= k

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("hot", [0, 40, 4000])
def test_shards(spark, clash, hot):
    rng = random.Random(hot)
    rows = [(i, "w" * rng.randrange(1, 60) + str(i)) for i in range(150)] + [(500 + i, "copy of one text") for i in range(30)] + [(700, "x" * hot), (None, "no id"), (None, None), (None, ""), (9, None), (9, None)]
    got = shards.partition(spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash), 8).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, len(t or "") + 1) for d, t in rows)
    groups = Counter()
    for _, t in rows:
        groups[md5((t or "").encode()).hexdigest()] += len(t or "") + 1
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(load.values()) == smallest([groups[k] for k in sorted(groups)], 8)
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_few_groups(spark):
    df = spark.createDataFrame([(i % 3, "same") for i in range(20)] + [(None, "other")], "doc_id long, text string")
    got = shards.partition(df, 8).collect()
    assert len({r["shard"] for r in got if r["size"] == 5}) == 1 and len({r["shard"] for r in got}) == 2
    assert shards.partition(df.where("false"), 8).count() == 0


def runs(words, least=6, times=4):
    """All runs, by trying every period."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            stretch = words[i : i + size]
            if j > i and size >= max(least, times * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_extensions():
    rng = random.Random(3)
    for size in (1, 2, 17, 200):
        s = np.array([rng.randrange(1, 4) for _ in range(size)])
        tree = suffixtree.SuffixTree(s)
        order = sorted(range(size + 1), key=lambda i: [*s[i:].tolist(), 0])
        assert [order[r] for r in tree.rank] == list(range(size + 1)) or tree.rank.tolist() == [order.index(i) for i in range(size + 1)]
        i, j = map(np.array, zip(*[(a, b) for a in range(size) for b in range(size + 1) if a != b], strict=True))
        want = [next((k for k in range(size + 1) if a + k >= size or b + k >= size or s[a + k] != s[b + k])) for a, b in zip(i, j, strict=True)]
        assert tree.extension(i, j).tolist() == want


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2)])
def test_runs_in_words(least, times):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 5)):
            n, k, p = rng.randint(0, 60), rng.choice([1, 2, 3, 6]), rng.randint(1, 9)
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            a = rng.randint(0, n)
            texts.append([w[i] if i < a or rng.random() < 0.02 else w[min(n - 1, a + (i - a) % p)] for i in range(n)])
        found = periodic.find_in_words(texts, least, times)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [runs(w, least, times) for w in texts]


def test_find_runs(spark, clash):
    tail = " ".join(["Ab c"] * 5000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 5), (5, "a " * 6), (5, "a " * 6), (None, "x y\tx\ny x y x y z"), (6, f"start {tail} end"), (7, "ä" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(df).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (5, 6, [(0, 6, 1)], "a"), (5, 6, [(0, 6, 1)], "a"), (None, 9, [(0, 8, 2)], "x y z"),
            (6, 10_002, [(1, 10_000, 2)], "start Ab c end"), (7, 1, [], "ä" * 100_000)]
    assert got == sorted(want, key=str) and periodic.find_runs(df.where("false")).count() == 0
    planted = periodic.with_planted_runs(df)
    assert planted.columns == df.columns and planted.where("doc_id IS NULL").first()["text"] == rows[6][1]


def phrases(rows, support, cover):
    """All candidates with their lowest cut, and whether a longer one covers them."""
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    out = {}
    for (lang, *w), a in found.items():
        score, k = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        longer = [b for (x, *v), b in found.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        out[lang, " ".join(w)] = (a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score, any(100 * b >= cover * a for b in longer))
    return out


def test_collocations(spark, clash):
    rng = random.Random(5)
    words = ["Ab", "c", "d", "é", "in one", "\x1c", "g"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", "\t ", " ", " ", ", ", ".\n"]) for _ in range(rng.randint(0, 40)))) for _ in range(200)]
    rows += [("en", None), (None, None), ("fr", ""), ("en", "c d g " * 2000), ("en", "c d g " * 2000), ("de", ",.;:!?\x0b\x0c\r\n")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(11, "doc_id").select("*", *clash)
    found = collocations.collocations(df, support=12, cover=80)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"], r["covered"]) for r in found.collect()}
    assert got == phrases(rows, 12, 80) and any(x[-1] for x in got.values())
    kept = [(lang, -x[4], -x[0], p.encode(), p) for (lang, p), x in got.items() if not x[-1]]
    want = [(lang, [x for x in sorted(kept) if x[0] == lang][:5]) for lang in sorted({x[0] for x in kept})]
    ranked = collocations.top(found, 5, spread=3).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in ranked) == [(lang, i + 1, x[-1]) for lang, xs in want for i, x in enumerate(xs)]


def test_no_collocations(spark):
    df = spark.createDataFrame([(1, "en", "a b c")], "doc_id long, lang string, text string")
    assert collocations.collocations(df).count() == 0 and collocations.top(collocations.collocations(df.where("false"))).count() == 0
