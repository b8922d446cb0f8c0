"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortia.llm import decontam, linededup, minhash, mixing, pii, quality, sketches, toxicity, urls, warc
from tests.llm import brute

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
LINE = "this line stands in many documents and has more than forty characters"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "ALPHA beta gamma delta epsilon zeta eta theta"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " tail"),
    (8, "one two"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (None, None), (9, f"{LINE}\nmore"), (10, f"  {LINE.upper()}\t\nmore\n{LINE}"), (11, LINE), (12, f"{LINE}\n\n"), (13, LINE + "\r"),
    (13, LINE + "\r"), (14, "x" * 200_000), (15, "mail me at a.b@c.de, card 4111 1111 1111 1111, ip 10.0.0.300 or 10.0.0.1, call +49 (30) 1234-5678."),
]


@pytest.fixture
def docs(spark):
    """Further columns have the names that operators use for their own."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit("mine").alias(c) for c in ("lang", "source", "n", "p", "rate", "node", "root", "s", "e", "term", "h1", "band", "n_lines", "selected", "next", "_id", "b")])


@pytest.fixture
def none(docs):
    return docs.where("false")


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, words=4).collect() if r["doc_id"] is not None}
    want = brute.near_duplicates([r for r in ROWS if r[0] is not None], 4)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert got[2]["component_id"] == 1 and got[7]["component_id"] == 6 and got[3]["kept"] and got[4]["kept"]
    lost = [r for r in minhash.near_duplicates(docs, words=4).collect() if r["doc_id"] is None]
    assert len(lost) == 2 and all(r["component_id"] is None and r["kept"] for r in lost)
    assert minhash.near_duplicates(none).count() == 0


def test_chain_in_one_bucket(spark):
    """A group of near copies whose smallest member is far from most of them is still one component."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"e{i}_{k}" if k < 2 else w for k, w in enumerate(base[: 120 - i % 25])])) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(rows, 4).items()}


def test_groups_near_the_threshold(spark):
    """Near copies of one text, some over and some under the threshold, beside documents of a template that are never linked."""
    base, form = [f"w{i}" for i in range(150)], [f"t{i}" for i in range(110)]
    rows = [(i, " ".join(w if (i * 37 + k * 11) % 97 >= i % 5 else f"c{i}_{k}" for k, w in enumerate(base))) for i in range(250)]
    rows += [(1000 + i, " ".join([*form, *[f"own{i}_{k}" for k in range(30)]])) for i in range(250)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    want = {d: c for d, (_, c) in brute.near_duplicates(rows, 4).items()}
    assert got == want and len(set(want.values())) > 250 and len({want[i] for i in range(250)}) < 200


def test_prefix_filter_alone(spark, monkeypatch):
    """The exact filter finds every link that the turns before it would."""
    monkeypatch.setattr(minhash, "HUB_TURNS", 0)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"e{i}_{k}" if k < 2 else w for k, w in enumerate(base[: 120 - i % 25])])) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(rows, 4).items()}


def test_lines(docs, none):
    out = linededup.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped", "kept_text"}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect() if r["doc_id"] is not None}
    assert got == brute.line_dedup([r for r in ROWS if r[0] is not None])
    assert got[13][2] == LINE + "\r" and got[10] == (3, 2, "more")
    assert linededup.dedup_lines(none).count() == 0


def test_fingerprints(docs, none):
    got = [r for r in sketches.fingerprints(docs).collect()]
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[3]["fingerprint"] == by[4]["fingerprint"] != ""
    assert by[6]["n_chars"] == len(LONG) and by[14]["n_chars"] == 200_000
    # 15 is the largest, 14 the next
    text = ROWS[-1][1]
    k = len(text) // 3
    assert by[15]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + "x" * k).encode()).hexdigest()
    assert sketches.fingerprints(none).count() == 0


def test_personal_data(docs, none):
    out = pii.find_personal_data(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    n, spans = brute.personal(ROWS[-1][1])
    assert {k: len(got[15][k]) for k in brute.PATTERNS} == {k: n[k] for k in brute.PATTERNS} == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    assert got[15]["sanitised"] == "mail me at [EMAIL], card [CARD], ip 10.0.0.300 or [IP], call [PHONE]."
    assert out.count() == len(ROWS) and pii.find_personal_data(none).count() == 0


TEXTS = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.02.3.4", "300.1.1.1 1.1.1.1", "+1 (2) 345-678 90-", "4111-1111-1111-1111 4", "é ü@x.y a+b@c-d.e.f.", "+12345678901", "@@a@b.c@d.e",
         "1" * 5000, "a" * 50_000, "a@" * 2000, "a@b" + ".c" * 5000, "1." * 3000, "+1" + " " * 5000, "12 34 56 78 90 12 34 5", "0" * 16, "word12 " * 20_000]


def test_patterns(spark):
    """Against the plain patterns; runs that could take quadratic time and many matches that fail their test among them."""
    based = pii.base_spans(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    for r in based.collect():
        n, _ = brute.personal(TEXTS[r["doc_id"]])
        assert {k: len(r[k]) for k in brute.PATTERNS} == {k: n[k] for k in brute.PATTERNS}
        for k in brute.PATTERNS:
            assert all(TEXTS[r["doc_id"]][m["s"] : m["e"]] == m["v"] for m in r[k])


def test_disclosing_terms(spark):
    """A word that stands by one person's address in every use gives it away; a common word doesn't."""
    rows = [(i, f"the case of zorgon is with z.g@mail.org since {i}") for i in range(5)] + [(10 + i, f"the case of nobody is with p{i}@mail.org since then") for i in range(40)]
    got = {r["doc_id"]: [rows_text[s["s"] : s["e"]] for s in r["term"] for rows_text in [r["text"]]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["zorgon"] for i in range(5)) and not any(got[10 + i] for i in range(40))


def _terms(spark, rows):
    out = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: sorted(r["text"][s["s"] : s["e"]] for s in r["term"]) for r in out}, {r["doc_id"]: r["sanitised"] for r in out}


def test_terms_of_rare_values(spark):
    """Values of one and of two documents are given away; words of many documents give nobody away."""
    rows = [(i, f"the case of nobody is with p{i}@mail.org since then") for i in range(100)]
    rows += [(200, "the case of zorgon is with z.g@mail.org, (q@x.org) since then"), (201, "a case of Bellat with b@mail.org then"), (202, "bellat is nobody: b@mail.org")]
    got, _ = _terms(spark, rows)
    assert got == {**{i: [] for i in range(100)}, 200: ["zorgon"], 201: ["Bellat"], 202: ["bellat"]}


def test_terms_anywhere(spark):
    """A term far from the value, and in a document without it."""
    pad = "of the case since then " * 30
    rows = [(i, pad + f"nobody p{i}@mail.org") for i in range(100)]
    rows += [(200 + i, f"zorgon {pad} z.g@mail.org {pad} zorgon's Zorgon") for i in range(9)] + [(300, f"{pad} zorgon")]
    got, clean = _terms(spark, rows)
    assert all(got[200 + i] == ["Zorgon", "zorgon", "zorgon's"] for i in range(9)) and got[300] == ["zorgon"] and not any(got[i] for i in range(100))
    assert clean[300] == f"{pad} " and "orgon" not in clean[200]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (5, "nobody has these words anywhere at all")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.leaks(docs, bench).collect())
    assert got == sorted([("1", 1), ("2", 1), ("None", 1), ("8", 4), ("8", 4)])
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in ROWS if d not in (1, 2, 8))
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.where("false")).count() == 0


def test_reordered_passage():
    """Tiles in any order, and the same tiles as by trying all places."""
    import numpy as np
    rng = np.random.default_rng(5)
    for _ in range(30):
        item = rng.integers(0, 40, 40).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 60, 30), item[25:], rng.integers(0, 60, 9), item[:14], item[:8], item[14:25]]).astype(np.uint64)
        t = decontam.tiles(item, doc, 5)
        assert sum(k for _, _, k in t) / 40 == pytest.approx(brute.coverage(item.tolist(), doc.tolist(), 5))
        assert all((item[i : i + k] == doc[j : j + k]).all() for i, j, k in t)


def test_repeated_phrases(spark):
    """Items whose seeds stand in several places, against tiles by trying all places."""
    phrase = [f"p{i}" for i in range(10)]
    rows = [[f"| row {i} | yes | no | never | maybe |"] for i in range(4)]
    items = [phrase * 10, phrase * 6 + [f"x{i}" for i in range(40)], " ".join(r[0] for r in rows).split(), ["la"] * 30]
    texts = [*items, phrase, phrase * 7 + ["tail"], items[1][30:] + items[1][:30], ["la"] * 17 + ["end"], ["la"] * 18]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.leaks(docs, bench).collect()}
    want = {(d, i): brute.coverage(item, w, 5) for d, w in enumerate(texts) for i, item in enumerate(items)}
    assert got == pytest.approx({k: c for k, c in want.items() if c >= 0.6}) and all(got[i, i] == 1 for i in range(4))


def test_stages_without_ids(spark):
    """The pipeline's stages on rows whose doc_id is null or repeats."""
    import corpus_pipeline as c
    d = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{d}/benchmark.parquet").where("length(text) > 60").first()["text"]
    copy, other, lone = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, item), (1, lone), (None, item), (5, copy), (3, copy), (3, copy), (None, copy + " more"), (None, other), (None, other), (None, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert left(c.decontamination(spark, docs, d)) == sorted([r for r in rows if r[1] != item], key=str)
    assert left(c.near_dedup(spark, docs, d)) == sorted([(1, item), (1, lone), (3, copy), (None, other), (None, None), (7, None)], key=str)


def test_classifiers(docs, none):
    train = [(f"good plain words number {i}", 1) for i in range(30)] + [(f"you idiot number {i}", 0) for i in range(30)]
    tox = toxicity.train([(t, 1 - y) for t, y in train])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, tox).collect()}
    assert got[3] == got[4] == got[5] and all(0 <= s <= 1 for s in got.values()) and toxicity.score(none, tox).count() == 0
    p = tox.probability(tox.margins(["idiot", "id-iot", "idiiot", "plain"]))
    assert p[0] > 0.5 and p[1] > p[3] and p[2] > p[3]
    model = quality.train([(t, 2 * y) for t, y in train], grades=3)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    out = quality.grade(docs, model)
    assert out.count() == len(ROWS) and "lang" in out.columns and quality.grade(none, model).count() == 0
    assert quality.train([], grades=3).thresholds.shape == (2,) and toxicity.train([]).probability(0.0) < 0.5


def test_mixing(spark, docs, none):
    labelled = spark.createDataFrame([(1, "a"), (2, "a"), (8, "b"), (None, "b"), (6, None)], "doc_id long, domain string")
    out = mixing.mixture(docs, labelled, {"a": 0.5, "b": 0.5})
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in rows)
    mixed = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5})
    assert {*docs.columns} <= {*mixed.columns} and mixing.mix(none, labelled, {"a": 0.5, "b": 0.5}).count() == 0
    assert mixing.mixture(docs, labelled.where("false"), {"a": 1.0}).count() == len(ROWS)


def test_archives(spark):
    big = "z" * 300
    rows = [(3, "http://a/ b", big), (1, None, big), (None, "x", big), (2, "y", None), (4, "y", ""), (5, "é", "short"), (6, "u", "short"), (7, "w", "é" * 60), (7, "w", "é" * 60), (8, "v", "a\r\n\r\nb" * 40)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {big: 1, "é" * 60: 7}
    want = [(i, len((t or "").encode()), sha(t), "revisit" if t in first and first[t] != i else "response", first[t] if t in first and first[t] != i else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_broken_archives(spark):
    good = [warc.record(i, "http://x/", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None) for i in range(3)]
    lies = warc.record(9, "http://x/", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    short = good[0].replace(b"Content-Length: ", b"Content-Length: 1", 1)
    whole = warc.archive(good)
    cases = {"good": whole, "cut": whole[:-5], "no dictionary": whole[4:], "empty": b"", "lies": warc.archive([good[0], lies, good[1]]), "length": warc.archive([short])}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    got = {}
    for r in warc.read_archives(df).collect():
        got.setdefault(r["path"], []).append((bytes(r["payload"]) if r["payload"] is not None else None, r["error"] is not None))
    assert got["good"] == [(b"payload %d" % i, False) for i in range(3)]
    assert got["cut"][-1][1] and got["no dictionary"] == [(None, True)] and got["empty"] == [(None, True)] and got["length"] == [(None, True)]
    assert got["lies"] == [(b"payload 0", False), (None, True), (b"payload 1", False)]


def test_urls(spark):
    model = urls.train(urls.LABELLED_URLS)
    rules = [urls.Rule.of("allow", "org/"), urls.Rule.of("block", "example.org/en/1")]
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/en/12?x"), (4, "http://org"), (5, "http://xorg/"), (6, "https://www.cheap-pills.example.com/"), (6, ""), (None, "ftp://example.org#f/")]
    got = sorted(map(tuple, urls.judge(spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, host string"), rules, model).collect()), key=str)
    by = {r[0]: r for r in got}
    assert by[1][1:4] == by[2][1:4] == ("", "", None) and by[3][1:5] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert by[4][1:4] == ("org", "", None) and by[5][3] is None and len(got) == len(rows) and by[None][1:4] == ("example.org", "", None)
    held = [(u.replace("example", "sample"), y) for u, y in urls.LABELLED_URLS]
    assert sum((model.score(*urls.parts(u)) >= 0.5) == y for u, y in held) / len(held) > 0.95


def test_lines_of_repeated_rows_and_long_texts(spark):
    """Rows of one doc_id are one document; a row without an id is one of its own; many dropped lines in one text."""
    other = "another line that is longer than forty characters, in five documents"
    rows = [(1, LINE)] * 4 + [(2, LINE)] + [(d, other) for d in (3, 3, 4, None, None, 5)]
    got = {(r["doc_id"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (4, 1), (None, 1), (5, 0)}
    many = "\n".join(f"{LINE} number {i}\nkept {i}" for i in range(20_000))
    docs = spark.createDataFrame([(d, many) for d in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.dedup_lines(docs).collect()}
    short = "\n".join(f"kept {i}" for i in range(20_000))
    assert got == {**{d: (40_000, 20_000, short) for d in range(4)}, 4: (40_000, 0, many)}
