"""The registered queries against SQL or a plain version, over whole small tables."""

import hashlib
import zlib

import duckdb
import pytest

from cohortia.llm import queries as q
from cohortia.llm import urls
from tests.llm import brute

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall()


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_op1(spark, rows):
    got = by_id(q.op1_minhash_near_dedup(spark, D))
    want = brute.near_duplicates(rows, 4)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = q.QUERIES[name](spark, D)
    rel = con.sql(q.ORACLES[name])
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_op3(spark, rows):
    want = brute.edited(rows)
    df = q.op3_document_fingerprints(spark, D)
    got = {r["doc_id"]: r for r in df.collect()}
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in got.items()} == {d: w[:2] for d, w in want.items()}
    same = {}
    for d, t in rows:
        assert same.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    # the estimate is unbiased: its mean is near the true share of shingles
    def truth(a, b):
        pad = [b"\0"] * 4
        sets = []
        for t in (a, b):
            w = pad + (t or "").encode().lower().split() + pad
            sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
        return len(sets[0] & sets[1]) / min(map(len, sets)), min(map(len, sets))

    off = [got[d]["near_edited"] - share for d, t in rows for share, size in [truth(t, want[d][2])] if size > 100]
    assert len(off) > 50 and abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.3


def test_op4(spark):
    got = q.op4_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and (got["rate"] >= 0).all()
    p = got[["p_good", "p_toxic", "p_poor"]]
    assert abs(p.sum(axis=1) - 1).max() < 1e-9
    total = got["n_tokens"].sum()
    share = p.mul(got["rate"] * got["n_tokens"], axis=0).sum() / (1.25 * total)
    assert abs(share["p_good"] - 0.92) < 0.001 and abs(share["p_toxic"] - 0.05) < 0.001 and abs(share["p_poor"] - 0.03) < 0.001
    assert ((got["copies"] - got["rate"]).abs() < 1).all()


def test_op5(spark):
    d = "/root/testdata/sf0.1"
    got = q.op5_toxicity(spark, d).toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    truth = duckdb.sql(f"SELECT doc_id, toxic, lang FROM '{d}/labels.parquet' JOIN '{d}/documents.parquet' USING (doc_id)").df()
    # in these tables the label has a cause in the text of English documents only
    held = got[got["held_out"]].merge(truth[truth["lang"] == "en"], on="doc_id")
    pos, neg = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert (pos["predicted"] == 1).mean() > 0.8 and (neg["predicted"] == 1).mean() < 0.01


def test_op7(spark):
    d = "/root/testdata/sf0.1"
    got = q.op7_quality(spark, d).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").df()
    both = got.merge(truth, on="doc_id")
    assert len(got) == 10_000 and (both["selected"] == (both["quality"] == 1)).mean() > 0.95


def test_op8(spark, rows):
    items = duckdb.sql(f"SELECT item_id, text FROM '{D}/benchmark.parquet'").fetchall()
    words = lambda t: (t or "").encode().lower().split()
    want = {}
    for d, t in rows:
        w = words(t)
        grams = brute.shingles(t, 5)
        for i, x in items:
            if len(w) >= 5 and grams & brute.shingles(x, 5):
                c = brute.coverage(words(x), w, 5)
                if c >= 0.6:
                    want[d, i] = c
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in q.op8_decontamination(spark, D).collect()}
    assert got == pytest.approx(want) and want


def test_op9(spark):
    got = by_id(q.op9_url_filter(spark, "/root/testdata/sf0.01"))
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for page, url in duckdb.sql("SELECT page_id, url FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        host, path, rule, verdict, score = got[page]
        assert (host, path) == urls.parts(url) and f"://{host}{path}" in url.lower().replace(path.lower(), path)
        fits = [r for r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        assert rule == max(fits, key=len, default=None)
        assert verdict == (rules[rule] if rule else ("block" if score >= 0.5 else "allow"))
        if rule is None:
            assert (verdict == "block") == any(x in host for x in ("spam", "pills", "bets", "casino", "adult"))


def test_op10(spark):
    d = "/root/testdata/sf0.01"
    got = by_id(q.op10_pii(spark, d))
    for doc, text in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall():
        n, spans = brute.personal(text)
        r = got[doc]
        assert r[:4] == tuple(n[k] for k in brute.PATTERNS) and r[4] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r[5].split(","))


def test_op10_terms(spark):
    """Terms come out on a given table, where hardly any value stands in more than two documents."""
    spans = [r["spans"].split(",") for r in q.op10_pii(spark, "/root/testdata/sf0.01").collect()]
    assert sum(x.startswith("term:") for s in spans for x in s) > 0
