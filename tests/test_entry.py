"""The driver contract: every SQL twin belongs to a query; a spread of queries agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["anova_fdr", "kruskal_wallis", "fisher_enrichment", "kaplan_meier", "logrank_test", "gene_cox_screen", "quantile_summary", "majority_vote",
          "anonymise_genes", "swap_survival", "degree_weights", "trace_calls", "panel_summary", "episode_resources", "name_containment", "weighted_total"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(_norm(x) for x in v) if isinstance(v, list) else v


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150 and len(o) > 130


def test_flagship(spark):
    assert set(entry.entry(spark).columns) == {"feature", "f", "p", "fdr", "significant"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = sorted((tuple(_norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    want = sorted((tuple(_norm(x) for x in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert got == want
