"""Projections, reshaping, joins, aggregations, windows, top-k and set operations."""

from pyspark.sql import functions as F

from cohortia.operators import aggregates as ag
from cohortia.operators import ordered
from cohortia.operators import reshape as rs
from cohortia.operators import survival as sv
from cohortia.queries.registry import query, r, rounded
from cohortia.queries.shapes import (COUNTS, EXPR, GRP, PRESENCE, SEGMENT, counts, expr, grp, presence, segment, table,
                                     with_sql)

# ---- reshaping ----------------------------------------------------------------------------------------------------

_MEAS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("melt_wide", "SELECT sample_id, feature, value FROM (SELECT l_orderkey || '-' || l_linenumber AS sample_id, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))")
def melt(spark, d):
    w = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), *_MEAS)
    return rs.melt(w, ["sample_id"])


@query("pivot_long", "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY 1")
def pivot(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.lit(1).alias("one"))
    return rs.pivot(c, ["c_nationkey"], "c_mktsegment", "one", "count")


@query("cpm_log2", with_sql(COUNTS, body=f"SELECT sample_id, feature, {r('log2(value / sum(value) OVER (PARTITION BY sample_id) * 1e6 + 1)')} AS value FROM counts"))
def cpm(spark, d):
    return rounded(rs.cpm_log2(counts(spark, d)))


@query("log_transform", with_sql(COUNTS, body=f"SELECT sample_id, feature, {r('ln(value + 1)')} AS value FROM counts"))
def log1p(spark, d):
    return rounded(rs.log_transform(counts(spark, d), "e"))


@query("restrict_to_list", with_sql(COUNTS, body="SELECT * FROM counts WHERE feature IN (SELECT p_brand FROM part WHERE p_size = 1)"))
def restrict(spark, d):
    genes = table(spark, d, "part").where("p_size = 1").select(F.col("p_brand").alias("feature"))
    return rs.restrict(counts(spark, d), genes)


@query("top_variable_features", with_sql(COUNTS, body=f"SELECT feature, {r('stddev(value)')} AS spread FROM counts GROUP BY 1 ORDER BY stddev(value) DESC, feature LIMIT 10"))
def top_var(spark, d):
    return rounded(rs.top_variable_features(counts(spark, d), 10))


@query("zscore_features", with_sql(COUNTS, body=f"SELECT sample_id, feature, {r('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS z FROM counts WINDOW w AS (PARTITION BY feature)"))
def zscore(spark, d):
    return rounded(sv.zscore(counts(spark, d)).select("sample_id", "feature", "z"))


@query("impute_feature_mean", with_sql(COUNTS, body=f"SELECT sample_id, feature, {r('coalesce(CASE WHEN value > 40 THEN value END, avg(CASE WHEN value > 40 THEN value END) OVER (PARTITION BY feature))')} AS value FROM counts"))
def impute(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") > 40, F.col("value")))
    return rounded(rs.impute_mean(c).select("sample_id", "feature", "value"))


@query("quantile_bins", with_sql(COUNTS, "q AS (SELECT feature, quantile_cont(value, 1/3) AS a, quantile_cont(value, 2/3) AS b FROM counts GROUP BY 1)",
       body="SELECT sample_id, feature, (value > a)::INT + (value > b)::INT AS bin FROM counts JOIN q USING (feature)"))
def bins(spark, d):
    c = counts(spark, d)
    return ordered.quantile_bins(c, ["feature"], "value", 3).select("sample_id", "feature", "bin")


@query("clip_rescale", f"SELECT p_partkey, {r('least(greatest((p_retailprice - 900) / 20.0, 0), 1)')} AS score FROM part")
def clip(spark, d):
    return rounded(table(spark, d, "part").select("p_partkey", rs.clip01((F.col("p_retailprice") - 900) / 20.0).alias("score")))


@query("coarse_label", "SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'economy' WHEN p_type LIKE 'S%' THEN 'small-or-standard' WHEN p_type = 'PROMO' THEN 'promotion' ELSE p_type END AS coarse FROM part")
def coarse(spark, d):
    return table(spark, d, "part").select("p_partkey", rs.first_prefix(
        "p_type", [("ECO", "economy"), ("S", "small-or-standard")], {"PROMO": "promotion"}).alias("coarse"))


@query("split_cohort_label", """SELECT DISTINCT sample_id, CASE cohort WHEN 'NATION_1' THEN 'N1' ELSE cohort END AS cohort, subtype FROM (
 SELECT c_custkey AS sample_id, 'NATION_' || c_nationkey AS cohort, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'NA' ELSE c_mktsegment || '.' || (c_custkey % 2) END AS subtype FROM customer) WHERE subtype <> 'NA'""")
def split_label(spark, d):
    c = table(spark, d, "customer")
    sub = F.when(F.col("c_mktsegment") == "MACHINERY", "NA").otherwise(F.concat_ws(".", "c_mktsegment", (F.col("c_custkey") % 2).cast("string")))
    lab = c.select(F.col("c_custkey").alias("sample_id"), F.concat_ws(".", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), sub).alias("full"))
    return rs.split_cohort_label(lab, "full", {"NATION_1": "N1"})


@query("encode_levels", """SELECT gene, site, max(code)::INT AS code FROM (SELECT p_brand AS gene, p_type || '__' || p_name AS site,
 CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN 1 WHEN p_size % 5 = 2 THEN 2 WHEN p_size % 5 = 3 THEN 3 ELSE -1 END AS code FROM part WHERE p_size % 3 <> 0) GROUP BY 1, 2""")
def levels(spark, d):
    lv = F.element_at(F.array(*[F.lit(x) for x in ("Not detected", "Low", "Medium", "High", "Ascending")]), F.col("p_size") % 5 + 1)
    rel = F.element_at(F.array(F.lit("Uncertain"), F.lit("Approved"), F.lit("Supported")), F.col("p_size") % 3 + 1)
    p = table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("tissue"), F.col("p_name").alias("cell_type"), lv.alias("level"), rel.alias("reliability"))
    return rs.encode_levels(p)


@query("clean_symbols", "SELECT p_partkey, CASE p_name WHEN 'red bolt' THEN 'crimson bolt' ELSE p_name END AS gene FROM part WHERE NOT regexp_matches(p_name, '^small') AND NOT regexp_matches(p_name, '^blue [a-m]') AND NOT starts_with(p_name, 'green')")
def clean(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("gene"))
    return rs.clean_symbols(p, "gene", {"red bolt": "crimson bolt"}, ["^small", "^blue [a-m]"], ["green"])


@query("functional_variants", "SELECT l_orderkey, l_linenumber, l_returnflag AS variant_class, l_discount AS vaf FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber <> 3 AND l_discount >= 0.05")
def variants(spark, d):
    vaf = F.when(F.col("l_linenumber") == 3, "bad").otherwise(F.col("l_discount").cast("string"))
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("variant_class"), vaf.alias("vaf"))
    return rs.functional_variants(m, ["R", "A"], 0.05)


@query("cohort_columns", "SELECT substr(c_name, 1, 17) AS sample_id, feature, avg(value) AS value FROM (SELECT c_name, unnest(['bal', 'key']) AS feature, unnest([c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END::DOUBLE]) AS value, c_nationkey FROM customer WHERE c_custkey % 7 <> 0 OR c_acctbal IS NOT NULL) WHERE c_nationkey < 3 GROUP BY 1, 2")
def cohort_cols(spark, d):
    c = table(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("double"))
    long = rs.melt(c.select(F.concat(F.col("c_name"), F.lit("-01A")).alias("sample_id"), F.col("c_acctbal").alias("bal"), key.alias("key")), ["sample_id"])
    coh = c.where("c_nationkey < 3").select(F.substring("c_name", 1, 18).alias("sample_id"))
    out = rs.cohort_columns(long, coh, 18)
    return out.groupBy(F.substring("sample_id", 1, 17).alias("sample_id"), "feature").agg(F.avg("value").alias("value"))


@query("dedup_best_row", "SELECT DISTINCT ON (p_name) p_name, p_partkey, p_retailprice FROM part ORDER BY p_name, p_retailprice DESC, p_partkey")
def dedup(spark, d):
    p = table(spark, d, "part").select("p_name", "p_partkey", "p_retailprice")
    return rs.best_row(p, ["p_name"], [-F.col("p_retailprice"), F.col("p_partkey")])


@query("dedup_most_complete", """WITH n AS (SELECT p_brand AS gene, p_type AS variant, count(CASE WHEN p_size > 20 THEN 1 END) AS k FROM part GROUP BY 1, 2)
 SELECT gene, arg_min(variant, (-k, variant)) AS variant FROM n GROUP BY 1""")
def complete(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("variant"), F.when(F.col("p_size") > 20, 1.0).alias("value"))
    return rs.most_complete(p, "gene", "variant").select("gene", "variant").distinct()


@query("top_k_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rs.top_k_per_key(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("best_of_group", "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY 1")
def best(spark, d):
    key = F.struct("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", key).alias("best"), F.min_by("o_orderkey", key).alias("worst"))


@query("random_pick", "SELECT c_nationkey, c_custkey, rn::BIGINT AS rn FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('5|' || c_nationkey || '|' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 4")
def pick(spark, d):
    return ag.pick_n(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], 5, ["c_custkey"], 4)


# ---- aggregations -------------------------------------------------------------------------------------------------

@query("group_summary", f"SELECT event_type, count(value) AS n, {r('avg(value)')} AS mean, {r('stddev(value)')} AS sd, {r('stddev_pop(value)')} AS sd_pop, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('median(value)')} AS median FROM events GROUP BY 1")
def summary(spark, d):
    return rounded(ag.group_summary(table(spark, d, "events"), ["event_type"], "value"))


@query("distinct_samples", "SELECT p_brand, count(DISTINCT o_custkey) AS n_samples FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def distinct_samples(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    p, o = table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return ag.distinct_samples(j, ["p_brand"], "o_custkey")


@query("joined_names", "SELECT p_brand, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names FROM part GROUP BY 1")
def names(spark, d):
    return ag.joined_names(table(spark, d, "part"), ["p_brand"], "p_name", "names")


@query("conditional_any", "SELECT o_custkey, bool_or(o_orderstatus = 'F' AND o_totalprice > 400000) AS big_filled, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def any_of(spark, d):
    return ag.any_by_group(table(spark, d, "orders"), ["o_custkey"], {
        "big_filled": (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("value_counts", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 8")
def vc(spark, d):
    return ag.value_counts(table(spark, d, "part"), ["p_name"], 8)


@query("contingency_table", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def cont(spark, d):
    return ag.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("share_of_group", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus)')} AS share FROM orders GROUP BY 1, 2")
def share(spark, d):
    return rounded(ag.share_of_group(ag.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), ["o_orderstatus"]))


@query("alteration_frequency", with_sql(COUNTS, body=f"SELECT feature, count(*) AS n, {r('avg((value > 60)::INT)')} AS frequency FROM counts GROUP BY 1"))
def alteration(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") > 60, 1.0).otherwise(0.0))
    return rounded(ag.alteration_frequency(c))


@query("modality_coverage", with_sql(COUNTS, SEGMENT, "s AS (SELECT label, sample_id, bool_or(value > 90) AS c FROM counts JOIN segment USING (sample_id) GROUP BY 1, 2)",
       body=f"SELECT label, count(*) AS n_samples, count(*) FILTER (c) AS n_covered, {r('avg(c::INT)')} AS coverage FROM s GROUP BY 1"))
def cover(spark, d):
    c = counts(spark, d).withColumn("value", F.when(F.col("value") > 90, 1.0).otherwise(0.0)).join(segment(spark, d), "sample_id")
    return rounded(ag.coverage(c, ["label"]))


@query("majority_vote", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, sum(n)::BIGINT AS n_votes, max(n) AS top_votes FROM c GROUP BY 1),
 t AS (SELECT user_id, n_votes, top_votes, list(event_type) AS l FROM m JOIN c USING (user_id) WHERE n = top_votes GROUP BY ALL) SELECT user_id, n_votes, top_votes, CASE WHEN len(l) = 1 THEN l[1] END AS consensus FROM t""")
def vote(spark, d):
    return ag.majority(table(spark, d, "events"), ["user_id"], "event_type")


@query("rollup_report", f"SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return rounded(ag.rollup_report(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")]), 2)


@query("event_burden", with_sql(COUNTS, PRESENCE, body="SELECT sample_id, count(*) AS burden FROM presence GROUP BY 1"))
def burden(spark, d):
    return ag.burden(presence(spark, d))


@query("co_occurrence", with_sql(COUNTS, PRESENCE, body="SELECT a.gene AS a, b.gene AS b, count(*) AS n FROM presence a JOIN presence b ON a.sample_id = b.sample_id AND a.gene < b.gene GROUP BY 1, 2"))
def cooc(spark, d):
    genes = table(spark, d, "part").select(F.col("p_brand").alias("gene"))
    return ag.co_occurrence(presence(spark, d), genes)


# ---- joins --------------------------------------------------------------------------------------------------------

@query("common_samples", "SELECT c_custkey AS sample_id FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def common(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "sample_id")
    return ag.common_samples(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sample_id")),
                             o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '5-LOW'"))


@query("align_to_samples", "SELECT c_custkey AS sample_id, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON o_custkey = c_custkey")
def align(spark, d):
    v = table(spark, d, "orders").where("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n"))
    return ag.align(v, table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")))


@query("left_join_defaults", "SELECT n_nationkey, n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (n_nationkey)")
def defaults(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return ag.left_with_defaults(table(spark, d, "nation").select("n_nationkey", "n_name"), s, ["n_nationkey"], {"n": 0})


@query("semi_and_anti_join", "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'in' ELSE 'out' END AS side, count(*) AS n FROM customer GROUP BY 1")
def semi_anti(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    u = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    both = c.join(u, "k", "left_semi").withColumn("side", F.lit("in")).union(c.join(u, "k", "left_anti").withColumn("side", F.lit("out")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("stack_cohorts_inner", with_sql(COUNTS, "c AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'even' ELSE 'odd' END AS cohort FROM counts WHERE value > 110)",
       body="SELECT cohort, feature, count(*) AS n FROM c WHERE feature IN (SELECT feature FROM c GROUP BY 1 HAVING count(DISTINCT cohort) = 2) GROUP BY 1, 2"))
def stack(spark, d):
    c = counts(spark, d).where("value > 110")
    s = ag.stack_inner({"even": c.where("sample_id % 2 = 0"), "odd": c.where("sample_id % 2 = 1")})
    return s.groupBy("cohort", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("stack_cohorts_outer", "SELECT 'a' AS cohort, c_custkey AS id, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 'b', s_suppkey, NULL, s_name FROM supplier")
def stack_outer(spark, d):
    return ag.stack_outer({"a": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")),
                           "b": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))})


@query("label_by_either_id", """WITH m AS (SELECT 'S' || c_custkey AS anon, c_name AS original, c_custkey FROM customer WHERE c_custkey % 3 <> 0),
 s AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'S' || c_custkey END AS sample_id, c_mktsegment AS label, c_name, c_nationkey FROM customer)
 SELECT sample_id, label, 'N' || c_nationkey AS truth FROM s WHERE c_nationkey <> 7""")
def either(spark, d):
    c = table(spark, d, "customer")
    anon = F.concat(F.lit("S"), F.col("c_custkey").cast("string"))
    has = F.col("c_custkey") % 3 != 0
    s = c.select(F.when(has, anon).otherwise(F.col("c_name")).alias("sample_id"), F.col("c_mktsegment").alias("label"))
    t = c.select(F.col("c_name").alias("id"), F.when(F.col("c_nationkey") == 7, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("truth"))
    return ag.label_by_either_id(s, c.where(has).select(anon.alias("anon"), F.col("c_name").alias("original")), t)


@query("complete_grid", with_sql(COUNTS, body="SELECT s.sample_id, f.feature, coalesce(value, 0) AS value FROM (SELECT DISTINCT sample_id FROM counts WHERE value > 100) s CROSS JOIN (SELECT DISTINCT p_brand AS feature FROM part) f LEFT JOIN (SELECT * FROM counts WHERE value > 100) c ON c.sample_id = s.sample_id AND c.feature = f.feature"))
def grid(spark, d):
    return ag.complete_grid(counts(spark, d).where("value > 100"), table(spark, d, "part").select(F.col("p_brand").alias("feature")))


@query("name_containment", "SELECT b.item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def containment(spark, d):
    from cohortia.functions.text import contained_in
    return contained_in(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"),
                        "item_id", "doc_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# ---- sets ---------------------------------------------------------------------------------------------------------

@query("feature_universe", "SELECT DISTINCT trim(x) AS gene FROM (SELECT p_brand AS x FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN '  ' ELSE s_name END FROM supplier) WHERE trim(x) <> ''")
def universe(spark, d):
    p = table(spark, d, "part")
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "  ").otherwise(F.col("s_name")).alias("gene"))
    return ag.universe([p.select(F.col("p_brand").alias("gene")), p.select(F.col("p_type").alias("gene")), table(spark, d, "nation").select(F.col("n_name").alias("gene")), s])


@query("set_overlap", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS n_both")
def overlap(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return ag.overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@query("set_difference", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def difference(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return ag.only_in_first(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@query("overlap_fraction", f"SELECT o_orderpriority, {r('avg((o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))::INT)')} AS fraction FROM orders GROUP BY 1")
def fraction(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_custkey").alias("k"))
    return rounded(ag.overlap_fraction(o, table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k", ["o_orderpriority"]))


@query("leaked_ids", "SELECT DISTINCT p_name AS gene FROM part WHERE p_name NOT LIKE 'red%'")
def leaked(spark, d):
    return ag.leaked_ids(table(spark, d, "part").select(F.col("p_name").alias("gene")), "gene", "red")


# ---- windows ------------------------------------------------------------------------------------------------------

@query("average_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events WHERE value IS NOT NULL")
def avg_rank(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return ordered.add_rank(e, ["event_type"], "value", "rank").select("event_id", "rank")


@query("at_risk_counts", "SELECT event_type, value, sum(count(*)) OVER (PARTITION BY event_type ORDER BY value DESC)::BIGINT AS at_risk FROM events GROUP BY 1, 2")
def risk(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("duration"), F.lit(1).alias("event"))
    return sv.at_risk(e, ["event_type"]).select("event_type", F.col("duration").alias("value"), "at_risk")


@query("nth_event_gate", "SELECT event_id, user_id FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events) WHERE seen >= 3")
def gate(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return ag.nth_event_gate(e, "user_id", "event_id", F.col("event_type") == "purchase", 3).select("event_id", "user_id")


@query("first_event_index", "SELECT user_id, min(event_id) FILTER (event_type = 'error') AS first_error, min(event_id) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY 1")
def first_event(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first_error"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("first_purchase"))
