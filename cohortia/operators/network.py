"""Edge lists: confidence filter, degree-penalised weights, multi-source shortest paths, Steiner subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.session import broadcast_if_small, cut_lineage, small_enough, spread


def split_by_relation(edges: DataFrame, relations: list[str], path: str) -> None:
    """Write the edges of chosen relations partitioned by relation."""
    edges.where(F.col("relation").isin(relations)).write.mode("overwrite").partitionBy("relation").parquet(path)


def relation_counts(edges: DataFrame, relations: list[str]) -> DataFrame:
    return edges.where(F.col("relation").isin(relations)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def confident_edges(links: DataFrame, names: DataFrame, min_score: int = 700) -> DataFrame:
    """(gene1, gene2, score): links at or above the score with both ids translated; untranslated links drop.

    links(id1, id2, score), names(id, symbol). The filter runs before the joins.
    """
    n = broadcast_if_small(names.select("id", "symbol"))
    x = links.where(F.col("score") >= min_score)
    x = x.join(n.withColumnRenamed("id", "id1").withColumnRenamed("symbol", "gene1"), "id1")
    x = x.join(n.withColumnRenamed("id", "id2").withColumnRenamed("symbol", "gene2"), "id2")
    return x.select("gene1", "gene2", "score")


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) with u < v, distinct, no loops. A task's hash table holds about a million pairs, whatever the size of its input."""
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = cut_lineage(edges.where("src <> dst").select(u.alias("u"), v.alias("v")))
    return spread(pairs, ["u", "v"], pairs.count(), 1_000_000).distinct()


def _by_rows(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast up to so many rows, merge beyond: a file of node names is a small part of its hash table, so Catalyst's bytes mislead."""
    return F.broadcast(df) if small_enough(df, rows) else df.hint("merge")


def degree_weights(edges: DataFrame, penalty: bool = True) -> DataFrame:
    """(u, v, weight): the mean degree of both ends, so that hubs are dear; 1 without the penalty."""
    e = cut_lineage(undirected(edges))
    if not penalty:
        return e.withColumn("weight", F.lit(1.0))
    deg = cut_lineage(e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("deg")))
    x = e.join(_by_rows(deg.select(F.col("node").alias("u"), F.col("deg").alias("_du"))), "u")
    x = x.join(_by_rows(deg.select(F.col("node").alias("v"), F.col("deg").alias("_dv"))), "v")
    return x.select("u", "v", ((F.col("_du") + F.col("_dv")) / 2.0).alias("weight"))


def nearest_terminal(weights: DataFrame, terminals: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, dist, terminal, parent): cheapest terminal of every reachable node.

    Relaxation by join and min over the nodes improved in the last round only, until nothing improves. Each round's
    table is written to the shared folder, so the plan stays short and a lost executor costs one round at most.
    Without ``max_rounds`` it goes on until nothing improves; a bound that is met before that raises an error.
    """
    both = cut_lineage(weights.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "weight").union(
        weights.select(F.col("v"), F.col("u"), "weight")))
    state = cut_lineage(terminals.select("node").distinct().join(both.select("node").distinct(), "node", "left_semi").select(
        "node", F.lit(0.0).alias("dist"), F.col("node").alias("terminal"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("fresh")))
    best = F.min(F.struct("dist", "terminal", "parent", "fresh"))
    rounds = 0
    while True:
        if rounds == max_rounds:
            raise RuntimeError(f"distances still improve after {max_rounds} rounds")
        rounds += 1
        front = _by_rows(state.where("fresh").select("node", "dist", "terminal"))
        step = both.join(front, "node").groupBy(F.col("nbr").alias("node")).agg(
            F.min(F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("terminal"), F.col("node").alias("parent"), F.lit(True).alias("fresh"))).alias("b"))
        old = state.select("node", F.struct("dist", "terminal", "parent", F.lit(False).alias("fresh")).alias("o"))
        j = old.join(step, "node", "full_outer")
        take_new = F.col("o").isNull() | (F.col("b.dist") < F.col("o.dist"))
        state = cut_lineage(j.select("node", F.when(take_new, F.col("b")).otherwise(F.col("o")).alias("s")).select("node", "s.*"))
        if state.where("fresh").limit(1).count() == 0:
            break
    return state.drop("fresh")


def _spanning_tree(pairs: list[tuple]) -> list[tuple]:
    """Kruskal over the terminal graph; at most a few hundred rows."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    out = []
    for p in sorted(pairs, key=lambda t: (t[2], t[0], t[1])):
        a, b = find(p[0]), find(p[1])
        if a != b:
            root[a] = b
            out.append(p)
    return out


def steiner_tree(weights: DataFrame, terminals: DataFrame, max_terminals: int = 64) -> DataFrame:
    """(u, v, weight) of a subtree that joins the reachable terminals.

    Nodes are assigned to their cheapest terminal; edges between two cells give the cheapest link per terminal pair;
    a spanning tree over the terminals picks links; the chosen links are traced back through the parents.
    """
    spark = weights.sparkSession
    if terminals.limit(max_terminals + 1).count() > max_terminals:
        raise ValueError(f"more than {max_terminals} terminals")
    weights = cut_lineage(weights)
    near = nearest_terminal(weights, terminals)
    a = near.select(F.col("node").alias("u"), F.col("dist").alias("du"), F.col("terminal").alias("tu"))
    b = near.select(F.col("node").alias("v"), F.col("dist").alias("dv"), F.col("terminal").alias("tv"))
    cross = weights.join(_by_rows(a), "u").join(_by_rows(b), "v").where("tu <> tv")
    link = F.struct((F.col("du") + F.col("weight") + F.col("dv")).alias("cost"), F.col("u"), F.col("v"), F.col("weight"))
    pairs = cross.groupBy(F.least("tu", "tv").alias("t1"), F.greatest("tu", "tv").alias("t2")).agg(F.min(link).alias("l"))
    rows = [(r.t1, r.t2, r.l.cost, r.l.u, r.l.v, r.l.weight) for r in pairs.collect()]  # <= terminals^2 / 2
    chosen = [(p[3], p[4], float(p[5])) for p in _spanning_tree(rows)]
    tree = spark.createDataFrame(chosen, "u string, v string, weight double")
    front = cut_lineage(tree.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    steps = near.where("parent IS NOT NULL").join(_by_rows(near.select(F.col("node").alias("parent"), F.col("dist").alias("dp"))), "parent").select(
        "node", "parent", (F.col("dist") - F.col("dp")).alias("weight"))
    steps = cut_lineage(steps)
    while True:
        hop = cut_lineage(steps.join(F.broadcast(front), "node"))  # the front never exceeds twice the chosen links
        if hop.limit(1).count() == 0:
            break
        tree = tree.union(hop.select(F.least("node", "parent"), F.greatest("node", "parent"), "weight"))
        front = hop.select(F.col("parent").alias("node")).distinct()
    return cut_lineage(tree.distinct())


def steiner_summary(tree: DataFrame, terminals: DataFrame, prizes: DataFrame) -> DataFrame:
    """One row per tree node: role (terminal or connector), prize, degree in the tree."""
    t = terminals.select("node").distinct().withColumn("_t", F.lit(True))
    n = tree.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return n.join(t, "node", "left").join(prizes, "node", "left").select(
        "node", F.when(F.col("_t"), "terminal").otherwise("connector").alias("role"), F.coalesce("prize", F.lit(0.0)).alias("prize"), "degree")


def pick_terminals(prizes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """The n nodes with the largest prize among those that occur in the network."""
    known = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return prizes.join(known, "node", "left_semi").orderBy(F.col("prize").desc(), "node").limit(n)
