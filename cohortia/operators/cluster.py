"""PCA, k-means, agreement indices, silhouettes and bootstrap stability on sample vectors (sample_id, vec array<double>)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.operators.aggregates import contingency
from cohortia.operators.ordered import draw_order
from cohortia.operators.reshape import top_k_per_key
from cohortia.session import cut_lineage

DENSE_PCA_LIMIT = 4096  # up to here the feature covariance is one small driver matrix; beyond, a distributed SVD


def sample_vectors(expr: DataFrame, scale: bool = True) -> DataFrame:
    """Long table -> one centred (and unit-variance) vector per sample in feature-name order.

    A missing value is the feature mean, i.e. 0 after centring; constant features are 0. The feature list is a row of
    one array, so a vector is as long as the feature list and no longer.
    """
    st = expr.groupBy("feature").agg(F.avg("value").alias("m"), F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    z = expr.join(st, "feature").select("sample_id", "feature", ((F.col("value") - F.col("m")) / (F.col("s") if scale else F.lit(1.0))).alias("z"))
    names = st.agg(F.array_sort(F.collect_list("feature")).alias("_f"))
    per = z.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("_m"))
    return per.join(F.broadcast(names), on=F.lit(True)).select(
        "sample_id", F.transform("_f", lambda f: F.coalesce(F.try_element_at("_m", f), F.lit(0.0))).alias("vec"))


def _centred(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.stat import Summarizer
    v = vectors.withColumn("_v", array_to_vector("vec"))
    mean = v.agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mean"))
    return v.drop("_v").join(F.broadcast(mean), on=F.lit(True)).select(
        *[c for c in vectors.columns if c != "vec"], F.zip_with("vec", "_mean", lambda a, b: a - b).alias("vec"))


def pca_scores(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(sample_id, vec) of principal component scores, and the explained variance ratios.

    The sign of a component makes its largest loading positive, so scores are reproducible.
    """
    c = cut_lineage(_centred(vectors))
    d = c.select(F.size("vec")).first()[0]
    v = c.select("sample_id", array_to_vector("vec").alias("v"))
    if d <= DENSE_PCA_LIMIT:
        model = PCA(k=min(k, d), inputCol="v", outputCol="p").fit(v)
        load = model.pc.toArray()
        sign = np.sign(load[np.abs(load).argmax(axis=0), range(load.shape[1])])
        sc = model.transform(v).select("sample_id", vector_to_array("p").alias("p"))
        ratios = [float(x) for x in model.explainedVariance.toArray()]
    else:
        ix = cut_lineage(draw_order(v.select("sample_id"), [], 0, ["sample_id"]))
        rows = v.join(ix, "sample_id").select((F.col("rn") - 1).cast("long").alias("index"), F.col("v").alias("vector"))
        svd = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector")).computeSVD(min(k, d), computeU=True)
        load, s = svd.V.toArray(), svd.s.toArray()
        sign = np.sign(load[np.abs(load).argmax(axis=0), range(load.shape[1])])
        total = c.agg(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
        ratios = [float(x) for x in s * s / total]
        u = svd.U.rows.map(lambda r: (int(r.index), [float(a) for a in r.vector.toArray() * s])).toDF("index long, p array<double>")
        sc = u.join(ix, u["index"] == F.col("rn") - 1).select("sample_id", "p")
    flip = F.array(*[F.lit(float(x) or 1.0) for x in sign])
    return sc.select("sample_id", F.zip_with("p", flip, lambda a, b: a * b).alias("vec")), ratios


def kmeans(vectors: DataFrame, k: int, seed: int = 42, n_init: int = 3, max_iter: int = 50) -> DataFrame:
    """(sample_id, cluster) of the best of ``n_init`` runs by training cost; starts alternate between both seedings."""
    v = cut_lineage(vectors.select("sample_id", "vec")).select("sample_id", array_to_vector("vec").alias("features"))
    return _best_kmeans(v, k, seed, n_init, max_iter).transform(v).select("sample_id", F.col("prediction").alias("cluster"))


def _best_kmeans(v: DataFrame, k: int, seed: int, n_init: int = 3, max_iter: int = 50):
    best = None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + 1000 * i, maxIter=max_iter, tol=1e-9, initMode="random" if i % 2 else "k-means||", initSteps=5).fit(v)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    return best


# ---- agreement of two labelings -----------------------------------------------------------------------------------

def _table(df: DataFrame, a: str, b: str, by: Sequence[str]) -> tuple[DataFrame, str, str]:
    both = df.select(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    return cut_lineage(contingency(both, "_a", "_b", by)), "_a", "_b"


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """ARI from the contingency table; the table is what is shuffled, never pairs of samples."""
    c, a, b = _table(df, a, b, by)

    def pairs(keys):
        s = c.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
        return s.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("s"))
    on = list(by)
    p_ab, p_a, p_b = pairs([a, b]).withColumnRenamed("s", "sab"), pairs([a]).withColumnRenamed("s", "sa"), pairs([b]).withColumnRenamed("s", "sb")
    n = c.groupBy(*by).agg(F.sum("n").alias("n"))
    j = n
    for t in (p_ab, p_a, p_b):
        j = j.join(t, on) if on else j.join(F.broadcast(t), on=F.lit(True))
    exp = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("sa") + F.col("sb")) / 2.0
    return j.select(*by, "n", F.when(top == exp, 1.0).otherwise((F.col("sab") - exp) / (top - exp)).alias("ari"))


def normalised_mutual_info(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """NMI with the arithmetic mean of entropies, from the contingency table."""
    c, a, b = _table(df, a, b, by)

    def ent(keys, out):
        s = c.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
        return s.groupBy(*by).agg(F.sum(F.col("n") * F.log("n")).alias(out), F.sum("n").alias("n_all"))
    on = list(by)
    j = ent([a, b], "lab")
    for t in (ent([a], "la").drop("n_all"), ent([b], "lb").drop("n_all")):
        j = j.join(t, on) if on else j.join(F.broadcast(t), on=F.lit(True))
    n = F.col("n_all").cast("double")
    ha, hb, hab = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n, F.log(n) - F.col("lab") / n
    mean = (ha + hb) / 2
    return j.select(*by, F.col("n_all").alias("n"), F.when(mean < 1e-12, 1.0).otherwise(F.greatest(ha + hb - hab, F.lit(0.0)) / mean).alias("nmi"))


def best_scheme(pred: DataFrame, schemes: DataFrame, min_overlap: int = 10) -> DataFrame:
    """Best NMI over reference schemes. pred(sample_id, label), schemes(sample_id, scheme, truth)."""
    j = pred.join(schemes.where("truth IS NOT NULL"), "sample_id")
    t = normalised_mutual_info(j, "label", "truth", ["scheme"]).where(F.col("n") >= min_overlap)
    return t.agg(F.max_by("scheme", F.struct("nmi", "scheme")).alias("best_scheme"), F.max("nmi").alias("best_nmi"), F.count(F.lit(1)).alias("n_schemes"))


# ---- silhouettes --------------------------------------------------------------------------------------------------

ONCE = "CASE WHEN (blk + blk_j) % 2 = 0 THEN blk <= blk_j ELSE blk > blk_j END"  # of (i, j) and (j, i) one, in turns, so that every block has as many
TILE = 128  # rows of a block of pairs that are worked on at a time
RIGHT_BLOCKS = 64  # blocks that a task of all pairs streams past its own; the more, the fewer partial results


def _blocks(df: DataFrame, cols: Sequence[str], block: int) -> tuple[DataFrame, int]:
    """Rows packed into blocks of about ``block`` samples, (blk, one array per column of ``cols``, mat), stored once; and their number."""
    x = cut_lineage(df.select(*cols, "vec"))
    nb = max(1, -(-x.count() // block))
    kinds = [T.StructField(c, T.ArrayType(x.schema[c].dataType)) for c in cols]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        one = {"blk": pdf["_blk"].iloc[0], **{c: list(pdf[c]) for c in cols}, "mat": np.vstack(pdf["vec"].to_numpy()).astype(float).tobytes()}
        return pd.DataFrame([one])

    schema = T.StructType([T.StructField("blk", T.IntegerType()), *kinds, T.StructField("mat", T.BinaryType())])
    x = x.withColumn("_blk", F.pmod(F.xxhash64("sample_id"), F.lit(nb)).cast("int"))
    return cut_lineage(x.groupBy("_blk").applyInPandas(pack, schema)), nb


def _all_pairs(blocks: DataFrame, nb: int, start, step, finish, schema: T.StructType) -> DataFrame:
    """Every block against every block: ``start`` a block, ``step`` it past each other one, ``finish`` into rows.

    Blocks are read from the stored table by every task that needs them, so all pairs move nothing; what is shuffled is a
    block's result for each ``RIGHT_BLOCKS`` others. Memory per task is that many blocks.
    """
    spark = blocks.sparkSession
    n = min(nb, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns]).repartition(n)
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns]).coalesce(-(-nb // RIGHT_BLOCKS))

    def run(batches):
        at, state = None, None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["a_blk"] != at:
                    if state is not None:
                        yield finish(state)
                    at, state = row["a_blk"], start({c[2:]: v for c, v in row.items() if c[:2] == "a_"})
                step(state, {c[2:]: v for c, v in row.items() if c[:2] == "b_"})
        if state is not None:
            yield finish(state)
    return left.join(right.hint("shuffle_replicate_nl"), F.lit(True)).mapInPandas(run, schema)


def _matrix(block: dict) -> np.ndarray:
    return np.frombuffer(block["mat"]).reshape(len(block["sample_id"]), -1)


def _squared(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * (u @ v.T), 0.0)


def grid_side(spark) -> int:
    """Parts of each side when every pair of blocks is computed once: a few tasks for each core, and as few partial results."""
    return int(np.ceil(np.sqrt(2.5 * spark.sparkContext.defaultParallelism)))


def squared_tiles(x: np.ndarray, y: np.ndarray, work: dict, diagonal: float | None = None):
    """(first row, rows, spare rows) of all squared distances of x and y, ``TILE`` rows at a time; ``diagonal`` replaces those of a block to itself.

    ``work`` keeps the arrays, which are used again: new pages for every block would cost as much as the block.
    """
    u = np.hstack([x, (x * x).sum(1)[:, None], np.ones((len(x), 1))])
    v = np.hstack([-2.0 * y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]]).T
    if len(y) not in work:
        work.clear()
        work[len(y)] = np.empty((2, TILE, len(y)))
    both = work[len(y)]
    for i in range(0, len(x), TILE):
        m = min(TILE, len(x) - i)
        w = both[0, :m]
        np.dot(u[i:i + m], v, out=w)
        np.maximum(w, 0.0, out=w)
        if diagonal is not None:
            w[np.arange(m), np.arange(i, i + m)] = diagonal
        yield i, w, both[1, :m]


def _same(a: dict, b: dict) -> np.ndarray | None:
    """Pairs of a sample with itself; a sample is in one block only."""
    return a["sample_id"][:, None] == b["sample_id"][None, :] if a["blk"] == b["blk"] else None


def silhouette_samples(df: DataFrame, block: int = 2048) -> DataFrame:
    """Exact Euclidean silhouette per sample: (sample_id, label, s). df(sample_id, label, vec).

    Samples are cut into blocks; every pair of blocks is one task-sized NumPy product. A block adds up, per sample and label,
    the distances to all that passes it, and only these sums are shuffled. No pair of samples is ever a row.
    """
    x, nb = _blocks(df.withColumn("label", F.col("label").cast("string")), ["sample_id", "label"], block)

    def start(a: dict) -> dict:
        return {"a": a, "u": _matrix(a), "total": {}, "n": {}}

    def step(st: dict, b: dict) -> None:
        d = np.sqrt(_squared(st["u"], _matrix(b)))
        same = _same(st["a"], b)
        if same is not None:
            d[same] = 0.0
        codes, names = pd.factorize(b["label"], use_na_sentinel=True)
        hot = (codes[:, None] == np.arange(len(names))[None, :]).astype(float)
        total, n = d @ hot, hot.sum(0)[None, :] - (same @ hot if same is not None else 0.0)
        for i, lab in enumerate(names):
            st["total"][lab] = st["total"].get(lab, 0.0) + total[:, i]
            st["n"][lab] = st["n"].get(lab, 0) + np.broadcast_to(n[:, i], len(d))

    def finish(st: dict) -> pd.DataFrame:
        a, out = st["a"], []
        for lab, total in st["total"].items():
            out.append(pd.DataFrame({"sample_id": a["sample_id"], "label": a["label"], "other": lab, "total": total, "n": np.rint(st["n"][lab]).astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["sample_id", "label", "other", "total", "n"])

    schema = T.StructType([df.schema["sample_id"], *[T.StructField(c, t) for c, t in (("label", T.StringType()), ("other", T.StringType()), ("total", T.DoubleType()), ("n", T.LongType()))]])
    part = _all_pairs(x, nb, start, step, finish, schema)
    m = part.groupBy("sample_id", "label", "other").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    s = m.groupBy("sample_id", "label").agg(F.max(F.when(F.col("other") == F.col("label"), F.col("mean"))).alias("a"),
                                            F.min(F.when(F.col("other") != F.col("label"), F.col("mean"))).alias("b"))
    return s.select("sample_id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))).alias("s"))


def nearest_neighbours(vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(sample_id, neighbour, dist): the k nearest by squared distance, ties by the smaller neighbour. A block keeps its k best
    per sample over all that passes it; the best of those are kept by a ranked limit per sample.

    Products of blocks only choose candidates, with room for their rounding; distances come from the differences themselves, so
    that copies are at exactly 0.
    """
    x, nb = _blocks(vectors, ["sample_id"], block)

    def start(a: dict) -> dict:
        u = _matrix(a)
        return {"a": a, "u": u, "cut": np.full(len(u), np.inf), "row": np.empty(0, np.int64), "id": None, "d": np.empty(0)}

    def step(st: dict, b: dict) -> None:
        u, v = st["u"], _matrix(b)
        d = _squared(u, v)
        same = _same(st["a"], b)
        if same is not None:
            d[same] = np.inf
        m = min(k, d.shape[1])
        cut = st["cut"]
        if np.isinf(cut).any():
            cut = np.minimum(cut, np.partition(d, m - 1, axis=1)[:, m - 1])
        room = 1e-12 * ((u * u).sum(1) + (v * v).sum(1).max())
        r, c = np.nonzero((d <= (cut + room)[:, None]) & np.isfinite(d))
        near = np.empty(len(r))
        for i in range(0, len(r), 100_000):
            e = u[r[i:i + 100_000]] - v[c[i:i + 100_000]]
            near[i:i + 100_000] = (e * e).sum(1)
        ids = np.asarray(b["sample_id"].tolist())[c]
        row, d = np.concatenate([st["row"], r]), np.concatenate([st["d"], near])
        ids = ids if st["id"] is None else np.concatenate([st["id"], ids])
        o = np.lexsort((ids, d, row))
        row, d, ids = row[o], d[o], ids[o]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        st["row"], st["d"], st["id"] = row[keep], d[keep], ids[keep]
        last = rank == k - 1
        st["cut"][row[last]] = d[last]

    def finish(st: dict) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": st["a"]["sample_id"][st["row"]], "neighbour": st["id"], "dist": st["d"]})

    ids = vectors.schema["sample_id"].dataType
    schema = T.StructType([T.StructField("sample_id", ids), T.StructField("neighbour", ids), T.StructField("dist", T.DoubleType())])
    return top_k_per_key(_all_pairs(x, nb, start, step, finish, schema), ["sample_id"], [F.col("dist"), F.col("neighbour")], k)


def silhouette(df: DataFrame) -> DataFrame:
    return silhouette_samples(df).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouettes(df: DataFrame, sizes: Sequence[int], block: int | None = None) -> DataFrame:
    """Mean exact Euclidean silhouettes of several labelings of the same samples: (ix, silhouette, n).

    df(sample_id, labels array<int>, vec): labels[ix] is 0 ... sizes[ix] - 1. A distance is computed once, for both of its samples
    and for all labelings; a block's sums for each label are shuffled once for each part of the grid of block pairs.
    """
    x = cut_lineage(df.select("sample_id", "labels", "vec"))
    n = x.count()
    nb = -(-n // (block or min(max(n // 32, 512), 4096)))
    first, kinds = np.cumsum([0, *sizes]), len(sizes)
    count = np.zeros(first[-1])
    for ix, label, c in x.select(F.posexplode("labels")).groupBy("pos", "col").count().collect():
        count[first[ix] + label] = c

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lab = np.vstack(pdf["labels"].to_numpy()).astype(np.int32)
        return pd.DataFrame([(pdf["blk"].iloc[0], lab.tobytes(), np.vstack(pdf["vec"].to_numpy()).astype(float).tobytes())], columns=["blk", "lab", "mat"])
    x = x.withColumn("blk", F.pmod(F.xxhash64("sample_id"), F.lit(nb)).cast("int"))
    x = cut_lineage(x.groupBy("blk").applyInPandas(pack, "blk int, lab binary, mat binary"))

    def hot(lab: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(lab, np.int32).reshape(-1, kinds) + first[:-1]
        one = np.zeros((len(at), len(count)))
        one[np.arange(len(at))[:, None], at] = 1.0
        return at, one

    def run(batches):
        blk, work, other = None, {}, {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.blk != blk:
                    if blk is not None:
                        yield pd.DataFrame([(blk, acc.tobytes())], columns=["blk", "part"])
                    blk, one = row.blk, hot(row.lab)[1]
                    u, acc = _matrix_of(row.mat, len(one)), np.zeros(one.shape)
                one_j, same = hot(row.lab_j)[1], row.blk == row.blk_j
                back = None if same else other.setdefault(row.blk_j, np.zeros(one_j.shape))
                for i, w, _ in squared_tiles(u, _matrix_of(row.mat_j, len(one_j)), work, 0.0 if same else None):
                    np.sqrt(w, out=w)
                    acc[i:i + len(w)] += w @ one_j
                    if back is not None:
                        back += w.T @ one[i:i + len(w)]
        if blk is not None:
            yield pd.DataFrame([(blk, acc.tobytes())], columns=["blk", "part"])
        for b, part in other.items():
            yield pd.DataFrame([(b, part.tobytes())], columns=["blk", "part"])

    def score(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        at, one = hot(own["lab"].iloc[0])
        total, rows, out = sum(np.frombuffer(p).reshape(one.shape) for p in got["part"]), np.arange(len(at)), []
        for ix in range(kinds):
            c, mine = count[first[ix]:first[ix + 1]], at[:, ix] - first[ix]
            mean = np.where(c > 0, total[:, first[ix]:first[ix + 1]] / np.maximum(c, 1), np.inf)
            a = total[rows, at[:, ix]] / np.maximum(c[mine] - 1, 1)
            mean[rows, mine] = np.inf
            b = mean.min(axis=1)
            most = np.maximum(a, b)
            good = (c[mine] > 1) & np.isfinite(b) & (most > 0)
            s = np.where(good, (np.where(good, b, 0.0) - a) / np.where(good, most, 1.0), 0.0)
            out.append((ix, s.sum(), len(s)))
        return pd.DataFrame(out, columns=["ix", "s", "n"])
    side = grid_side(x.sparkSession)
    pairs = x.coalesce(side).join(x.select(*[F.col(c).alias(f"{c}_j") for c in x.columns]).coalesce(side).hint("shuffle_replicate_nl"), F.expr(ONCE))
    part = pairs.mapInPandas(run, "blk int, part binary")
    s = x.select("blk", "lab").groupBy("blk").cogroup(part.groupBy("blk")).applyInPandas(score, "ix int, s double, n long")
    return s.groupBy("ix").agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("n").alias("n"))


def _matrix_of(mat: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(mat).reshape(rows, -1)


def silhouette_squared(df: DataFrame) -> float:
    """Silhouette on squared distances: one linear pass, for sizes where n x n is out of reach (a different number)."""
    ix = StringIndexer(inputCol="label", outputCol="prediction").fit(df)
    p = ix.transform(df).select(array_to_vector("vec").alias("features"), F.col("prediction").cast("int").alias("prediction"))
    return ClusteringEvaluator(predictionCol="prediction").evaluate(p)


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """Calinski-Harabasz index and the smallest cluster. df(label, vec); sums per (label, dimension) only."""
    e = df.select("label", F.posexplode("vec").alias("dim", "v"))
    g = e.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("ss"))
    t = g.groupBy("dim").agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    j = g.join(t, "dim")
    b = j.agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"), F.sum("ss").alias("ssw"),
              F.max("n_all").alias("n_all"), F.countDistinct("label").alias("k"), F.min("n").alias("min_size"))
    return b.select((F.col("ssb") / (F.col("k") - 1) / (F.col("ssw") / (F.col("n_all") - F.col("k")))).alias("ch"), "k", "min_size")


def k_scan(vectors: DataFrame, ks: Sequence[int], seed: int = 42, min_size: int = 8) -> DataFrame:
    """Silhouette, Calinski-Harabasz and smallest cluster for each k; k qualifies when its clusters are large enough."""
    v = cut_lineage(cut_lineage(vectors).select("sample_id", "vec"))
    x = v.withColumn("features", array_to_vector("vec"))
    models = [_best_kmeans(x.select("sample_id", "features"), k, seed) for k in ks]
    for i, m in enumerate(models):
        x = m.setPredictionCol(f"_{i}").transform(x)
    x = cut_lineage(x.select("sample_id", F.array(*[F.col(f"_{i}") for i in range(len(models))]).alias("labels"), "vec"))
    s = cut_lineage(silhouettes(x, ks))
    out = None
    for i, k in enumerate(ks):
        ch = calinski_harabasz(x.select(F.get("labels", F.lit(i)).alias("label"), "vec")).drop("k")
        row = s.where(F.col("ix") == i).join(F.broadcast(ch), on=F.lit(True)).select(
            F.lit(k).alias("k"), "silhouette", "ch", "min_size", (F.col("min_size") >= min_size).alias("eligible"))
        out = row if out is None else out.union(row)
    return out


# ---- bootstrap stability ------------------------------------------------------------------------------------------

def replicate_kmeans(vectors: DataFrame, members: DataFrame, k: int, reps: int, n_init: int = 3, max_iter: int = 20, tol: float = 1e-6) -> DataFrame:
    """k-means of every replicate at once: (rep, sample_id, cluster). members(rep, sample_id, rn) with rn a random order.

    Vectors carry the list of replicates they belong to. A Lloyd step is one pass in which each partition adds up, per
    run and cluster, counts and vector sums; only these (runs x k rows) reach the driver, where the centres live.
    """
    x = cut_lineage(vectors.join(members.groupBy("sample_id").agg(F.collect_list("rep").alias("reps")), "sample_id"))
    first = members.where(F.col("rn") <= k * n_init).join(vectors, "sample_id").select("rep", "rn", "vec").collect()
    d = len(first[0]["vec"])
    if reps * n_init * k * d > 20_000_000:
        raise ValueError("centres of all replicates do not fit the driver; use fewer replicates per call")
    centres = np.zeros((reps, n_init, k, d))
    for r in first:
        i = r["rn"] - 1
        centres[r["rep"], i // k, i % k] = r["vec"]

    def assign(v, c):
        d2 = (c * c).sum(1)[None, :] - 2.0 * (v @ c.T)
        lab = d2.argmin(1)
        return lab, d2[np.arange(len(v)), lab] + (v * v).sum(1)

    def step(batches, c=None):
        cnt, sums, cost = np.zeros((reps, n_init, k)), np.zeros((reps, n_init, k, d)), np.zeros((reps, n_init))
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.vstack(pdf["vec"].to_numpy())
            own = [np.asarray(z) for z in pdf["reps"]]
            rows = np.repeat(np.arange(len(own)), [len(z) for z in own])
            rr = np.concatenate(own)
            for rep in np.unique(rr):
                w = v[rows[rr == rep]]
                for i in range(n_init):
                    lab, dd = assign(w, c[rep, i])
                    cnt[rep, i] += np.bincount(lab, minlength=k)
                    np.add.at(sums[rep, i], lab, w)
                    cost[rep, i] += dd.sum()
        r, i, j = np.nonzero(cnt)
        if not len(r):  # a split of a file may hold no rows, and an empty column has no list type
            return
        yield pd.DataFrame({"rep": r, "ini": i, "cl": j, "n": cnt[r, i, j], "s": list(sums[r, i, j]), "cost": 0.0})
        r, i = np.nonzero(cnt.sum(2))  # a run's cost is a row of its own: no partition need hold all clusters
        yield pd.DataFrame({"rep": r, "ini": i, "cl": -1, "n": 0.0, "s": [[0.0] * d] * len(r), "cost": cost[r, i]})

    schema = "rep long, ini long, cl long, n double, s array<double>, cost double"
    add = F.aggregate(F.collect_list("s"), F.array_repeat(F.lit(0.0), d), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    for _ in range(max_iter):
        cur = centres.copy()
        got = x.mapInPandas(lambda b, cur=cur: step(b, cur), schema).groupBy("rep", "ini", "cl").agg(F.sum("n").alias("n"), add.alias("s"), F.sum("cost").alias("cost")).collect()
        cost = np.zeros((reps, n_init))
        for r in got:
            if r["cl"] < 0:
                cost[r["rep"], r["ini"]] = r["cost"]
            else:
                centres[r["rep"], r["ini"], r["cl"]] = np.asarray(r["s"]) / r["n"]
        if np.abs(centres - cur).max() < tol:
            break
    best = centres[np.arange(reps), cost.argmin(1)]

    def label(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.vstack(pdf["vec"].to_numpy())
            at = np.repeat(np.arange(len(pdf)), pdf["reps"].map(len))
            rr = np.concatenate(pdf["reps"].to_numpy())
            lab = np.empty(len(rr), np.int32)
            for rep in np.unique(rr):
                mine = rr == rep
                lab[mine] = assign(v[at[mine]], best[rep])[0]
            yield pd.DataFrame({"rep": rr.astype(np.int32), "sample_id": pdf["sample_id"].to_numpy()[at], "cluster": lab})

    out = T.StructType([T.StructField("rep", T.IntegerType()), x.schema["sample_id"], T.StructField("cluster", T.IntegerType())])
    return x.mapInPandas(label, out)


def bootstrap_stability(vectors: DataFrame, grp: DataFrame, reps: int = 100, seed: int = 42, fraction: float = 0.8) -> DataFrame:
    """Re-cluster random 80% subsamples and compare with the given labels: one ARI per replicate."""
    v = cut_lineage(vectors.join(grp, "sample_id"))
    k = v.select("label").distinct().count()
    n = v.count()
    all_ = v.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    members = cut_lineage(draw_order(all_, ["rep"], seed, ["sample_id"]).where(F.col("rn") <= int(fraction * n)))
    cl = replicate_kmeans(v.select("sample_id", "vec"), members, k, reps)
    return adjusted_rand(cl.join(v.select("sample_id", "label"), "sample_id"), "label", "cluster", ["rep"])


def pole_groups(expr: DataFrame, n_top: int, n_pcs: int, seed: int = 42) -> DataFrame:
    """(sample_id, label): two clusters of the most variable features, A the one with the higher mean first component."""
    from cohortia.operators.reshape import top_variable
    sc, _ = pca_scores(sample_vectors(top_variable(cut_lineage(expr), n_top, True)), n_pcs)
    sc = cut_lineage(sc)
    c = cut_lineage(kmeans(sc, 2, seed).join(sc, "sample_id"))
    m = c.groupBy("cluster").agg(F.avg(F.element_at("vec", 1)).alias("m")).agg(F.max_by("cluster", "m").alias("top"))
    return c.join(F.broadcast(m), on=F.lit(True)).select("sample_id", F.when(F.col("cluster") == F.col("top"), "A").otherwise("B").alias("label"))


def recluster_concordance(expr: DataFrame, grp: DataFrame, seed: int = 42) -> DataFrame:
    """ARI between given labels and a k-means of another modality."""
    k = grp.select("label").distinct().count()
    cl = kmeans(sample_vectors(expr), k, seed, n_init=5)
    return adjusted_rand(cl.join(grp, "sample_id"), "label", "cluster")


def modality_eligibility(expr: DataFrame, n_cohort: int, min_coverage: float = 0.5, min_features: int = 100, min_pc1: float = 0.10) -> DataFrame:
    """Coverage, non-constant features and first-component variance of a modality, with the verdict."""
    e = cut_lineage(expr)
    cov = e.where("value IS NOT NULL").select("sample_id").distinct().agg((F.count(F.lit(1)) / n_cohort).alias("coverage"))
    feats = e.groupBy("feature").agg(F.stddev("value").alias("s")).agg(F.count_if(F.col("s") > 0).alias("n_features"))
    _, ratios = pca_scores(sample_vectors(e), 1)
    return cov.join(F.broadcast(feats), on=F.lit(True)).withColumn("pc1_share", F.lit(ratios[0])).withColumn(
        "eligible", (F.col("coverage") >= min_coverage) & (F.col("n_features") >= min_features) & (F.col("pc1_share") > min_pc1))


def axis_alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Quartile NMI and Spearman of two modalities' axis scores. a, b(sample_id, score)."""
    from cohortia.operators.ordered import quantile_bins
    from cohortia.operators.stats import spearman
    j = cut_lineage(a.select("sample_id", F.col("score").alias("x")).join(b.select("sample_id", F.col("score").alias("y")), "sample_id"))
    q = quantile_bins(quantile_bins(j, [], "x", 4, "qx"), [], "y", 4, "qy")
    return normalised_mutual_info(q, "qx", "qy").join(F.broadcast(spearman(j, [], "x", "y").drop("n")), on=F.lit(True))
