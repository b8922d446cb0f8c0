"""Session helpers: lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) gets a folder of its own; on a cluster the setting must be there,
    because a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    Used where a result feeds several branches or an iteration: the upstream work runs exactly once, the new plan is
    a plain scan with known size (so small tables are broadcast by Catalyst on their own), and a lost executor only
    costs re-reading files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def co_locate(df: DataFrame, cols: list[str]) -> tuple[DataFrame, str]:
    """Write ``df`` as a table bucketed by ``cols`` in the shared checkpoint folder; returns it and its name.

    For iterations: aggregations, windows and joins on ``cols`` (or more) then run without moving the rows again.
    The caller drops the name when done.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    name = f"co_located_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/tables/{name}"
    df.repartition(n, *cols).write.bucketBy(n, *cols).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name


def spread(df: DataFrame, cols: list[str], rows: int, per_task: int = 4_000_000) -> DataFrame:
    """``df`` placed by ``cols`` in so many partitions that ``rows`` rows of later work are ``per_task`` for each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(n, -(-rows // per_task)), *cols)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True when ``df`` holds at most ``rows`` rows; reads no more than ``rows`` + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint only after the row bound was checked; otherwise leave the choice to AQE."""
    return F.broadcast(df) if small_enough(df, rows) else df


def distinct_values(df: DataFrame, col: str, limit: int) -> list:
    """Sorted distinct values of ``col`` for plan-time use (pivot labels, dummies).

    Refuses, rather than truncates, when there are more than ``limit``.
    """
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(found)
