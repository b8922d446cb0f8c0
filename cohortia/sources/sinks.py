"""Writers: Parquet caches, delimited tables, JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.sources.readers import path_exists


def write_cache(df: DataFrame, path: str, partition_by: Sequence[str] = (), force: bool = False) -> bool:
    """Write Parquet unless the path already holds a finished table; ``force`` overwrites. True when written."""
    if not force and path_exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return True


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet (resume by anti join)."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_sealed(labels: DataFrame, public_path: str, sealed_path: str) -> None:
    """Public and sealed label tables in separate places."""
    labels.where(~F.col("sealed")).drop("sealed").write.mode("overwrite").parquet(public_path)
    labels.where("sealed").drop("sealed").write.mode("overwrite").parquet(sealed_path)
