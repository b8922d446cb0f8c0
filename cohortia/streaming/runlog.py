"""Streaming forms of two append-only operators: the run-log roll-up and the n-th event gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortia.operators.ordered import bucket_edges, running, with_bucket


def rollup_stream(log: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Tokens, time and errors per (window, arm). log(ts, arm, input_tokens, output_tokens, exec_time_s, is_error).

    Rows later than the watermark are dropped by Spark; a window is emitted once the watermark has passed it.
    """
    return (log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", window), "arm")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                 F.sum("exec_time_s").alias("exec_s"), F.count_if("is_error").alias("n_errors"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "arm", "n", "input_tokens", "output_tokens", "exec_s", "n_errors"))


def with_open_windows(closed: DataFrame, log: DataFrame, window: str = "1 hour") -> DataFrame:
    """A whole backfill: the windows a drained ``rollup_stream`` emitted, and those its watermark has not passed yet.

    ``closed`` is what ``drain`` returned, ``log`` the stored table the stream read. Open windows start no earlier than the last
    closed one, so only the end of the log is read again; what came too late for a closed window stays out, as in the stream.
    """
    last = closed.agg(F.max("start")).first()[0]
    rest = log if last is None else log.where(F.col("ts").cast("timestamp") >= F.lit(last).cast("timestamp"))
    still_open = rollup_stream(rest, window).join(closed.select("start", "arm"), ["start", "arm"], "left_anti")
    return closed.unionByName(still_open.select(closed.columns))


def gate_stream(log: DataFrame, is_event: str, n: int, lateness: str = "2 hours") -> DataFrame:
    """Rows of each key at or after its n-th qualifying event; the state per key is one counter.

    log(key string, ts, seq long, payload string, ...); ``is_event`` is a SQL condition. A key's rows are counted in
    arrival order of micro-batches, and in sequence order inside one: a key's rows of one trigger come in several Arrow
    batches and are sorted together, so the source's rate limit (``maxFilesPerTrigger``) bounds the memory of a hot key.
    """
    x = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select("key", "ts", "seq", "payload", F.expr(is_event).cast("int").alias("hit"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        total = seen + pdf["hit"].fillna(0).astype("int64").cumsum()
        state.update((int(total.iloc[-1]) if len(total) else seen,))
        out = pdf[total >= n]
        if len(out):
            yield out[["key", "ts", "seq", "payload"]]

    return x.groupBy("key").applyInPandasWithState(fold, "key string, ts timestamp, seq long, payload string", "seen long", "append", GroupStateTimeout.NoTimeout)


def gate_stored(log: DataFrame, is_event: str, n: int) -> DataFrame:
    """A whole backfill of the gate over a stored table: no key has to fit a task.

    The columns are those of ``gate_stream``. Rows are counted in sequence order over the whole table, null ones last; rows of one
    key with equal ``seq`` count together. A null key is a key.
    """
    x = log.select("key", "ts", "seq", "payload", F.coalesce(F.expr(is_event).cast("long"), F.lit(0)).alias("_hit"), F.col("key").isNull().alias("_no_key"),
                   F.coalesce("key", F.lit("")).alias("_key"), F.col("seq").isNull().alias("_no_seq"))
    edges = bucket_edges(x, "seq")
    x = with_bucket(x, "seq", edges).withColumn("_b", F.when(F.col("_no_seq"), len(edges) + 1).otherwise(F.col("_b")))
    seen = running(x, ["_no_key", "_key"], ["_no_seq", "seq"], {"_seen": ("sum", "_hit")})
    return seen.where(F.col("_seen") >= n).select("key", "ts", "seq", "payload")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into files and return them as a table (backfills and tests)."""
    path = f"{checkpoint}/{name}/out"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
         .option("checkpointLocation", f"{checkpoint}/{name}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
