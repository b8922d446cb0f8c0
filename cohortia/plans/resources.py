"""Run-log roll-ups: tokens, time and cost. A field nobody reported stays null; it is never a zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise_episodes(usage: DataFrame, timing: DataFrame, wall: DataFrame) -> DataFrame:
    """Per episode. usage(episode, input_tokens, output_tokens, api_s, retries) and timing(episode, exec_time_s, is_error,
    timed_out) are event rows, reduced map-side; wall(episode, wall_s)."""
    z = F.lit(0)
    u = usage.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count("input_tokens").alias("n_turns_with_usage"), F.coalesce(F.sum("input_tokens"), z).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), z).alias("output_tokens"), F.sum("api_s").alias("api_s"), F.coalesce(F.sum("retries"), z).alias("api_retries"))
    t = timing.groupBy("episode").agg(F.count(F.lit(1)).alias("n_code_execs"), F.coalesce(F.sum("exec_time_s"), F.lit(0.0)).alias("exec_s"),
                                      F.count_if("timed_out").alias("n_exec_timeouts"), F.count_if("is_error").alias("n_exec_errors"))
    j = wall.join(u, "episode", "left").join(t, "episode", "left").na.fill(0, [
        "n_turns", "n_turns_with_usage", "input_tokens", "output_tokens", "api_retries", "n_code_execs", "n_exec_timeouts", "n_exec_errors"]).na.fill(0.0, ["exec_s"])
    measured, w = F.col("api_s").isNotNull(), F.col("wall_s")
    return j.select("*", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), (F.col("n_turns_with_usage") > 0).alias("tokens_reported"), measured.alias("api_time_measured"),
                    F.when(w > 0, 100 * F.col("exec_s") / w).alias("pct_exec"), F.when(measured & (w > 0), 100 * F.col("api_s") / w).alias("pct_api"),
                    F.when(measured & w.isNotNull(), F.greatest(F.lit(0.0), w - F.col("api_s") - F.col("exec_s"))).alias("unaccounted_s"),
                    F.when(F.col("n_turns_with_usage") > 0, F.col("output_tokens") / F.col("n_turns_with_usage")).alias("mean_output_tokens_per_turn"))


def by_arm(episodes: DataFrame, keys: Sequence[str] = ("run", "arm")) -> DataFrame:
    """Means per (run, arm), per run, and in total; episodes without token data are counted but left out of means."""
    ok = F.col("tokens_reported")

    def mean(c):
        return F.avg(F.when(ok, F.col(c)))
    return episodes.rollup(*keys).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_with_tokens"),
                                      mean("input_tokens").alias("mean_input"), mean("output_tokens").alias("mean_output"), mean("wall_s").alias("mean_wall"),
                                      F.sum("input_tokens").alias("total_input"), F.sum("output_tokens").alias("total_output"))


def cost(usage: DataFrame, prices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cost by price table (per million tokens), per episode and per 10M tokens; measured and estimated rows apart.

    usage(model, episode, input_tokens, output_tokens, text): without reported tokens they are estimated as characters / 4.
    """
    est = F.floor(F.length("text") / 4)
    known = F.col("input_tokens").isNotNull()
    x = usage.join(prices, "model").select(*by, "episode", known.alias("_m"), F.coalesce("input_tokens", est).alias("_i"), F.coalesce("output_tokens", F.lit(0)).alias("_o"), "in_price", "out_price")
    c = (F.col("_i") * F.col("in_price") + F.col("_o") * F.col("out_price")) / 1e6
    e = x.groupBy(*by, "episode").agg(F.sum("_i").alias("_i"), F.sum("_o").alias("_o"), F.sum(c).alias("_c"), F.sum(F.when(F.col("_m"), c).otherwise(0.0)).alias("_cm"))
    tok = F.sum(F.col("_i") + F.col("_o"))
    return e.groupBy(*by).agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("_i").alias("input_tokens"), F.sum("_o").alias("output_tokens"), F.sum("_c").alias("cost"),
                              F.sum("_cm").alias("measured_cost"), (F.sum("_c") - F.sum("_cm")).alias("estimated_cost"), F.avg("_c").alias("cost_per_episode"),
                              (F.sum("_c") / F.nullif(tok, F.lit(0)) * 1e7).alias("cost_per_10m"))
