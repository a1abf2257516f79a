"""What clients compute: bulk results, health, roll-ups of a fleet, log filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bulk_results(answers: DataFrame, stop_on_error: bool = False, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """Results by position: ``ok`` and ``error``; with ``stop_on_error`` what comes after the first error is ``skipped``.

    ``answers`` has a column ``error``, null where a request went through.
    """
    first = F.min(F.when(F.col("error").isNotNull(), F.col(pos))).over(Window.partitionBy(batch))
    out = answers.withColumn("skipped", F.coalesce(F.col(pos) > first, F.lit(False)) if stop_on_error else F.lit(False))
    return out.withColumns({"ok": F.col("error").isNull() & ~F.col("skipped"), "error": F.when(~F.col("skipped"), F.col("error"))})


def health(samples: DataFrame, now_ms: int, stale_ms: int = 30_000) -> DataFrame:
    """``live`` and ``ready`` of each client: seen lately; and connected, not draining."""
    live = F.col("last_seen") > now_ms - stale_ms
    return samples.withColumns({"live": live, "ready": live & F.col("connected") & ~F.col("draining")})


def fleet(clients: DataFrame, by: list[str]) -> DataFrame:
    """All of it connected, any of it draining, sums and the worst latency."""
    return clients.groupBy(*by).agg(F.every("connected").alias("all_connected"), F.some("draining").alias("any_draining"), F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.max("last_ms").alias("worst_ms"), F.min(F.col("connected").cast("int")).alias("connection_up"))


def log_lines(logs: DataFrame, needle: str, line: str = "line") -> DataFrame:
    """Log lines that hold a text, case included."""
    return logs.where(F.col(line).contains(needle))


def staleness(samples: DataFrame, now: Column, by: list[str]) -> DataFrame:
    """Age of the newest sample of each series."""
    return samples.groupBy(*by).agg((now - F.max("ts")).alias("age_ms"))
