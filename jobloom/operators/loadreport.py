"""Figures of a load test: percentiles, slopes and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOPE_LIMIT = 2.0
COMPLETION_SHARE = 0.98
SPREAD_LIMIT = 1.5


def percentiles(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Nearest-rank percentiles, mean and maximum."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").cast("double")
    return values.groupBy(*by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(column).alias("mean"), F.max(column).cast("double").alias("max"))


def slope(points: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares slope; 0 with fewer than two points or no spread of x."""
    return points.groupBy(*by).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))


def verdict(runs: DataFrame, slope_limit: float = SLOPE_LIMIT, share: float = COMPLETION_SHARE) -> DataFrame:
    """``sustained`` of each run: flat backlog, nearly all completed, no errors."""
    ok = (F.col("slope") <= slope_limit) & (F.col("completion_rate") >= share * F.col("enqueue_rate")) & (F.col("errors") == 0)
    return runs.withColumn("sustained", ok)


def summarize(runs: DataFrame, by: list[str], value: str = "completion_rate") -> DataFrame:
    """Repetitions of a cell: median, range, spread, and whether half of them or more were sustained."""
    out = runs.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("reps"), F.count(F.when(F.col("sustained"), 1)).alias("held"))
    spread = F.when(F.col("min") > 0, F.col("max") / F.col("min"))
    return out.withColumns({"spread": spread, "reproducible": F.coalesce(spread <= SPREAD_LIMIT, F.lit(False)), "sustained": 2 * F.col("held") >= F.col("reps")})


def bracket(cells: DataFrame, rate: str = "target_rate") -> DataFrame:
    """(low, high): the greatest sustained rate, and the first one above it that is not."""
    low = cells.agg(F.max(F.when(F.col("sustained"), F.col(rate))).alias("low")).first().low
    above = ~F.col("sustained") if low is None else ~F.col("sustained") & (F.col(rate) > low)
    return cells.agg(F.max(F.when(F.col("sustained"), F.col(rate))).alias("low"), F.min(F.when(above, F.col(rate))).alias("high"))
