"""Rates, increases, quantiles, slopes and alerts over metric samples.

Samples are (labels..., ts in ms, value). A counter that falls has restarted, and
counts from 0. Rates are increases in the window over the window's seconds; there is no
extrapolation to the window's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(samples: DataFrame, by: list[str]) -> DataFrame:
    """``delta`` of a counter since the sample before; null for a series' first sample."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("ts"))
    return samples.withColumn("delta", F.when(before.isNull(), None).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def increase(samples: DataFrame, by: list[str], window_ms: int) -> DataFrame:
    """``increase`` over (ts - window, ts] at every sample."""
    w = Window.partitionBy(*by).orderBy("ts").rangeBetween(-window_ms + 1, 0)
    return deltas(samples, by).withColumn("increase", F.coalesce(F.sum("delta").over(w), F.lit(0.0))).drop("delta")


def rate(samples: DataFrame, by: list[str], window_ms: int) -> DataFrame:
    return increase(samples, by, window_ms).withColumn("rate", F.col("increase") / (window_ms / 1000.0)).drop("increase")


def failure_ratio(samples: DataFrame, window_ms: int, name: str = "name", event: str = "event") -> DataFrame:
    """rate(failed) over rate(completed or failed), the denominator 0.001 at least, per name and time."""
    r = rate(samples, [name, event], window_ms).groupBy(name, "ts").agg(F.coalesce(F.sum(F.when(F.col(event) == "failed", F.col("rate"))), F.lit(0.0)).alias("f"), F.coalesce(F.sum(F.when(F.col(event).isin("completed", "failed"), F.col("rate"))), F.lit(0.0)).alias("d"))
    return r.select(name, "ts", (F.col("f") / F.greatest("d", F.lit(0.001))).alias("failure_ratio"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """The quantile of cumulative buckets (by, le, n; le null: all), linear within its bucket.

    In the last bucket it is the largest bound; without observations it is null.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.coalesce("le", F.lit(2**62)).alias("le"), "n")))  # one per bound
    g = buckets.groupBy(*by).agg(cells.alias("c"))
    g = g.withColumn("_total", F.element_at("c", -1)["n"])
    g = g.withColumn("_i", F.size(F.filter("c", lambda x: x["n"] < q * F.col("_total"))))
    at, below = F.get("c", F.col("_i")), F.get("c", F.col("_i") - 1)
    lo_le, lo_n = F.coalesce(below["le"], F.lit(0)), F.coalesce(below["n"], F.lit(0))
    last = F.get("c", F.size("c") - 2)["le"].cast("double")
    inside = lo_le + (at["le"] - lo_le) * F.try_divide(q * F.col("_total") - lo_n, at["n"] - lo_n)
    value = F.when(F.col("_total") == 0, None).when(F.col("_i") >= F.size("c") - 1, last).otherwise(inside)
    return g.select(*by, value.cast("double").alias("quantile"))


def deriv(samples: DataFrame, by: list[str], window_ms: int) -> DataFrame:
    """Least-squares slope of a gauge, per second, over (ts - window, ts]."""
    w = Window.partitionBy(*by).orderBy("ts").rangeBetween(-window_ms + 1, 0)
    return samples.withColumn("deriv", F.regr_slope("value", F.col("ts") / 1000.0).over(w))


def alert(evaluations: DataFrame, holds: Column, for_ms: int | Column, by: list[str]) -> DataFrame:
    """``firing``: the predicate has held without a break for ``for_ms`` up to this evaluation."""
    w = Window.partitionBy(*by).orderBy("ts")
    e = evaluations.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    e = e.withColumn("_breaks", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w))
    since = F.min(F.when(F.col("_holds"), F.col("ts"))).over(Window.partitionBy(*by, "_breaks"))
    return e.withColumn("firing", F.col("_holds") & (F.col("ts") - since >= for_ms)).drop("_holds", "_breaks")


#: How old a pressure sample may be, and the shipped rules' thresholds and durations.
SAMPLE_AGE_S = 30
DUE_AGE_S, GROWTH_PER_S = 60, 1
MINUTE_MS = 60_000
RULES_FOR_MS = {"sample_stale": MINUTE_MS, "due_aging": 5 * MINUTE_MS, "backlog_growing": 10 * MINUTE_MS, "expired_claims": 2 * MINUTE_MS, "recovery_errors": 0}


def pressure_alerts(evaluations: DataFrame, by: list[str]) -> DataFrame:
    """(by, ts, alert) of the alerts that fire.

    ``evaluations`` has, by labels and ``ts``: ``sample_ts`` of the newest pressure sample,
    ``oldest_due_age_s``, ``due``, ``expired_leases`` and the counter ``recovery_errors``. But
    for the first and the last, a rule holds only while the sample is fresh.
    """
    age = F.col("ts") / 1000 - F.col("sample_ts") / 1000
    is_fresh = age < SAMPLE_AGE_S
    e = deriv(evaluations.withColumn("value", F.col("due").cast("double")), by, 10 * MINUTE_MS)
    e = increase(e.withColumn("value", F.col("recovery_errors").cast("double")), by, 5 * MINUTE_MS)
    holds = {
        "sample_stale": age > SAMPLE_AGE_S,
        "due_aging": (F.col("oldest_due_age_s") > DUE_AGE_S) & is_fresh,
        "backlog_growing": (F.col("deriv") > GROWTH_PER_S) & is_fresh,
        "expired_claims": (F.col("expired_leases") > 0) & is_fresh,
        "recovery_errors": F.col("increase") > 0,
    }
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("alert"), F.lit(RULES_FOR_MS[n]).alias("for_ms"), h.alias("holds")) for n, h in holds.items())))
    rows = e.select(*by, "ts", cells.alias("c")).select(*by, "ts", "c.*")
    return alert(rows, F.col("holds"), F.col("for_ms"), [*by, "alert"]).where("firing").select(*by, "ts", "alert")


def fresh(evaluations: DataFrame, samples: DataFrame, by: list[str], max_age_ms: int) -> DataFrame:
    """Evaluations whose labels have a sample no older than ``max_age_ms``."""
    s = samples.select(*by, F.col("ts").alias("_s"))
    e, s = evaluations.alias("e"), s.alias("s")
    cond = (F.col("s._s") <= F.col("e.ts")) & (F.col("s._s") > F.col("e.ts") - max_age_ms)
    for c in by:
        cond &= F.col(f"e.{c}") == F.col(f"s.{c}")
    return e.join(s, cond, "left_semi")


def overview(vectors: dict[str, DataFrame], name: str = "name") -> DataFrame:
    """Metric vectors (name, value) side by side, sorted by name."""
    out = None
    for metric, v in vectors.items():
        v = v.select(name, F.col("value").alias(metric))
        out = v if out is None else out.join(v, name, "full_outer")
    return out.orderBy(name)
