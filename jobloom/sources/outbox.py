"""A client's outbox: requests kept until the broker has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 32
#: Answers after which a request is tried again.
TRANSIENT = ("unavailable", "deadline_exceeded")


def first_writer_wins(records: DataFrame, order: list[str]) -> DataFrame:
    """One record for each key: the first put."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return records.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def next_batch(records: DataFrame, order: list[str], batch: int = BATCH) -> DataFrame:
    """The oldest pending records."""
    return records.where(F.col("state") == "pending").orderBy(*order).limit(batch)


def settle(records: DataFrame, answers: DataFrame) -> DataFrame:
    """State after the broker's answers (key, answer): sent, pending after a transient one, else failed."""
    a = F.col("answer")
    state = F.when(a.isNull() | a.isin(*TRANSIENT), "pending").when(a == "ok", "sent").otherwise("failed")
    return records.drop("state").join(answers, "key", "left").withColumn("state", state).drop("answer")
