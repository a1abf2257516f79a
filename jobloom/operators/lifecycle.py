"""Transitions of jobs: heartbeat, completion, failure, retry, recovery, dependencies.

A transition takes tables and gives tables; the clock and random draws are inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.scheduling import backoff_ms, jittered_ms, sat_add
from jobloom.sources.paths import cut

LEASE_MS = 30_000
EXPIRED = "Worker lease expired"


def expired(now_ms: int):
    """A lease has expired at its very end; an Active job without one has too."""
    return (F.col("state") == "Active") & (F.coalesce(F.col("lease_expires_at_ms"), F.lit(0)) <= now_ms)


def claim(jobs: DataFrame, claims: DataFrame, now_ms: int) -> DataFrame:
    """Jobs named in ``claims`` (id, worker_id) become Active with one attempt more and a lease."""
    c = claims.select("id", F.col("worker_id").alias("_w"))
    hit = F.col("_w").isNotNull()
    out = jobs.join(c, "id", "left")
    return out.withColumns({
        "state": F.when(hit, "Active").otherwise(F.col("state")),
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "worker_id": F.when(hit, F.col("_w")).otherwise(F.col("worker_id")),
        "lease_expires_at_ms": F.when(hit, F.lit(now_ms + LEASE_MS)).otherwise(F.col("lease_expires_at_ms")),
    }).select(*jobs.columns)


def current_claim(jobs: DataFrame, calls: DataFrame, now_ms: int) -> DataFrame:
    """``calls`` (id, worker_id, attempt) with ``held``: Active, same owner and attempt, lease not over."""
    j = jobs.select("id", F.col("state").alias("_s"), F.col("worker_id").alias("_w"), F.col("attempts").alias("_a"), F.coalesce("lease_expires_at_ms", F.lit(0)).alias("_l"))
    held = (F.col("_s") == "Active") & (F.col("_w") == F.col("worker_id")) & (F.col("_a") == F.greatest(F.col("attempt"), F.lit(1))) & (F.col("_l") > now_ms)
    return calls.join(j, "id", "left").withColumn("held", F.coalesce(held, F.lit(False))).withColumn("_lease", F.col("_l")).drop("_s", "_w", "_a", "_l")


def heartbeat(jobs: DataFrame, calls: DataFrame, now_ms: int, extend_ms: int = LEASE_MS) -> DataFrame:
    """The new lease of each held call; leases never get shorter."""
    return current_claim(jobs, calls, now_ms).where("held").select("id", F.greatest("_lease", F.lit(now_ms + extend_ms)).alias("lease_expires_at_ms"))


def acknowledgement(jobs: DataFrame, history: DataFrame, calls: DataFrame, now_ms: int) -> DataFrame:
    """``result`` of completion calls: ok, replay (already done by the same claim), conflict or not_found."""
    live = jobs.select("id", F.lit(True).alias("_live")).distinct()
    done = history.select("id", F.col("state").alias("_state"), F.col("worker_id").alias("_hw"), F.col("attempts").alias("_ha"))
    c = current_claim(jobs, calls, now_ms).drop("_lease").join(live, "id", "left").join(done, "id", "left")
    same = (F.col("_state") == "Completed") & (F.col("_hw") == F.col("worker_id")) & (F.greatest(F.col("_ha"), F.lit(1)) == F.greatest(F.col("attempt"), F.lit(1)))
    result = F.when(F.col("held"), "ok").when(F.coalesce(same, F.lit(False)), "replay").when(F.col("_live") | F.col("_state").isNotNull(), "conflict").otherwise("not_found")
    return c.withColumn("result", result).drop("_live", "_state", "_hw", "_ha", "held")


def retry(failed: DataFrame, now_ms: int, draw=None, non_retryable=None) -> DataFrame:
    """State after a failure: Waiting or Delayed with attempts left, else Failed.

    ``draw``: random column for the jitter (None: no jitter); ``non_retryable``: column.
    """
    delay = backoff_ms(F.col("retry_backoff_ms"), F.col("retry_backoff_max_ms"), F.col("attempts"))
    if draw is not None:
        delay = jittered_ms(delay, F.col("retry_jitter"), draw)
    again = F.col("attempts") < F.col("max_attempts")
    if non_retryable is not None:
        again &= ~non_retryable
    out = failed.withColumn("delay_ms", F.when(again, delay))
    state = F.when(again & (F.col("delay_ms") > 0), "Delayed").when(again, "Waiting").otherwise("Failed")
    return out.withColumns({"state": state, "available_at": F.when(again, sat_add(F.lit(now_ms), F.col("delay_ms"))).otherwise(F.col("available_at"))})


def recover_leases(jobs: DataFrame, now_ms: int, batch: int = 100) -> DataFrame:
    """Jobs whose lease is over, oldest first, as they go on: retried without jitter, or failed."""
    over = jobs.where(expired(now_ms)).orderBy(F.coalesce("lease_expires_at_ms", F.lit(0)), "id").limit(batch)
    return retry(over, now_ms).withColumn("last_error", F.lit(EXPIRED))


def archive(jobs: DataFrame, history: DataFrame, ended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move ``ended`` (id, state, finished_at, ...) from the live table to history."""
    left = jobs.join(ended.select("id"), "id", "left_anti")
    fields = [c for c in ended.columns if c != "id"]
    moved = jobs.drop(*fields).join(ended, "id")
    return left, history.unionByName(moved.select(*[c for c in history.columns if c in moved.columns]), allowMissingColumns=True)


def release_receipts(receipts: DataFrame, ended: DataFrame) -> DataFrame:
    """Receipts that a terminal state frees: those of ended jobs that ask for it."""
    gone = ended.select(F.col("id").alias("job_id"))
    freed = receipts.where("release_on_finish").join(gone, "job_id", "left_semi").select("queue_name", "idempotency_key")
    return receipts.join(freed, ["queue_name", "idempotency_key"], "left_anti")


def parent_release(jobs: DataFrame, completed: DataFrame, now_ms: int) -> DataFrame:
    """Parents of completed children: fewer pending, and released when none is left."""
    done = completed.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("done"))
    out = jobs.join(done, "id").withColumn("pending_children", (F.col("pending_children") - F.col("done")).cast("int"))
    free = (F.col("pending_children") <= 0) & (F.col("state") == "WaitingChildren")
    state = F.when(free & F.coalesce(F.col("available_at") > now_ms, F.lit(False)), "Delayed").when(free, "Waiting").otherwise(F.col("state"))
    return out.withColumn("state", state).drop("done")


def fail_parents(nodes: DataFrame, failed: DataFrame, max_height: int = 10) -> DataFrame:
    """(id, cause): parents that a failed child takes along.

    Goes up while the failing node is flagged; a parent fails once, from the failing
    descendant with the smallest id; the cause stays the job that failed first. An
    unflagged failure leaves its parent waiting.
    """
    tree = nodes.select("id", "parent_id", "state", "fail_parent_on_failure")
    parents = tree.select(F.col("id").alias("pid"), F.col("parent_id").alias("ppid"), F.col("fail_parent_on_failure").alias("pflag"), F.col("state").alias("pstate"))
    step = failed.join(tree.select("id", "parent_id", "fail_parent_on_failure"), "id").where("fail_parent_on_failure and parent_id is not null").select(F.col("parent_id").alias("pid"), F.col("id").alias("cause"))
    levels = []
    for _ in range(max_height):  # a tree is no higher
        hit = cut(step.join(parents, "pid").where(~F.col("pstate").isin("Completed", "Failed")).groupBy("pid", "ppid", "pflag").agg(F.min("cause").alias("cause")), "cascade")
        if levels and hit.isEmpty():
            break
        levels.append(hit.select(F.col("pid").alias("id"), "cause"))
        step = hit.where("pflag and ppid is not null").select(F.col("ppid").alias("pid"), "cause")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.min("cause").alias("cause")).withColumn("last_error", F.concat(F.lit("failParentOnFailure: child "), F.col("cause"), F.lit(" failed")))


def finish(jobs: DataFrame, history: DataFrame, receipts: DataFrame, calls: DataFrame, now_ms: int, draw=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, history, receipts) after a batch of completions and failures, as one transition.

    ``calls`` has id, worker_id, attempt, failed, retryable, error and result; those that
    hold no claim change nothing. A failure with attempts left goes back to the queue
    without owner and lease. What ends goes to history and frees its receipt; a
    completed child counts down its parent, a flagged failed one takes it along.
    """
    held = current_claim(jobs, calls, now_ms).where("held").select("id", "failed", "retryable", "error", F.col("result").alias("_result"))
    own = cut(jobs.join(held, "id"), "finish")
    bad = cut(retry(own.where("failed"), now_ms, draw, ~F.coalesce("retryable", F.lit(True))), "finish")
    again = bad.where("state <> 'Failed'").select("id", F.col("state").alias("_state"), F.col("available_at").alias("_at"), F.col("error").alias("_error"))
    lost = bad.where("state = 'Failed'")
    done = own.where("not failed")
    parents = cut(fail_parents(jobs, lost.select("id")), "finish")
    ended = done.select("id", F.lit("Completed").alias("state"), F.coalesce("error", "last_error").alias("last_error"), F.col("_result").alias("result"))
    ended = ended.unionByName(lost.select("id", F.lit("Failed").alias("state"), F.coalesce("error", "last_error").alias("last_error"), F.col("_result").alias("result")))
    ended = ended.unionByName(parents.select("id", F.lit("Failed").alias("state"), "last_error", F.lit(None).cast("binary").alias("result")))
    ended = cut(ended.withColumn("finished_at", F.lit(now_ms)), "finish")
    hit = F.col("_state").isNotNull()
    queued = jobs.join(again, "id", "left").withColumns({
        "state": F.coalesce("_state", "state"),
        "available_at": F.when(hit, F.col("_at")).otherwise(F.col("available_at")),
        "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
        "worker_id": F.when(~hit, F.col("worker_id")),
        "lease_expires_at_ms": F.when(~hit, F.col("lease_expires_at_ms")),
    }).select(*jobs.columns)
    live, past = archive(queued, history, ended)
    freed = parent_release(live, done, now_ms)
    live = live.join(freed.select("id"), "id", "left_anti").unionByName(freed)
    return live, past, release_receipts(receipts, ended)
