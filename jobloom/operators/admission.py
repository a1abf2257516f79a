"""Admission of enqueue requests: validation, receipts, velocity, ancestry, quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.limits import SlidingBucket

MAX_KEY_BYTES = 256
BACKOFF_CAP_MS = 60_000
MAX_DEPTH = 10
BULK_LIMIT = 5000


def validate(requests: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Normalised requests with ``invalid``: the first rule broken, null if none.

    Columns that a request lacks count as not given. Defaults are filled in before
    anything compares requests.
    """
    have = set(requests.columns)
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    key, release = col("idempotency_key", ""), col("release_on_finish", False)
    delay, base, cap = col("delay_ms", 0), col("retry_backoff_ms", 0), col("retry_backoff_max_ms", 0)
    jitter, depth, attempts = col("retry_jitter", 0.0), col("execution_depth", 0), col("max_attempts", 0)
    filled = F.when(cap == 0, F.greatest(F.lit(BACKOFF_CAP_MS), base)).otherwise(cap)
    rules = [
        ("blank key", (key != "") & (F.trim(key) == "")),
        ("long key", F.octet_length(key) > MAX_KEY_BYTES),
        ("release without key", release & (key == "")),
        ("negative delay", (delay < 0) | (base < 0) | (cap < 0)),
        ("cap below base", filled < base),
        ("bad jitter", F.isnan(jitter) | (jitter < 0) | (jitter > 1)),
        ("too deep", depth > max_depth),
    ]
    invalid = F.coalesce(*(F.when(c, name) for name, c in rules))
    made = {"retry_backoff_max_ms": filled, "retry_backoff_ms": base, "retry_jitter": jitter, "max_attempts": F.when(attempts == 0, 3).otherwise(attempts), "delay_ms": delay}
    return requests.withColumns(made | {"invalid": invalid})


def dedup(requests: DataFrame, stored: DataFrame | None = None, order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """``outcome`` by receipt: new, replay (equal request), conflict (another one) or unkeyed.

    For requests that all become jobs: the first one of a key makes its receipt, unless one
    is stored. ``first_seq`` names the request that the receipt is from (null for a stored
    one). Where later gates refuse requests, ``admit`` decides on all of it together.
    """
    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    rows = requests.withColumn("_keyed", keyed)
    if stored is not None:
        s = stored.select(F.col("queue_name").alias("name"), "idempotency_key", F.col("request").alias("_stored"), F.lit(True).alias("_has"))
        rows = rows.join(s, ["name", "idempotency_key"], "left")
    else:
        rows = rows.withColumns({"_stored": F.lit(None).cast("string"), "_has": F.lit(None).cast("boolean")})
    first = rows.where("_keyed").groupBy("name", "idempotency_key").agg(F.min(F.struct(*order, "request")).alias("_f"))
    rows = rows.join(first, ["name", "idempotency_key"], "left")
    is_first = (F.struct(*order) == F.struct(*(F.col(f"_f.{c}") for c in order))) & F.col("_has").isNull()
    against = F.when(F.col("_has"), F.col("_stored")).otherwise(F.col("_f.request"))
    outcome = F.when(~F.col("_keyed"), "unkeyed").when(is_first, "new").when(F.col("request").eqNullSafe(against), "replay").otherwise("conflict")
    seq = F.when(F.col("_keyed") & F.col("_has").isNull(), F.col(f"_f.{order[-1]}"))
    return rows.withColumns({"outcome": outcome, "first_seq": seq}).drop("_keyed", "_stored", "_has", "_f")


def resolve_ancestry(requests: DataFrame, known: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Depth and trace of each request, from its parent among ``known`` (id, trace_id, execution_depth).

    ``rejection``: parent_not_found, inconsistent_depth, circuit_breaker, or null.
    """
    parent = F.nullif(F.col("parent_id"), F.lit(""))
    p = known.select(F.col("id").alias("_pid"), F.col("trace_id").alias("_ptrace"), F.col("execution_depth").alias("_pdepth"))
    rows = requests.withColumn("_parent", parent).join(p, F.col("_parent") == F.col("_pid"), "left")
    child, found = F.col("_parent").isNotNull(), F.col("_pid").isNotNull()
    given = F.coalesce(F.col("execution_depth"), F.lit(0))
    depth = F.when(child & found, F.col("_pdepth") + 1).otherwise(given)
    rejection = F.when(child & ~found, "parent_not_found").when(child & (given != 0) & (given != depth), "inconsistent_depth").when(depth > max_depth, "circuit_breaker")
    trace = F.when(child & found, F.col("_ptrace")).otherwise(F.nullif(F.col("trace_id"), F.lit("")))
    return rows.withColumns({"depth": depth, "trace": trace, "rejection": rejection}).drop("_parent", "_pid", "_ptrace", "_pdepth")


def quarantine(requests: DataFrame, cap: int, counters: DataFrame | None = None, trace: str = "trace_id", order: tuple[str, ...] = ("t_ms", "seq")) -> DataFrame:
    """``within_quota``: whether the trace had fewer than ``cap`` jobs before this one (0: no cap).

    Being the last gate, a trace's accepted requests are simply its first ones. Requests
    without a trace are roots of lineages of their own and always within it.
    """
    if cap <= 0:
        return requests.withColumn("within_quota", F.lit(True))
    rank = F.row_number().over(Window.partitionBy(trace).orderBy(*order))
    rows = requests.withColumn("_rank", rank)
    if counters is not None:
        rows = rows.join(counters.select(F.col("trace_id").alias(trace), F.col("job_count").alias("_had")), trace, "left")
    else:
        rows = rows.withColumn("_had", F.lit(0))
    return rows.withColumn("within_quota", (F.coalesce(F.col(trace), F.lit("")) == "") | (F.col("_rank") + F.coalesce("_had", F.lit(0)) <= cap)).drop("_rank", "_had")


#: Kinds of refusals as the rejection table stores them (fixed values).
INGRESS, CHAIN, NO_PARENT, BAD_DEPTH, BREAKER = "ingress_velocity", "chain_quarantine", "parent_not_found", "inconsistent_depth", "circuit_breaker"
#: What a refusal says, by kind (fixed values).
DETAIL = {
    INGRESS: "ingress velocity limit exceeded for facet {0}",
    NO_PARENT: "ancestry: parent {0} not found",
    BAD_DEPTH: "ancestry: execution_depth {0} must equal parent depth + 1 ({1})",
    BREAKER: "Circuit breaker tripped: execution depth {0} exceeds max allowed {1}",
    CHAIN: "chain quarantined: lineage {0} exceeded max chain size {1}",
}
_READS = ["seq", "t_ms", "name", "idempotency_key", "request", "facet", "id", "_invalid", "_has", "_stored", "_parent", "_known", "_ptrace", "_pdepth", "_given", "_trace", "_had", "_named", "_start", "_count", "_before"]
_MADE = "status string, depth long, trace string, first_seq long, detail string, window_start long, window_count long, window_before long"


class Writer:
    """The single writer: decides on one request after another, and only an accepted one leaves traces.

    A refusal undoes all that its request has done, so it makes no receipt, uses no
    quota of its facet or lineage, and is no parent.
    """

    def __init__(self, limit: int | None, window_ms: int, chain_cap: int, max_depth: int) -> None:
        self.limit, self.window, self.cap, self.max_depth = limit, window_ms, chain_cap, max_depth
        self.receipts: dict[tuple, tuple] = {}
        self.buckets: dict[str, SlidingBucket] = {}
        self.chains: dict[str, int] = {}
        self.parents: dict[str, tuple[str, int]] = {}

    def decide(self, seq, t_ms, name, key, request, facet, own_id, invalid, has, stored, parent, known, ptrace, pdepth, given, trace, had, named, start, count, before) -> tuple:
        """Status, depth, trace, the request that holds the receipt, detail, and the facet's window afterwards."""
        out = lambda status, depth, trace, first=None, *said: (status, depth, trace, first, DETAIL[status].format(*said) if said else None, None, None, None)
        if invalid is not None:
            return out("invalid", given, trace)
        receipt = self.receipts.get((name, key)) if key else None
        if receipt is None and key and has:
            receipt = (None, stored)
        if receipt is not None:
            return out("replay" if receipt[1] == request else "conflict", given, trace, receipt[0])
        bucket = None
        if facet and self.limit is not None:
            bucket = self.buckets.get(facet) or (None if start is None else SlidingBucket(start, count, before))
            open_, bucket = SlidingBucket.admit(bucket, t_ms, self.window, self.limit)
            if not open_:
                return out(INGRESS, given, trace, None, facet)
        depth = given
        if parent is not None:
            if parent in self.parents:
                ptrace, pdepth = self.parents[parent]
            elif not known:
                return out(NO_PARENT, given, trace, None, parent)
            if given not in (0, pdepth + 1):
                return out(BAD_DEPTH, given, ptrace, None, given, pdepth + 1)
            depth, trace = pdepth + 1, ptrace
        if depth > self.max_depth:
            return out(BREAKER, depth, trace, None, depth, self.max_depth)
        if self.cap > 0:
            jobs = self.chains.get(trace, had)
            if jobs >= self.cap:
                return out(CHAIN, depth, trace, None, trace, self.cap)
            self.chains[trace] = jobs + 1
        if bucket is not None:
            self.buckets[facet] = bucket
        if key:
            self.receipts[name, key] = seq, request
        if named:
            self.parents[own_id] = trace, depth
        window = (bucket.start, bucket.current, bucket.previous) if bucket else (None, None, None)
        return "accepted", depth, trace, seq if key else None, None, *window


def admit(
    requests: DataFrame, known: DataFrame, limit: int | None, window_ms: int, chain_cap: int = 0, max_depth: int = MAX_DEPTH,
    receipts: DataFrame | None = None, counters: DataFrame | None = None, windows: DataFrame | None = None, new_trace: Column | None = None, groups: list[str] | None = None,
) -> DataFrame:
    """All gates for single requests in the order (t_ms, seq): receipt, velocity, ancestry, depth, lineage quota.

    ``status``: invalid, replay, conflict, ingress_velocity, parent_not_found,
    inconsistent_depth, circuit_breaker, chain_quarantine, or accepted; with ``depth``,
    ``trace``, ``first_seq`` (whose receipt it meets), ``detail`` of a refusal, and for
    accepted ones ``state``, ``available_at`` and the facet's window after it. Parents are ``known`` jobs or requests accepted earlier (by their
    ``id``, if requests have one). A root without a trace gets ``new_trace`` (a random one by
    default). ``receipts``, ``counters`` and ``windows`` are what earlier requests have left;
    without a ``limit`` there is no velocity gate.

    Gates depend on one another over keys, facets and lineages, so what they share is
    decided by one writer. Everything that is not sequential (validation, and joins with
    receipts, parents and counters) runs before in parallel; the writer streams over narrow
    rows and holds one entry for each key, facet, lineage and parent. ``groups``
    names columns, such as a tenant's, across which keys, facets, lineages and parents
    are never shared: each group then has a writer of its own.
    """
    rows = validate(requests, max_depth)
    have = set(rows.columns)
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    fresh = F.expr("uuid()") if new_trace is None else new_trace
    rows = rows.withColumns({
        "_parent": text("parent_id"), "_given": F.coalesce(F.col("execution_depth"), F.lit(0)).cast("long") if "execution_depth" in have else F.lit(0).cast("long"),
        "_trace": F.coalesce(text("trace_id"), fresh), "_key": text("idempotency_key"), "_facet": text("facet"), "_id": text("id"),
    })
    overflow = F.try_add(F.col("t_ms"), F.col("delay_ms").cast("long")).isNull()
    rows = rows.withColumn("_invalid", F.coalesce("invalid", F.when(overflow, "delay overflows")))
    p = known.select(F.col("id").alias("_pid"), F.col("trace_id").alias("_ptrace"), F.col("execution_depth").cast("long").alias("_pdepth"))
    rows = rows.join(p, F.col("_parent") == F.col("_pid"), "left").withColumn("_known", F.col("_pid").isNotNull()).drop("_pid")
    if receipts is not None:
        s = receipts.select(F.col("queue_name").alias("_q"), F.col("idempotency_key").alias("_k"), F.col("request").alias("_stored"), F.lit(True).alias("_has"))
        rows = rows.join(s, (F.col("name") == F.col("_q")) & (F.col("_key") == F.col("_k")), "left").drop("_q", "_k").withColumn("_has", F.coalesce("_has", F.lit(False)))
    else:
        rows = rows.withColumns({"_stored": F.lit(None).cast("string"), "_has": F.lit(False)})
    if counters is not None:
        lineage = F.when(F.col("_parent").isNotNull() & F.col("_known"), F.col("_ptrace")).otherwise(F.col("_trace"))
        c = counters.select(F.col("trace_id").alias("_t"), F.col("job_count").cast("long").alias("_had"))
        rows = rows.join(c, lineage == F.col("_t"), "left").drop("_t").withColumn("_had", F.coalesce("_had", F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("_had", F.lit(0).cast("long"))
    if windows is not None:
        f = windows.select(F.col("facet_key").alias("_f"), F.col("current_window_start").cast("long").alias("_start"), F.col("current_count").cast("long").alias("_count"), F.col("previous_count").cast("long").alias("_before"))
        rows = rows.join(f, F.col("_facet") == F.col("_f"), "left").drop("_f")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("_start", "_count", "_before")})
    if "id" in have:
        asked = rows.where("_parent is not null and not _known").select(F.col("_parent").alias("_id")).distinct().withColumn("_named", F.lit(True))
        rows = rows.join(asked, "_id", "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
    else:
        rows = rows.withColumn("_named", F.lit(False))

    by = [f"_group{i}" for i, _ in enumerate(groups or [])]
    narrow = rows.select(*(F.col(g).alias(n) for g, n in zip(groups or [], by)), "seq", "t_ms", "name", F.col("_key").alias("idempotency_key"), "request", F.col("_facet").alias("facet"), F.col("_id").alias("id"), "_invalid", "_has", "_stored", "_parent", "_known", "_ptrace", "_pdepth", "_given", "_trace", "_had", "_named", "_start", "_count", "_before")
    decided = _decide(narrow, by, limit, window_ms, chain_cap, max_depth)
    rows = rows.join(decided, "seq")
    taken = F.col("status") == "accepted"
    made = {"state": F.when(taken, F.when(F.col("delay_ms") > 0, "Delayed").otherwise("Waiting")), "available_at": F.when(taken, F.try_add(F.col("t_ms"), F.col("delay_ms").cast("long")))}
    return rows.withColumns(made).drop(*[c for c in rows.columns if c.startswith("_")])


def _decide(narrow: DataFrame, groups: list[str], limit: int, window_ms: int, chain_cap: int, max_depth: int) -> DataFrame:
    made = _MADE.split(", ")
    kinds = pa.schema([("seq", pa.int64()), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, writer = None, None
        for b in batches:
            col = dict(zip(b.schema.names, (c.to_pylist() for c in b.columns)))
            out = []
            homes = zip(*(col[g] for g in groups)) if groups else [()] * b.num_rows
            for home, row in zip(homes, zip(*(col[c] for c in _READS))):
                if writer is None or home != key:
                    key, writer = home, Writer(limit, window_ms, chain_cap, max_depth)
                out.append((row[0], *writer.decide(*row)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds) if out else pa.RecordBatch.from_pylist([], schema=kinds)

    one = narrow.repartition(*groups) if groups else narrow.coalesce(1)
    return one.sortWithinPartitions(*groups, "t_ms", "seq").mapInArrow(run, f"seq long, {_MADE}")


def rejection_log(rows: DataFrame) -> DataFrame:
    """Rows of the rejection table: each kind fills only the columns it knows."""
    kind = F.col("status")
    lineage = kind.isin(BAD_DEPTH, BREAKER, CHAIN)
    bad = rows.where(kind.isin(INGRESS, NO_PARENT, BAD_DEPTH, BREAKER, CHAIN))
    return bad.select(
        F.col("t_ms").alias("rejected_at"), kind.alias("kind"), "name",
        F.when(lineage, F.col("trace")).alias("trace_id"),
        F.when(lineage | (kind == NO_PARENT), F.nullif(F.col("parent_id"), F.lit(""))).alias("parent_id"),
        F.when(lineage, F.col("depth")).alias("execution_depth"),
        F.when(kind == INGRESS, F.col("facet")).alias("rate_limit_facet"),
        "detail", "seq",
    )


def rejection_group(kind: str = "kind"):
    """Ingress, chain, or all that has to do with ancestry."""
    return F.when(F.col(kind) == INGRESS, "ingress").when(F.col(kind) == CHAIN, "chain").otherwise("ancestry")


def gate_batches(rows: DataFrame, batch: str = "batch_id", ok: str = "ok", pos: str = "pos", limit: int = BULK_LIMIT) -> DataFrame:
    """A batch is taken whole or not at all: size within bounds and every row ``ok``.

    ``batch_error`` names the first failing position, or the bad size.
    """
    per = rows.groupBy(batch).agg(F.count("*").alias("_n"), F.min(F.when(~F.col(ok), F.col(pos))).alias("_bad"))
    error = F.when(F.col("_n") > limit, "too many jobs").when(F.col("_bad").isNotNull(), F.concat(F.lit("bulk job "), F.col("_bad").cast("string"), F.lit(": rejected")))
    return rows.join(per.select(batch, error.alias("batch_error")), batch).withColumn("committed", F.col("batch_error").isNull())
