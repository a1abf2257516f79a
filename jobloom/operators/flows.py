"""Trees of jobs, flattened to rows (flow_no, node_no, parent_node_no, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.schemas import conform
from jobloom.sources.paths import cut

MAX_HEIGHT = 10
MAX_NODES = 1000


def depths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_height: int = MAX_HEIGHT) -> DataFrame:
    """``depth`` (roots: 0) and ``root`` of every node; null where no root is within ``max_height`` levels.

    Every node points at an ancestor and knows how far away it is; a round replaces the
    ancestor by the one it points at, so rounds grow with the logarithm of the height.
    """
    parent = F.col(parent_col)
    at = nodes.select(F.col(id_col).alias("id"), F.coalesce(parent, F.col(id_col)).alias("root"), F.when(parent.isNull(), 0).otherwise(1).alias("depth"), parent.isNull().alias("done"))
    for _ in range(max(0, max_height - 1).bit_length() + 1):
        at = cut(at, "pointers")
        far = at.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        step = at.where("not done").join(far, F.col("root") == F.col("_id"), "left")
        step = step.select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.coalesce("_done", F.lit(False)).alias("done"))
        at = at.where("done").unionByName(step)
    found = F.col("done") & (F.col("depth") <= max_height)
    return at.select("id", F.when(found, F.col("depth")).alias("depth"), F.when(found, F.col("root")).alias("root"))


def lineage(nodes: DataFrame, start: list[str], max_height: int = MAX_HEIGHT) -> DataFrame:
    """(start, step, id): each node from ``start`` up to its root."""
    spark = nodes.sparkSession
    up = nodes.select("id", "parent_id")
    level = spark.createDataFrame([(s,) for s in start], "start string").join(up, F.col("start") == F.col("id")).select("start", F.lit(0).alias("step"), "id", "parent_id")
    out = level = cut(level, "lineage")
    for d in range(1, max_height + 1):
        level = level.where("parent_id is not null").select("start", F.lit(d).alias("step"), F.col("parent_id").alias("_p")).join(up, F.col("_p") == F.col("id")).select("start", "step", "id", "parent_id")
        level = cut(level, "lineage")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("start", "step", "id")


def children_values(history: DataFrame) -> DataFrame:
    """Per parent, the results of its completed children: id -> bytes."""
    done = history.where((F.col("state") == "Completed") & F.col("result").isNotNull() & F.col("parent_id").isNotNull())
    return done.groupBy("parent_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "result")))).alias("results"))


def pending_children(jobs: DataFrame) -> DataFrame:
    """How many children of each parent are still live."""
    return jobs.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("pending"))


def initial_states(nodes: DataFrame, now_ms: int) -> DataFrame:
    """States of new flow nodes: parents wait for their children, leaves are due or delayed."""
    kids = nodes.groupBy("flow_no", F.col("parent_node_no").alias("node_no")).agg(F.count("*").alias("pending_children"))
    out = nodes.join(kids, ["flow_no", "node_no"], "left").withColumn("pending_children", F.coalesce("pending_children", F.lit(0)))
    state = F.when(F.col("pending_children") > 0, "WaitingChildren").when(F.col("delay_ms") > 0, "Delayed").otherwise("Waiting")
    return out.withColumns({"state": state, "available_at": F.lit(now_ms) + F.col("delay_ms")})


def validate_flows(nodes: DataFrame, receipts: DataFrame | None = None, max_height: int = MAX_HEIGHT, max_nodes: int = MAX_NODES) -> DataFrame:
    """(flow_no, nodes, height, error): size and height caps, keys used twice or taken already."""
    keyed = nodes.withColumn("_id", F.concat_ws(":", F.col("flow_no").cast("string"), F.col("node_no").cast("string")))
    keyed = keyed.withColumn("_parent", F.when(F.col("parent_node_no").isNotNull(), F.concat_ws(":", F.col("flow_no").cast("string"), F.col("parent_node_no").cast("string"))))
    reach = depths(keyed, "_id", "_parent", max_height).select(F.col("id").alias("_id"), "depth")
    keyed = keyed.join(reach, "_id", "left")
    has_key = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    twice = keyed.where(has_key).groupBy("name", "idempotency_key").agg(F.count("*").alias("_uses")).where("_uses > 1")
    keyed = keyed.join(twice, ["name", "idempotency_key"], "left")
    if receipts is not None:
        taken = receipts.select(F.col("queue_name").alias("name"), "idempotency_key", F.lit(True).alias("_taken")).distinct()
        keyed = keyed.join(taken, ["name", "idempotency_key"], "left")
    else:
        keyed = keyed.withColumn("_taken", F.lit(None).cast("boolean"))
    per = keyed.groupBy("flow_no").agg(F.count("*").alias("nodes"), F.max("depth").alias("height"), F.count(F.when(F.col("depth").isNull(), 1)).alias("_deep"), F.max(F.when(has_key, F.col("_uses"))).alias("_twice"), F.max("_taken").alias("_taken"))
    error = F.when(F.col("nodes") > max_nodes, "too many nodes").when(F.col("_deep") > 0, "too high").when(F.col("_twice") > 1, "duplicate key").when(F.col("_taken"), "key exists")
    return per.select("flow_no", "nodes", "height", error.alias("error"))


def validate_merge(targets: DataFrame, jobs: DataFrame, added: DataFrame, max_height: int = MAX_HEIGHT, max_nodes: int = MAX_NODES) -> DataFrame:
    """(target_id, error) for subtrees (target_id, rel_depth of each node; direct children: 1) added to live jobs."""
    per = added.groupBy("target_id").agg(F.max("rel_depth").alias("_h"), F.count("*").alias("_new"))
    tree = F.coalesce("tree_id", "id").alias("tree_id")  # a job of its own is the root of a tree to come
    live = jobs.groupBy(tree).agg(F.count("*").alias("_have"))
    t = targets.join(jobs.select(F.col("id").alias("target_id"), "state", tree, "tree_depth"), "target_id", "left").join(live, "tree_id", "left").join(per, "target_id", "left")
    error = F.when(F.col("state").isNull(), "not live").when(F.col("state") == "Active", "active").when(F.col("tree_depth") + F.col("_h") > max_height, "too high").when(F.col("_have") + F.col("_new") > max_nodes, "too many nodes")
    return t.select("target_id", error.alias("error"))


def insert(nodes: DataFrame, receipts: DataFrame, now_ms: int, whole: bool = False, max_height: int = MAX_HEIGHT, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, receipts, verdicts) of new trees; refused ones make nothing, with ``whole`` no tree does if any is refused.

    ``nodes`` has flow_no, node_no, parent_node_no, id, name, idempotency_key, delay_ms and
    what else a job holds. The root's id is the tree and the lineage of all its nodes.
    """
    verdicts = cut(validate_flows(nodes, receipts, max_height, max_nodes), "flows")
    good = nodes.join(verdicts.where("error is null"), "flow_no", "left_semi")
    if whole and not verdicts.where("error is not null").isEmpty():
        good = good.limit(0)
    up = good.select("flow_no", F.col("node_no").alias("parent_node_no"), F.col("id").alias("parent_id"))
    placed = initial_states(good, now_ms).join(up, ["flow_no", "parent_node_no"], "left")
    reach = depths(placed.select("id", "parent_id"), max_height=max_height).select("id", F.col("root").alias("tree_id"), F.col("depth").alias("tree_depth"))
    made = placed.join(reach, "id")
    return _jobs(made, now_ms), _receipts(made, now_ms), verdicts


def _jobs(made: DataFrame, now_ms: int) -> DataFrame:
    own = made.withColumns({"trace_id": F.col("tree_id"), "execution_depth": F.col("tree_depth"), "created_at": F.lit(now_ms), "updated_at": F.lit(now_ms)})
    if "rate_limit_facet" in own.columns:
        own = own.withColumn("rate_limit_facet", F.nullif("rate_limit_facet", F.lit("")))
    return conform(own, "jobs")


def _receipts(made: DataFrame, now_ms: int) -> DataFrame:
    keyed = made.where(F.coalesce("idempotency_key", F.lit("")) != "")
    return conform(keyed.select(F.col("name").alias("queue_name"), "idempotency_key", F.col("id").alias("job_id"), F.col("state").alias("initial_state"), F.lit(now_ms).alias("created_at")), "enqueue_receipts")


def merge(jobs: DataFrame, receipts: DataFrame, added: DataFrame, now_ms: int, max_height: int = MAX_HEIGHT, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, receipts, verdicts) after subtrees are attached to the jobs that receipts name.

    ``added`` has target_name, target_key, node_no, parent_node_no (null: a child of the
    target), id, name, idempotency_key, delay_ms. A target that could run waits for its
    children again; one that waits already waits for more. A refused subtree changes nothing.
    """
    key = ["target_name", "target_key"]
    known = receipts.select(F.col("queue_name").alias("target_name"), F.col("idempotency_key").alias("target_key"), F.col("job_id").alias("target_id"))
    added = cut(added.join(known, key, "left").withColumn("flow_no", F.concat_ws("\x00", *key)), "merge")
    up = added.select("flow_no", F.col("node_no").alias("parent_node_no"), F.col("id").alias("parent_id"))
    rows = initial_states(added, now_ms).join(up, ["flow_no", "parent_node_no"], "left")
    reach = depths(rows.select("id", "parent_id"), max_height=max_height).select("id", F.col("depth").alias("_below"))
    rows = cut(rows.join(reach, "id"), "merge")
    shape = rows.select("target_id", F.coalesce(F.col("_below") + 1, F.lit(max_height + 1)).alias("rel_depth"))
    fits = validate_merge(added.select("target_id").where("target_id is not null").distinct(), jobs, shape, max_height, max_nodes)
    keys = validate_flows(added, receipts, max_height, max_nodes).select("flow_no", F.col("error").alias("_keys"))
    verdicts = added.select("flow_no", *key, "target_id").distinct().join(fits, "target_id", "left").join(keys, "flow_no")
    verdicts = cut(verdicts.select("flow_no", *key, "target_id", F.when(F.col("target_id").isNull(), "not found").otherwise(F.coalesce("error", "_keys")).alias("error")), "merge")
    good = rows.join(verdicts.where("error is null"), "flow_no", "left_semi")
    place = jobs.select(F.col("id").alias("target_id"), F.coalesce("tree_id", "id").alias("tree_id"), F.col("tree_depth").alias("_at"))
    made = good.join(place, "target_id").withColumns({"tree_depth": (F.col("_at") + F.col("_below") + 1).cast("int"), "parent_id": F.coalesce("parent_id", "target_id")})
    more = good.where("parent_node_no is null").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("_more"))
    hit = F.col("_more").isNotNull()
    gated = jobs.join(more, "id", "left").withColumns({
        "pending_children": (F.col("pending_children") + F.coalesce("_more", F.lit(0))).cast("int"),
        "state": F.when(hit, "WaitingChildren").otherwise(F.col("state")),
        "tree_id": F.when(hit, F.coalesce("tree_id", "id")).otherwise(F.col("tree_id")),
    }).select(*jobs.columns)
    return gated.unionByName(_jobs(made, now_ms), allowMissingColumns=True), receipts.unionByName(_receipts(made, now_ms), allowMissingColumns=True), verdicts.select(*key, "target_id", "error")


def fan_out_keys(parents: DataFrame) -> DataFrame:
    """One row for each child name in ``children``, with its default key parent:child:index."""
    out = parents.select("parent_id", F.posexplode("children").alias("index", "child"))
    return out.withColumn("idempotency_key", F.concat_ws(":", "parent_id", "child", F.col("index").cast("string")))
