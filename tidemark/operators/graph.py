"""Reachability over trees: mark, sweep, missing blobs, restore plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Levels of directories that a walk follows at most.
LEVELS = 1000


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder; a local session may do with one of our own, as tests do."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            import tempfile

            where = f"{tempfile.gettempdir()}/tidemark-{uuid.uuid4().hex}"
        context.setCheckpointDir(where)
    return df.checkpoint()


def reachable_trees(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots(tree), edges(tree, subtree) -> all trees reached, each once; a shared tree is walked once."""
    seen = settled(roots.select("tree").where("tree IS NOT NULL").distinct())
    frontier = seen
    for _ in range(LEVELS):
        frontier = settled(frontier.join(edges, "tree").select(F.col("subtree").alias("tree")).where("tree IS NOT NULL").distinct().join(seen, "tree", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("trees are nested too deep")


def first_reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots(snapshot_id, tree) -> (tree, snapshot_id): each tree with the smallest snapshot that reaches it."""
    own = roots.where("tree IS NOT NULL").groupBy("tree").agg(F.min("snapshot_id").alias("snapshot_id"))
    state = settled(own)
    frontier = state
    for _ in range(LEVELS):
        found = frontier.join(edges, "tree").where("subtree IS NOT NULL").groupBy(F.col("subtree").alias("tree")).agg(F.min("snapshot_id").alias("snapshot_id"))
        old = state.withColumnRenamed("snapshot_id", "old")
        frontier = settled(found.join(old, "tree", "left").where("old IS NULL OR snapshot_id < old").select("tree", "snapshot_id"))
        if frontier.isEmpty():
            return state
        state = settled(state.unionByName(frontier).groupBy("tree").agg(F.min("snapshot_id").alias("snapshot_id")))
    raise RuntimeError("trees are nested too deep")


def mark(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(type, id) of all blobs that any snapshot needs: trees, and the content of their files."""
    edges = nodes.select(F.col("tree_id").alias("tree"), "subtree").where("subtree IS NOT NULL").distinct()
    trees = reachable_trees(snapshots.select("tree"), edges)
    content = nodes.join(trees, nodes["tree_id"] == trees["tree"], "left_semi").select(F.explode("content").alias("id")).distinct()
    return trees.select(F.lit("tree").alias("type"), F.col("tree").alias("id")).unionByName(content.select(F.lit("data").alias("type"), "id"))


def sweep_plan(entries: DataFrame, pack_files: DataFrame, live: DataFrame) -> DataFrame:
    """pack_id, action (keep, dead, orphan) and bytes for every known pack.

    A pack stays if any of its blobs is live; orphans are stored packs that no index names.  A pack that
    is indexed but not stored counts 0 bytes.
    """
    alive = entries.join(live, ["type", "id"], "left_semi").select("pack_id").distinct().withColumn("alive", F.lit(True))
    indexed = entries.select("pack_id").distinct().withColumn("indexed", F.lit(True))
    every = indexed.join(pack_files, "pack_id", "full").join(alive, "pack_id", "left")
    action = F.when(F.col("alive"), "keep").when(F.col("indexed"), "dead").otherwise("orphan")
    return every.select("pack_id", action.alias("action"), F.coalesce("size", F.lit(0)).alias("bytes"))


def reclaimed(plan: DataFrame) -> DataFrame:
    """One row for a sweep_plan: packs that go, with or without a file, and the bytes of their files."""
    return plan.where("action <> 'keep'").agg(F.count("*").alias("packs_removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_reclaimed"))


def forget(snapshots: DataFrame, tag: str, keep_last: int) -> DataFrame:
    """Snapshots with whether they are forgotten: those of the tag beyond its newest keep_last."""
    if keep_last < 1:
        raise ValueError("keep_last must be at least 1")
    tagged = F.array_contains("tags", tag)
    rank = F.row_number().over(W.partitionBy(F.when(tagged, F.lit(tag))).orderBy(F.col("time").desc(), F.col("id").desc()))
    return snapshots.withColumn("forgotten", F.coalesce(tagged, F.lit(False)) & (rank > keep_last))


def forget_and_prune(snapshots: DataFrame, nodes: DataFrame, entries: DataFrame, pack_files: DataFrame, tag: str, keep_last: int) -> tuple[DataFrame, DataFrame]:
    """(snapshots to forget, plan of packs).  Nothing is deleted: the plan is made before anything is."""
    judged = forget(snapshots, tag, keep_last)
    live = mark(judged.where(~F.col("forgotten")), nodes)
    return judged.where("forgotten"), sweep_plan(entries, pack_files, live)


def missing_blobs(snapshots: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Blobs that snapshots need and the index lacks, with the smallest snapshot that needs each."""
    edges = nodes.select(F.col("tree_id").alias("tree"), "subtree").where("subtree IS NOT NULL").distinct()
    trees = first_reach(snapshots.select(F.col("id").alias("snapshot_id"), "tree"), edges)
    content = nodes.join(trees, nodes["tree_id"] == trees["tree"]).select("snapshot_id", F.explode("content").alias("id"))
    need = trees.select(F.lit("tree").alias("type"), F.col("tree").alias("id"), "snapshot_id").unionByName(content.select(F.lit("data").alias("type"), "id", "snapshot_id"))
    return need.groupBy("type", "id").agg(F.min("snapshot_id").alias("snapshot_id")).join(entries.select("type", "id"), ["type", "id"], "left_anti")


def paths_of(snapshot: DataFrame, nodes: DataFrame) -> DataFrame:
    """path and node columns of everything in one snapshot(tree): trees are walked with their paths."""
    frontier = snapshot.select("tree", F.lit("").alias("base"))
    out = None
    for _ in range(LEVELS):
        here = settled(nodes.join(frontier, nodes["tree_id"] == frontier["tree"]).select(F.concat("base", F.lit("/"), "name").alias("path"), *(c for c in nodes.columns if c != "tree_id")))
        if here.isEmpty():
            return out if out is not None else here
        out = here if out is None else out.unionByName(here)
        frontier = here.where("type = 'dir' AND subtree IS NOT NULL").select(F.col("subtree").alias("tree"), F.col("path").alias("base"))
    raise RuntimeError("trees are nested too deep")


def restore_plan(snapshot: DataFrame, nodes: DataFrame, target: DataFrame, includes: list[str] | None = None) -> DataFrame:
    """What a restore would do with each path: create, conflict (something else is there), or skip (special files).

    target(path, type) is what exists; directories may exist already.  A node with a name that isn't one, or
    a tree below anything but a directory, fails the query: such a snapshot restores nothing.
    """
    from tidemark.functions.paths import included, unsafe_node

    unsafe = F.coalesce(F.col("name").isNull() | unsafe_node("name", "type", "subtree"), F.lit(False))
    checked = paths_of(snapshot, nodes).where(F.assert_true(~unsafe, "a node of the snapshot has an invalid name or a tree below no directory").isNull())
    want = checked.select("path", "type", "size")
    if includes:
        want, _ = included(want, includes)
    have = target.select("path", F.col("type").alias("there"))
    action = (
        F.when(~F.col("type").isin("file", "dir", "symlink"), "skip").when(F.col("there").isNull(), "create")
        .when((F.col("there") == "dir") & (F.col("type") == "dir"), "keep").otherwise("conflict")
    )
    return want.join(have, "path", "left").select("path", "type", "size", action.alias("action"))
