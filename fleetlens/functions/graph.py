"""Forests and wait graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.store import settled


def root_of(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, child, root, level) of every child of a forest of edges (key, child, parent).

    Pointer doubling: each round lets every node jump as far again as it has come, and is written, so that a round reads
    the one before twice; a forest of d levels takes log2(d) rounds and one. Nodes on a cycle, and those below one, have
    no root: root and level are null.
    """
    key = key or []
    jump = settled(edges.select(*key, "child", F.col("parent").alias("root"), F.lit(1).cast("long").alias("level"), F.lit(True).alias("moved")), "jump")
    for _ in range(jump.count().bit_length() + 1):
        up = jump.select(*key, F.col("child").alias("root"), F.col("root").alias("_up"), F.col("level").alias("_more"))
        far = jump.join(up, [*key, "root"], "left")
        jump = settled(far.select(*key, "child", F.coalesce("_up", "root").alias("root"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level"), F.col("_up").isNotNull().alias("moved")), "jump")
        if jump.where("moved").isEmpty():
            break
    # After as many rounds as any path can take, only what stands on a cycle or leads to one still moves.
    return jump.select(*key, "child", *(F.when(~F.col("moved"), F.col(c)).alias(c) for c in ("root", "level")))


def ancestry(parents: DataFrame, key: list[str], paths: bool) -> tuple[DataFrame, list[DataFrame]]:
    """((key, pid, root, level, below, path) of all nodes under a root, [(key, pid, up) of each round]).

    Pointer doubling over (key, pid, parent), parent null for roots: after k rounds a node knows the ancestor 2^k above
    (``up``), the topmost one nearer than that, the way there, and how many nodes lie less than 2^k below it. A round
    joins what the ancestor knows, and adds up, by ancestor, what nodes 2^k below know; each is written, so plans stay small
    and rounds are log2 of the depth. Nodes on a cycle, or below one, have no topmost ancestor and are left out.
    """
    state = parents.select(*key, "pid", F.col("parent").alias("up"), F.col("pid").alias("root"), F.lit(0).cast("long").alias("level"), F.lit(1).cast("long").alias("n"), (F.array("pid") if paths else F.array().cast(T.ArrayType(parents.schema["pid"].dataType))).alias("path"))
    state = settled(state, "ancestry")
    lifts = [state.select(*key, "pid", "up")]
    for k in range(state.count().bit_length() + 1):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(*key, F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("level").alias("_level"), F.col("path").alias("_path"))
        moving = state.where("up is not null")  # nodes at their root stay where they are
        under = moving.groupBy(*key, F.col("up").alias("pid")).agg(F.sum("n").alias("_n"))
        far = moving.join(above, [*key, "up"], "left").select(*key, "pid", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("_level") + (1 << k)).alias("level"), "n", F.concat("_path", "path").alias("path"))
        far = far.unionByName(state.where("up is null")).join(under, [*key, "pid"], "left")
        state = settled(far.select(*key, "pid", "up", "root", "level", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), "path"), "ancestry")
        lifts.append(state.select(*key, "pid", "up"))
    return state.where("up is null").select(*key, "pid", "root", "level", (F.col("n") - 1).alias("below"), "path"), lifts


def _settled_parents(waits: DataFrame, key: list[str]) -> DataFrame:
    """(key, pid, parent) of every pid; the parent is the deepest blocker, null for those that don't wait.

    A pid with several blockers hangs below the deepest of them if the path to that one holds the others; else it is its
    own parent, a cycle, which takes it and all below it out. Levels are first guessed by how many a blocker waits for
    itself, as in a queue for one lock, then counted; what changes is counted again until nothing does.
    """
    several = settled(waits.groupBy(*key, "pid").agg(F.count("*").alias("_k"), F.min("blocker").alias("_one")), "several")
    roots = waits.select(*key, F.col("blocker").alias("pid")).distinct().join(several, [*key, "pid"], "left_anti").withColumn("parent", F.lit(None).cast(waits.schema["pid"].dataType))
    fixed = several.where("_k = 1").select(*key, "pid", F.col("_one").alias("parent")).unionByName(roots)
    most = several.where("_k > 1").count()
    if not most:
        return fixed
    loose = settled(waits.join(several.where("_k > 1").select(*key, "pid"), [*key, "pid"], "left_semi"), "loose")
    deepest = lambda depth: F.max(F.struct(depth.alias("d"), F.col("blocker").alias("b")))["b"].alias("parent")
    guess = several.select(*key, F.col("pid").alias("blocker"), "_k")
    chosen = settled(loose.join(guess, [*key, "blocker"], "left").groupBy(*key, "pid").agg(deepest(F.coalesce("_k", F.lit(0)))), "chosen")
    for _ in range(most + 1):
        nodes, lifts = ancestry(fixed.unionByName(chosen), key, False)
        known = loose.join(nodes.select(*key, F.col("pid").alias("blocker"), "level"), [*key, "blocker"], "left")
        fresh = settled(known.groupBy(*key, "pid").agg(deepest(F.coalesce("level", F.lit(1 << 62)))), "chosen")
        moved = fresh.join(chosen.withColumnRenamed("parent", "_was"), [*key, "pid"]).where("parent <> _was")
        chosen, before = fresh, chosen
        if moved.isEmpty():
            chosen = before
            break
    # is each other blocker the ancestor of the parent that stands as many levels above as they differ?
    level = nodes.select(*key, F.col("pid").alias("parent"), F.col("level").alias("_deep"))
    asked = known.join(chosen, [*key, "pid"]).where("blocker <> parent").join(level, [*key, "parent"], "left").withColumn("_steps", F.col("_deep") - F.col("level")).withColumn("_at", F.col("parent"))
    for k, lift in enumerate(lifts):
        up = lift.select(*key, F.col("pid").alias("_at"), F.col("up").alias("_up"))
        step = F.shiftright("_steps", k).bitwiseAND(F.lit(1)) == 1
        asked = asked.join(up, [*key, "_at"], "left").withColumn("_at", F.when(step, F.col("_up")).otherwise(F.col("_at"))).drop("_up")
    held = (F.col("_steps") > 0) & F.col("_at").eqNullSafe(F.col("blocker"))
    loops = asked.where(~F.coalesce(held, F.lit(False))).select(*key, "pid").distinct().withColumn("_loop", F.lit(True))
    ends = chosen.join(loops, [*key, "pid"], "left").select(*key, "pid", F.when(F.col("_loop"), F.col("pid")).otherwise(F.col("parent")).alias("parent"))
    return fixed.unionByName(settled(ends, "parents"))


def lock_tree(waits: DataFrame, key: list[str], paths: bool = True) -> DataFrame:
    """(key, pid, root, level, path, blocked) from waits (key, pid, blocker): who waits for whom, from blockers that don't wait.

    A pid stands below its deepest blocker, if all its blockers are on the path to that one; so it stands in one place,
    and those on a cycle, or below one, in none. ``blocked`` counts the pids below a pid. Rounds are log2 of the
    depth. Without ``paths``, which are as long as their pid's level, the column is left out.
    """
    waits = settled(waits.select(*key, "pid", "blocker").where("blocker is not null").distinct(), "waits")
    nodes = ancestry(_settled_parents(waits, key), key, paths)[0].withColumnRenamed("below", "blocked").withColumn("level", F.col("level").cast("int"))
    return nodes if paths else nodes.drop("path")
