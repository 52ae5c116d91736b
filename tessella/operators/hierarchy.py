"""Parent-child rows to full hierarchies: root, depth, path and number of descendants of every node, rings set apart.

A node is a splitter if a hash of its id says so (one in SPLIT_ONE_IN); nodes without a parent row are stops too.
1. Every node walks to its next splitter; the walks double their length each round, so a gap of g takes log2(g) rounds.
2. The graph of the splitters alone, a fraction of the nodes, is solved by pointer doubling, which also sums subtree sizes.
3. Each node's result is put together from its walk and its splitter's solution.
A walk that meets a node twice has found a ring without splitters; rings with splitters show up in step 2.

Nulls: a null key is no node; a null or '' parent means none; a parent that is not a key is a root outside the table.
Repeated keys: the parent of the row with the smallest order value counts. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.common import staged

SPLIT_ONE_IN = 8


def _splitter(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SPLIT_ONE_IN)) == 0


def parent_table(rows: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """id long, name, pid long (null at a stop), outer (the parent's name where it is not a key itself)."""
    first = staged(
        rows.select(F.col(key).alias("name"), F.col(parent).alias("up"), F.col(order).cast("long").alias("ord"))
        .where("name is not null and ord is not null")
        .groupBy("name")
        .agg(F.min("ord").alias("id"), F.min_by("up", "ord").alias("up")),
        "first",
    )
    has = first.where("up is not null and up <> ''")
    none = first.where("up is null or up = ''")
    names = first.select(F.col("name").alias("up"), F.col("id").alias("pid"))
    return staged(
        has.join(names, "up", "left")
        .select("id", "name", "pid", F.when(F.col("pid").isNull(), F.col("up")).alias("outer"))
        .unionByName(none.select("id", "name", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("string").alias("outer"))),
        "parents",
    )


def walks(nodes: DataFrame) -> DataFrame:
    """v, t (next stop above, v itself at a stop without parent), d, path (ids from the parent to t), ring (0, 1, 2)."""
    cur = nodes.select(
        F.col("id").alias("v"),
        F.coalesce("pid", "id").alias("t"),
        F.when(F.col("pid").isNull(), F.array().cast("array<long>")).otherwise(F.array("pid")).alias("path"),
        F.lit(0).alias("ring"),
        (F.col("pid").isNull() | _splitter(F.col("pid"))).alias("done"),
    )
    cur = staged(cur, "walk")
    finished = cur.where("done")
    open_ = cur.where("not done")
    while not open_.isEmpty():
        # t of an open row is no splitter, so its own row says how the walk goes on
        ahead = cur.select(F.col("v").alias("t"), F.col("t").alias("t2"), F.col("path").alias("path2"), F.col("ring").alias("ring2"), F.col("done").alias("done2"))
        nxt = open_.join(ahead, "t").select("v", F.col("t2").alias("t"), F.concat("path", "path2").alias("path"), "ring2", "done2")
        again = F.size(F.array_distinct("path")) < F.size("path")
        nxt = nxt.select(
            "v", "t", "path",
            F.when(again & F.array_contains("path", F.col("v")), 1).when(again | (F.col("ring2") > 0), 2).otherwise(0).alias("ring"),
            (F.col("done2") | again).alias("done"),
        )
        nxt = staged(nxt, "walk")
        finished = finished.unionByName(nxt.where("done"))
        cur = finished.unionByName(nxt.where("not done"))
        open_ = nxt.where("not done")
    return staged(finished.select("v", "t", F.size("path").cast("long").alias("d"), "path", "ring"), "walked")


def _solve(walked: DataFrame, with_paths: bool) -> DataFrame:
    """Of each stop s: root id r, distance d, ring (0, 1, 2), size (nodes in its subtree, itself included), path to the root."""
    stop = _splitter(F.col("v")) | (F.size("path") == 0)
    inner = walked.where(~stop & (F.col("ring") == 0)).groupBy(F.col("t").alias("s")).agg(F.count("*").alias("n"))
    chain = F.col("path") if with_paths else F.array().cast("array<long>")
    cur = (
        walked.where(stop)
        .select(F.col("v").alias("s"), F.when((F.size("path") > 0) & (F.col("ring") == 0), F.col("t")).alias("j"), F.when(F.size("path") == 0, F.col("v")).alias("r"), "d", "ring", chain.alias("path"))
        .join(inner, "s", "left")
        .select("s", "j", "r", "d", "ring", (F.coalesce("n", F.lit(0)) + 1).alias("size"), "path")
    )
    cur = staged(cur, "reduced")
    last = (-1, -1)
    while True:
        n, image = cur.where("j is not null").agg(F.count("*"), F.countDistinct("j")).first()
        if n == 0 or (n, image) == last:
            break
        last = (n, image)
        below = cur.where("j is not null").groupBy(F.col("j").alias("s")).agg(F.sum("size").alias("more"))
        ahead = cur.select(F.col("s").alias("j"), F.col("j").alias("j2"), F.col("r").alias("r2"), F.col("d").alias("d2"), F.col("ring").alias("ring2"), F.col("path").alias("path2"))
        moved = cur.where("j is not null").join(ahead, "j").select("s", F.col("j2").alias("j"), F.col("r2").alias("r"), (F.col("d") + F.col("d2")).alias("d"), F.when(F.col("ring2") > 0, 2).otherwise(0).alias("ring"), "size", (F.concat("path", "path2") if with_paths else F.col("path")).alias("path"))
        cur = staged(moved.unionByName(cur.where("j is null")).join(below, "s", "left").select("s", "j", "r", "d", "ring", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "path"), "reduced")
    if n:  # what is left runs in rings; the image of so many steps lies on them
        on = cur.where("j is not null").select(F.col("j").alias("s")).distinct().withColumn("on", F.lit(1))
        cur = cur.join(on, "s", "left").select("s", "j", "r", "d", F.when(F.col("on").isNotNull(), 1).when(F.col("j").isNotNull(), 2).otherwise(F.col("ring")).alias("ring"), "size", "path")
        cur = staged(cur, "reduced")
    return cur


def hierarchy(rows: DataFrame, key: str, parent: str, order: str, with_paths: bool = False) -> DataFrame:
    """One row per different key: name, root, depth, ring_state, n_below and, if asked for, path (names from the root down).

    ring_state: 0 a root is reached, 1 on a ring, 2 the way up runs into a ring; then root is '', depth and n_below -1, path null.
    """
    nodes = parent_table(rows, key, parent, order)
    walked = walks(nodes)
    solved = _solve(walked, with_paths)
    # walks between ring splitters hold the other ring nodes
    ring_stops = solved.where("ring = 1").select(F.col("s").alias("v"))
    on_ring = walked.join(ring_stops, "v", "left_semi").select(F.explode("path").alias("v")).distinct().withColumn("on", F.lit(1))
    stop = _splitter(F.col("v")) | (F.size("path") == 0)
    # a stop stands for itself; any other node for the stop it walks to
    via = F.when(stop, F.col("v")).otherwise(F.col("t"))
    got = (
        walked.select("v", via.alias("s"), F.when(stop, F.lit(0)).otherwise(F.col("d")).alias("d0"), F.when(stop, F.array().cast("array<long>")).otherwise(F.col("path")).alias("path0"), F.col("ring").alias("ring0"))
        .join(solved.select("s", "r", F.col("d").alias("d1"), F.col("ring").alias("ring1"), F.col("path").alias("path1")), "s", "left")
        .join(on_ring, "v", "left")
        .select(
            "v", "r", (F.col("d0") + F.col("d1")).alias("depth"),
            F.when(F.col("on").isNotNull() | (F.col("ring0") == 1), 1).when((F.col("ring0") == 2) | (F.coalesce("ring1", F.lit(0)) > 0), 2).otherwise(0).alias("ring"),
            F.concat("path0", "path1").alias("path"),
        )
    )
    weights = walked.where("ring = 0").select("v", "path", stop.alias("stop")).join(solved.where("ring = 0").select(F.col("s").alias("v"), "size"), "v", "left")
    below = weights.select(F.explode("path").alias("v"), F.when(F.col("stop"), F.col("size")).otherwise(F.lit(1)).alias("w")).groupBy("v").agg(F.sum("w").alias("below"))
    roots = nodes.where("pid is null").select(F.col("id").alias("r"), F.coalesce("outer", "name").alias("root"), F.when(F.col("outer").isNotNull(), 1).otherwise(0).alias("extra"), F.col("outer"))
    tree = F.col("ring") == 0
    full = (
        nodes.select(F.col("id").alias("v"), "name")
        .join(got, "v")
        .join(below, "v", "left")
        .join(roots, "r", "left")
        .select(
            "v", "name",
            F.when(tree, F.col("root")).otherwise(F.lit("")).alias("root"),
            F.when(tree, F.col("depth") + F.col("extra")).otherwise(F.lit(-1)).cast("long").alias("depth"),
            F.col("ring").cast("long").alias("ring_state"),
            F.when(tree, F.coalesce("below", F.lit(0))).otherwise(F.lit(-1)).cast("long").alias("n_below"),
            "path", "outer",
        )
    )
    if not with_paths:
        return full.drop("v", "path", "outer")
    full = staged(full, "tree")
    steps = full.where("ring_state = 0").select("v", F.posexplode("path").alias("at", "id")).join(nodes.select("id", F.col("name").alias("step")), "id")
    ways = steps.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("at"), "step"))), lambda x: x["step"]).alias("way"))
    front = F.when(F.col("outer").isNotNull(), F.array("outer")).otherwise(F.array().cast("array<string>"))
    return full.join(ways, "v", "left").select(
        "name", "root", "depth", "ring_state", "n_below",
        F.when(F.col("ring_state") == 0, F.concat(front, F.coalesce("way", F.array().cast("array<string>")), F.array("name"))).alias("path"),
    )
