"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import package_key
from ..session import cut, release

ON_CYCLE, BELOW_CYCLE = -1, -2


def latest_parents(links: DataFrame, parent: str, child: str, at: str) -> DataFrame:
    """``node, parent``: every id that occurs, with the parent that its latest row names.

    Ids are trimmed and lower-cased; blank ids count as null. Rows without a child state nothing
    but that their parent occurs. Among rows of the same time the greatest parent wins, null being
    the least; rows without time come before all others.
    """
    rows = links.select(package_key(parent).alias("p"), package_key(child).alias("c"), F.col(at).alias("t"))
    # every id is a row of its own, a parent's row states no link (rank 0): one aggregation does it all
    both = rows.select(F.explode(F.array(
        F.struct(F.col("c").alias("node"), F.struct(F.lit(1).alias("rank"), F.col("t"), F.col("p")).alias("best")),
        F.struct(F.col("p").alias("node"), F.struct(F.lit(0).alias("rank"), F.lit(None).cast(rows.schema["t"].dataType).alias("t"), F.lit(None).cast("string").alias("p")).alias("best")),
    )).alias("x")).select("x.*").filter(F.col("node").isNotNull())
    return both.groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.p").alias("parent"))


def resolve_hierarchy(parents: DataFrame, with_path: bool = False) -> DataFrame:
    """Root, depth and (if asked for) path of each node of ``parents(node, parent)``.

    Returns ``node_id, root_id, depth[, path]``, the path as an array from the root to the node. A node without parent is a root of depth 0. Nodes
    on a cycle have root ``''`` and depth -1, nodes at any distance below a cycle ``''`` and -2;
    both have a null path. ``node`` is unique and not null, and each parent is a node too (see
    :func:`latest_parents`, which gives such a table). An empty table gives an empty result.

    One table holds for each node a pointer to an ancestor, the distance to it and whether it is a
    root. A round joins the open pointers with the table, which doubles the distance; nodes whose
    pointer reaches a root are done and carried on as they are. As the depths of a tree have no
    gaps, a round in which no node is done leaves only nodes on or below cycles. Those go on
    doubling until the set of nodes pointed at stops shrinking: that set then is the nodes on
    cycles. So the rounds are logarithmic in the depth, and each round's plan is one join of two
    files. The table has one row per node, so where many pointers meet in one ancestor only their
    own side is uneven, and adaptive execution splits it (``spark.sql.adaptive.skewJoin``).
    """
    path = ["path"] * with_path
    # a pointer's path holds the nodes after its target, down to the node itself
    start = parents.select(
        "node", F.coalesce("parent", "node").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("parent").isNull().alias("fin"), *[F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("node")).alias(c) for c in path],
    )
    state = cut(start)
    left = state.filter(~F.col("fin")).count()
    while left:
        ahead = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("fin").alias("fin2"), *[F.col(c).alias(f"{c}2") for c in path])
        moved = state.filter(~F.col("fin")).drop("fin").join(ahead, "anc").select(
            "node", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("fin2").alias("fin"), *[F.concat(f"{c}2", c).alias(c) for c in path]
        )
        new = cut(state.filter("fin").unionByName(moved))
        release(state)
        state = new
        before, left = left, state.filter(~F.col("fin")).count()
        if left == before:
            break
    out = state.filter("fin").select(F.col("node").alias("node_id"), F.col("anc").alias("root_id"), F.col("dist").alias("depth"), *[F.concat(F.array("anc"), c).alias(c) for c in path])
    if left:
        lost = _cyclic(state.filter(~F.col("fin")).select("node", "anc"))
        out = out.unionByName(lost.select("*", *[F.lit(None).cast("array<string>").alias(c) for c in path]))
    return out


def _cyclic(pointers: DataFrame) -> DataFrame:
    """Nodes on (-1) and below (-2) cycles, from pointers ``node, anc`` that never end.

    ``image`` is what the pointers point at, with its own pointers: a smaller table in each round.
    The nodes themselves need no further rounds; they are on a cycle if they are in the last image.
    """
    image = cut(pointers.join(pointers.select(F.col("anc").alias("node")).distinct(), "node", "left_semi"))
    size, seen = image.count(), pointers.count()
    while size != seen:
        # each node of the image moves to what its target points at
        moved = image.join(image.select(F.col("node").alias("anc"), F.col("anc").alias("a2")), "anc").select("node", F.col("a2").alias("anc"))
        nxt = cut(moved.join(moved.select(F.col("anc").alias("node")).distinct(), "node", "left_semi"))
        release(image)
        image, seen, size = nxt, size, nxt.count()
    marked = pointers.select("node").join(image.select("node", F.lit(True).alias("on")), "node", "left")
    depth = F.when(F.col("on"), ON_CYCLE).otherwise(BELOW_CYCLE).cast("bigint")
    return marked.select(F.col("node").alias("node_id"), F.lit("").alias("root_id"), depth.alias("depth"))


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` of all pairs, from the paths of the nodes.

    Every node carries its own ancestors in its path, so the pairs need no join and no shuffle.
    The number of pairs is the sum of the depths.
    """
    pairs = resolved.filter(F.col("depth") > 0).select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return pairs.filter(F.col("at") < F.col("depth")).select(
        "ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).cast("bigint").alias("distance")
    )


def cycle_members(parents: DataFrame, resolved: DataFrame) -> DataFrame:
    """``cycle_id, node_id`` of the nodes on cycles; a cycle's id is its least node.

    Doubles again over the nodes on cycles only, carrying the least id seen, until no id changes.
    """
    on = resolved.filter(F.col("depth") == ON_CYCLE).select(F.col("node_id").alias("node"))
    state = cut(parents.join(on, "node").select("node", F.col("parent").alias("anc"), F.least("node", "parent").alias("low"), F.lit(True).alias("fell")))
    while True:
        ahead = state.select(F.col("node").alias("anc"), F.col("anc").alias("a2"), F.col("low").alias("low2"))
        moved = cut(state.drop("fell").join(ahead, "anc").select("node", F.col("a2").alias("anc"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")))
        release(state)
        state = moved
        if moved.filter("fell").isEmpty():
            return state.select(F.col("low").alias("cycle_id"), F.col("node").alias("node_id"))
