"""Reachability, bounded closures, strong components and orders: frontier loops over DataFrames.

Each round is one join of the frontier with the edges; rounds are cut in the shared checkpoint
folder, so a lost executor costs one round. ``edges`` have ``src, dst``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, release, together
from . import hierarchy
from .skew import split_lookup

#: Edges of a cyclic core (counted, after trimming) that a task may solve in memory, some tens of MB; larger
#: cores are coloured on the cluster, with the same result. A bound on memory as of a broadcast: nothing is left out.
LOCAL_CORE = 500_000
#: What is seen is kept as the frontiers of so many rounds, then put together.
PARTS = 24
#: Pairs of two factors that a task multiplies out.
PAIRS = 250_000
#: Begins the id of a node put between the two factors; ids of nodes have no blanks around them.
HUB = " "


def _one(seen: list[DataFrame]) -> DataFrame:
    """What is seen so far as one scan; after many rounds all parts but the last are put together in place."""
    if len(seen) > PARTS:
        whole = cut(together(*seen[:-1]))
        release(*seen[:-1])
        seen[:-1] = [whole]
    return together(*seen)


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id``: everything reachable from ``seeds(id)``, these included; terminates on cycles."""
    pairs = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    frontier = cut(seeds.select("id").distinct())
    seen = [frontier]
    while not frontier.isEmpty():
        found = frontier.join(pairs, frontier["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(_one(seen), "id", "left_anti"))
        seen.append(frontier)
    release(pairs)
    return together(*seen)


def distances(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``origin, id, hops``: everything reachable from each of ``seeds(id)`` with the least number of hops.

    Each origin is at 0 hops from itself. ``most`` bounds the hops. The result has a row per pair, so
    seeds should be few or ``most`` small.
    """
    pairs = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    frontier, hops = cut(seeds.select(F.col("id").alias("origin"), "id", F.lit(0).alias("hops")).distinct()), 0
    seen = [frontier]
    while (most is None or hops < most) and not frontier.isEmpty():
        hops += 1
        found = frontier.join(pairs, frontier["id"] == pairs["src"]).select("origin", F.col("dst").alias("id"), F.lit(hops).alias("hops")).distinct()
        frontier = cut(found.join(_one(seen), ["origin", "id"], "left_anti"))
        seen.append(frontier)
    release(pairs)
    return together(*seen)


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst``: all pairs with a path of one edge or more between them, by squaring.

    Logarithmic in the longest shortest path: only the pairs that are new in a round meet all pairs in
    the next. The result has all pairs, so it is for graphs whose closure can be stored.
    """
    fresh = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    seen = [fresh]
    while not fresh.isEmpty():
        known = _one(seen)
        onward = known.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        before = known.select(F.col("src").alias("from"), F.col("dst").alias("mid"))
        longer = fresh.select("src", F.col("dst").alias("mid")).join(onward, "mid").select("src", F.col("to").alias("dst"))
        longer = longer.unionByName(fresh.select(F.col("src").alias("mid"), "dst").join(before, "mid").select(F.col("from").alias("src"), "dst"))
        fresh = cut(longer.distinct().join(known, ["src", "dst"], "left_anti"))
        seen.append(fresh)
    return together(*seen)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, level``: the length of the longest path to each node of an acyclic graph.

    Nodes on or behind a cycle have level null. Nodes with one predecessor hang below the next node
    above them that has none or several, at a distance that pointer doubling finds; so trees and
    long chains take a logarithmic number of rounds. Only the nodes where links meet take a round
    per level: a round places those whose predecessors all are placed (Kahn).
    """
    pairs = cut(edges.select("src", "dst").distinct())
    above = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src"))
    one = above.filter("n = 1").select(F.col("dst").alias("node"), F.col("src").alias("parent"))
    every = nodes.select(F.col("id").alias("node")).unionByName(pairs.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    hung = cut(hierarchy.resolve_hierarchy(every.join(one, "node", "left")).select(F.col("node_id").alias("id"), F.col("root_id").alias("top"), F.col("depth").alias("down")))
    # links into nodes where links meet, from the tops that their ends hang below; those of cycles never end
    meets = above.filter("n > 1").select("dst")
    met = pairs.join(meets, "dst", "left_semi").join(hung.withColumnRenamed("id", "src"), "src").select(F.when(F.col("down") >= 0, F.col("top")).alias("src"), "dst", (F.col("down") + 1).alias("step"))
    waits = cut(met.groupBy("src", "dst").agg(F.max("step").alias("step")))
    placed = [cut(hung.filter("down = 0").select("id").join(meets.withColumnRenamed("dst", "id"), "id", "left_anti").select("id", F.lit(0).cast("bigint").alias("level")))]
    while True:
        known = _one(placed).withColumnRenamed("id", "src")
        arrived = waits.join(known, "src", "left").groupBy("dst").agg(F.max(F.col("level") + F.col("step")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
        fresh = cut(arrived.filter("all").select(F.col("dst").alias("id"), "level").join(known.withColumnRenamed("src", "id"), "id", "left_anti"))
        if fresh.isEmpty():
            break
        placed.append(fresh)
    tops = together(*placed).select(F.col("id").alias("top"), F.col("level").alias("at"))
    of = hung.join(tops, "top", "left").select("id", F.when(F.col("down") >= 0, F.col("at") + F.col("down")).cast("int").alias("level"))
    return nodes.select("id").distinct().join(of, "id", "left")


def _core(pairs: DataFrame, trims: int) -> DataFrame:
    """Edges left after taking away, again and again, nodes that nothing enters or leaves; the files of ``pairs`` go with that."""
    size = pairs.count()
    for _ in range(trims):
        heads, tails = pairs.select(F.col("src").alias("id")).distinct(), pairs.select(F.col("dst").alias("id")).distinct()
        inner = heads.join(tails, "id")
        before, pairs = pairs, cut(pairs.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        release(before)
        now = pairs.count()
        if now == size or now <= LOCAL_CORE:
            break
        size = now
    return pairs


def tarjan(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strong components of a graph in memory, by Tarjan's algorithm without recursion."""
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        out.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    held: set[str] = set()
    parts: list[list[str]] = []
    for start in out:
        if start in number:
            continue
        work: list[tuple[str, Iterator[str]]] = []

        def open_(v: str, work=work) -> None:
            number[v] = low[v] = len(number)
            stack.append(v)
            held.add(v)
            work.append((v, iter(out[v])))

        open_(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    open_(w)
                    break
                if w in held:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        held.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    parts.append(part)
    return parts


def strong_components(edges: DataFrame, trims: int = 12, local: int = LOCAL_CORE) -> DataFrame:
    """``id, component``: nodes of strong components of two nodes or more; a component's id is its least node.

    Nodes outside cycles are trimmed on the cluster first. A core of at most ``local`` edges (counted)
    goes to one task; a larger one is split by colours: each node takes the least id that reaches it,
    and the nodes of a colour that lead back to it are a component; the rest goes another round.
    """
    pairs = _core(cut(edges.select("src", "dst").filter("src <> dst").distinct()), trims)
    found: list[DataFrame] = []
    spark = edges.sparkSession
    kind = pairs.schema["src"].dataType.simpleString()
    while True:
        size = pairs.count()
        if size == 0:
            break
        if size <= local:

            def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                every = [tuple(r) for b in batches for r in b.itertuples(index=False)]
                rows = [(v, min(p)) for p in tarjan(every) if len(p) > 1 for v in p]
                yield pd.DataFrame(rows, columns=["id", "component"])

            found.append(pairs.coalesce(1).mapInPandas(solve, f"id {kind}, component {kind}"))
            break
        part, pairs = _colour(pairs)
        found.append(part)
        pairs = _core(pairs, trims)
    out = spark.createDataFrame([], f"id {kind}, component {kind}")
    for part in found:
        out = out.unionByName(part)
    return out


def _colour(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One colouring round: the components found, and the edges between nodes that aren't in them."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    colour = cut(nodes.select("id", F.col("id").alias("c"), F.lit(True).alias("fell")))
    while not colour.filter("fell").isEmpty():
        # only colours that fell in the last round can make others fall
        spread = pairs.join(colour.filter("fell").select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
        new = cut(colour.join(spread, "id", "left").select("id", F.least("c", "n").alias("c"), F.coalesce(F.col("n") < F.col("c"), F.lit(False)).alias("fell")))
        release(colour)
        colour = new
    back = cut(pairs.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
    frontier = cut(colour.filter("id = c").select("id", "c"))
    inside = [frontier]
    while not frontier.isEmpty():
        up = back.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "c").distinct()
        frontier = cut(up.join(_one(inside), "id", "left_anti"))
        inside.append(frontier)
    all_in = together(*inside)
    members = cut(all_in.join(all_in.groupBy("c").count().filter("count > 1"), "c").select("id", F.col("c").alias("component")))
    done = all_in.select("id")
    rest = cut(pairs.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return members, rest


def coded_components(edges: DataFrame, code: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """``id, component`` as :func:`strong_components` groups the nodes, found over codes of the ids; a component's id is any text.

    Nodes that share a code count as one, which can only add cycles through that code. So the components hold if no
    code in them stands for two ids; that is looked up, and if it isn't so, the ids themselves are used.
    """
    parts = cut(strong_components(edges.select(code("src").alias("src"), code("dst").alias("dst"))).select(F.col("id").alias("code"), F.col("component").cast("string").alias("component")))
    named = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("code", code("id"))
    named = cut(named.join(parts, "code").select("id", "code", "component"))
    release(parts)
    return named.select("id", "component") if named.groupBy("code").count().filter("count > 1").isEmpty() else cut(strong_components(edges))


def cluster_ids(components: DataFrame) -> DataFrame:
    """``id, component, cluster``: the cluster id hashes the sorted members, as ``scc:`` and 16 digits."""
    members = components.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("m"))
    named = members.select("component", F.concat(F.lit("scc:"), F.substring(F.sha2("m", 256), 1, 16)).alias("cluster"))
    return components.join(named, "component").select("id", "component", "cluster")


def condensation(edges: DataFrame, nodes: DataFrame, prefix: str = "global_scc:") -> tuple[DataFrame, DataFrame]:
    """Cluster of each node (``id, cluster``) and the distinct edges between clusters (``src, dst``).

    Clusters (single nodes too) are numbered by size, then by their members. The numbers come from
    one sort over clusters, spread by size.
    """
    from pyspark.sql import Window

    parts = strong_components(edges)
    full = nodes.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sized = full.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("m"))
    # rank within a size, plus the clusters of smaller sizes: no window over all clusters but one over sizes
    within = F.row_number().over(Window.partitionBy("size").orderBy("m"))
    smaller = sized.groupBy("size").count().select("size", (F.sum("count").over(Window.orderBy("size")) - F.col("count")).alias("below"))
    numbered = sized.withColumn("r", within).join(F.broadcast(smaller), "size").select("component", F.concat(F.lit(prefix), (F.col("below") + F.col("r") - 1).cast("string")).alias("cluster"))
    of = full.join(numbered, "component").select("id", "cluster")
    a, b = of.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), of.select(F.col("id").alias("dst"), F.col("cluster").alias("cd"))
    between = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()
    return of, between


def break_cycles(edges: DataFrame) -> DataFrame:
    """``src, dst, kind`` of the graph with each strong component hung under a cluster node.

    Edges within a component and self-loops go; every edge from or to a member is kept and copied to
    the cluster (once per far end and kind); ``contains`` edges lead from the cluster to its members.
    """
    clusters = cluster_ids(strong_components(edges)).select("id", "cluster")
    a, b = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("cd"))
    marked = cut(edges.select("src", "dst", "kind").filter("src <> dst").join(a, "src", "left").join(b, "dst", "left").filter("cs is null or cd is null or cs <> cd"))
    copies = (
        marked.filter("cd is not null").select("src", F.col("cd").alias("dst"), "kind")
        .unionByName(marked.filter("cs is not null").select(F.col("cs").alias("src"), "dst", "kind"))
        .unionByName(marked.filter("cs is not null and cd is not null").select(F.col("cs").alias("src"), F.col("cd").alias("dst"), "kind"))
        .distinct()
    )
    inside = clusters.select(F.col("cluster").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    return marked.select("src", "dst", "kind").unionByName(copies).unionByName(inside)


def break_factored_cycles(edges: DataFrame, heads: DataFrame, tails: DataFrame, kind: str, code: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """:func:`break_cycles` of the distinct ``edges`` and of an edge of ``kind`` from each head to each tail of one ``via``.

    ``edges`` have ``src, dst, kind``, ``heads`` ``src, via`` and ``tails`` ``via, dst``, each once; no id begins with a blank. Components are found
    with a node between the heads and tails of a ``via`` in place of their pairs; clusters join the factors as heads and
    tails. So pairs are neither stored nor shuffled. Only those that may come twice are made distinct: both ends
    belong to several ``via``, or both also are ends of local edges of that kind.
    """
    hub = F.concat(F.lit(HUB), "via")
    parts = coded_components(edges.select("src", "dst").unionByName(heads.select("src", hub.alias("dst"))).unionByName(tails.select(hub.alias("src"), "dst")), code)
    parts = parts.filter(~F.startswith("id", F.lit(HUB)))
    several = parts.groupBy("component").count().filter("count > 1").select("component")
    clusters = cut(cluster_ids(cut(parts.join(several, "component", "left_semi"))).select("id", "cluster"))
    a, b = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("cd"))
    marked = split_lookup(edges.select("src", "dst", "kind").filter("src <> dst"), b, "dst").join(a, "src", "left")
    end = lambda s, d, copy: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(copy).alias("copy"))
    rows = marked.filter("cs is null or cd is null or cs <> cd").select("kind", F.explode(F.array(end("src", "dst", False), end("src", "cd", True), end("cs", "dst", True), end("cs", "cd", True))).alias("e"))
    local = cut(rows.select("e.src", "e.dst", "kind", "e.copy").filter("src is not null and dst is not null"))

    def factor(rows: DataFrame, end: str, cluster: str) -> DataFrame:
        """``via``, the end, its cluster, whether it is one; whether it may come twice: for several ``via``, or with local edges."""
        every = rows.select("via", end, cluster, F.lit(False).alias("is_cluster")).unionByName(rows.filter(F.col(cluster).isNotNull()).select("via", F.col(cluster).alias(end), cluster, F.lit(True).alias("is_cluster")).distinct())
        many = every.groupBy(end).agg((F.count(F.lit(1)) > 1).alias("many"))
        here = local.filter(F.col("kind") == kind).select(end, F.lit(True).alias("here")).distinct()
        return cut(every.join(many, end).join(here, end, "left").select("via", end, cluster, "is_cluster", "many", F.coalesce("here", F.lit(False)).alias("here")))

    left, right = factor(heads.join(a, "src", "left"), "src", "cs"), factor(tails.join(b, "dst", "left"), "dst", "cd")
    sizes = cut(left.groupBy("via").agg(F.count(F.lit(1)).alias("n")).join(right.groupBy("via").agg(F.count(F.lit(1)).alias("m")), "via").select("via", F.least("n", F.ceil(F.col("n") * F.col("m") / PAIRS)).alias("shares"), (F.col("n") * F.col("m")).alias("pairs")))
    tasks = int((sizes.agg(F.sum("pairs").alias("n")).first().n or 0) // PAIRS) + 1

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of each ``via``; the heads of a large one are dealt out over shares of their own."""
        dealt = left.join(sizes, "via").withColumn("share", F.pmod(F.xxhash64("src"), "shares")).select("via", "share", "src", "cs", F.col("is_cluster").alias("ls"), F.col("many").alias("ms"), F.col("here").alias("hs"))
        given = right.join(sizes, "via").select("via", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "dst", "cd", F.col("is_cluster").alias("ld"), F.col("many").alias("md"), F.col("here").alias("hd"))
        both = dealt.repartition(tasks, "via", "share").join(given.repartition(tasks, "via", "share"), ["via", "share"])
        return both.filter("(cs is null or cd is null or cs <> cd) and (ls or ld or src <> dst)").withColumns({"kind": F.lit(kind), "copy": F.expr("ls or ld"), "twice": F.expr("ms and md or hs and hd")})

    once = pairs(left, right).filter("not twice").select("src", "dst", "kind")
    twice = pairs(left.filter("many or here"), right.filter("many or here")).filter("twice").select("src", "dst", "kind", "copy")
    inside = clusters.select(F.col("cluster").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    return local.unionByName(twice).distinct().select("src", "dst", "kind").unionByName(once).unionByName(inside)


def simple_cycles(edges: DataFrame, longest: int | None = None, limit: int | None = None) -> DataFrame:
    """``cycle, length``: simple cycles of up to ``longest`` nodes (by default of any number), each from its least node on.

    Grown within strong components only, one hop a round, until no path is left; ``limit`` keeps the first by length and text.
    """
    parts = strong_components(edges)
    pairs = edges.select("src", "dst").distinct()
    loops = pairs.filter("src = dst").select(F.array("src").alias("path"))
    a, b = parts.select(F.col("id").alias("src"), F.col("component").alias("cs")), parts.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    inner = cut(pairs.filter("src <> dst").join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst"))
    paths = inner.filter("src < dst").select(F.array("src", "dst").alias("path"))
    found = [loops]
    n = 2
    while longest is None or n <= longest:
        last = F.element_at("path", -1)
        stepped = cut(paths.withColumn("src", last).join(inner, "src").select("path", "dst"))
        found.append(stepped.filter(F.col("dst") == F.col("path")[0]).select("path"))
        paths = stepped.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        if longest is None and paths.isEmpty():
            break
        n += 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    out = out.select(F.array_join("path", ",").alias("cycle"), F.size("path").alias("length"))
    return out.orderBy("length", "cycle").limit(limit) if limit else out


def weak_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (least member): minimum labels spread both ways, with shortcuts.

    A round takes the least label of a node's neighbours, then the label of its label, so the labels
    run along long chains in a logarithmic number of rounds in practice. A label's own row is the
    hub of its component; it meets the others through a table of one row per node.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    label = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("c"), F.lit(True).alias("fell")))
    while not label.filter("fell").isEmpty():
        near = both.join(label.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
        low = label.join(near, "id", "left").select("id", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        short = label.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = cut(low.join(short, "c", "left").select("id", F.least("c", "cc").alias("c"), (F.least("c", "cc") < F.col("old")).alias("fell")))
        release(label)
        label = new
    release(both)
    return label.select("id", F.col("c").alias("component"))


def common_ancestor(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``ancestor, hops_first, hops_second`` of the common ancestor with the fewest hops in all, then the least id."""
    spark = edges.sparkSession
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = distances(up, spark.createDataFrame([(first,), (second,)], "id string").distinct())
    a = both.filter(F.col("origin") == first).select("id", F.col("hops").alias("hops_first"))
    b = both.filter(F.col("origin") == second).select("id", F.col("hops").alias("hops_second"))
    return a.join(b, "id").orderBy(F.col("hops_first") + F.col("hops_second"), "id").limit(1).select(F.col("id").alias("ancestor"), "hops_first", "hops_second")


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """``path, hops``: the path of fewest hops, the least by its nodes among equals; no row if there is none.

    Walks back from ``end`` over the distances from ``start``, keeping the least node of each step.
    """
    spark = edges.sparkSession
    far = cut(distances(edges, spark.createDataFrame([(start,)], "id string")).select("id", "hops"))
    goal = far.filter(F.col("id") == end).select("hops").collect()
    if not goal:
        return spark.createDataFrame([], "path string, hops int")
    hops = goal[0].hops
    # nodes on some shortest path, from the end backwards
    on = {hops: spark.createDataFrame([(end,)], "id string")}
    for h in range(hops - 1, -1, -1):
        before = edges.select("src", "dst").join(on[h + 1].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        on[h] = cut(before.join(far.filter(F.col("hops") == h).select("id"), "id", "left_semi"))
    path = spark.createDataFrame([(start, [start])], "at string, path array<string>")
    for h in range(1, hops + 1):
        onward = path.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("id")), "at").join(on[h], "id", "left_semi")
        path = cut(onward.groupBy("path").agg(F.min("id").alias("at")).select("at", F.concat("path", F.array("at")).alias("path")))
    return path.select(F.array_join("path", ",").alias("path"), F.lit(hops).alias("hops"))
