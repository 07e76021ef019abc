"""Projection of source files onto the artifacts they affect.

Each step is a pure function of nodes ``id, type, src_path, seq`` and edges ``source, target, kind``;
it returns edges ``source, target, kind, derived_from, confidence, hops``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import ARTIFACT_TYPES, ENTRY_TYPES, FALLBACK_TYPES
from . import reach

OUT = ("source", "target", "kind", "derived_from", "confidence", "hops")


def _edges(df: DataFrame, source: str, target: str, kind: str, derived: Column | str, confidence, hops=None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), lit(derived).alias("derived_from"), lit(confidence).cast("double").alias("confidence"), (F.lit(None) if hops is None else lit(hops)).cast("int").alias("hops"))


def slashes(c: Column | str) -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\\"), F.lit("/"))


def ancestors(path: Column) -> Column:
    """All directories above a path, as an array of ``struct(depth, dir)``: at most one a separator."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))


def deepest_directory(items: DataFrame, item: str, path: Column, dirs: DataFrame, dir_id: str, dir_path: Column, order: str) -> DataFrame:
    """``item, dir_id`` of the deepest directory that holds each item: the longest-prefix join.

    An item's directories are exploded (a path has few) and met by an equality join, so there is no
    join on a prefix condition. Of directories with one path the first by ``order`` counts.
    """
    owner = dirs.select(dir_path.alias("dir"), F.struct(order, F.col(dir_id).alias("id")).alias("o")).filter("dir <> ''").groupBy("dir").agg(F.min("o.id").alias("dir_id") if order == dir_id else F.min("o").alias("m"))
    owner = owner if order == dir_id else owner.select("dir", F.col("m.id").alias("dir_id"))
    above = items.select(item, F.explode(ancestors(path)).alias("x")).select(item, "x.depth", "x.dir")
    return above.join(owner, "dir").groupBy(item).agg(F.max_by("dir_id", "depth").alias(dir_id))


def subdirectory_containment(nodes: DataFrame) -> DataFrame:
    """Each artifact with a path under its deepest subdirectory: ``contains``."""
    arts = nodes.filter(F.col("type").isin(*ARTIFACT_TYPES) & F.col("src_path").isNotNull()).select(F.col("id").alias("artifact"), "src_path")
    subs = nodes.filter((F.col("type") == "subdirectory") & (F.col("src_path") != "")).select(F.col("id").alias("subdir"), F.col("src_path").alias("p"), "seq")
    best = deepest_directory(arts, "artifact", slashes("src_path"), subs, "subdir", slashes("p"), "seq")
    return _edges(best, "subdir", "artifact", "contains", "subdirectory_inference", 1.0)


def part_of(edges: DataFrame) -> DataFrame:
    """``sources`` and ``contains`` turned round."""
    return _edges(edges.filter(F.col("kind").isin("sources", "contains")), "target", "source", "part_of", F.col("kind"), 1.0)


def _owners(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("source").alias("code"), F.col("target").alias("artifact")).distinct()


def _system(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("type") == "system_header") | F.col("id").startswith("//system:")).select("id")


def include_affects(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """A header affects the artifacts of the code that includes it; system headers don't."""
    inc = edges.filter(F.col("kind") == "include").select(F.col("source").alias("code"), F.col("target").alias("header")).filter(~F.col("header").startswith("//system:"))
    inc = inc.join(_system(nodes).withColumnRenamed("id", "header"), "header", "left_anti")
    return _edges(inc.join(_owners(parts), "code"), "header", "artifact", "affects", "include+part_of", 0.8)


def link_closure(nodes: DataFrame, edges: DataFrame, parts: DataFrame, most: int = 3) -> DataFrame:
    """Code affects what links, at up to ``most`` hops, to its artifact; surer the nearer.

    The walk is over artifacts only (far fewer than code), and met with the code once at the end.
    """
    arts = nodes.filter(F.col("type").isin(*ARTIFACT_TYPES)).select("id")
    links = edges.filter(F.col("kind") == "link_libraries").select(F.col("target").alias("src"), F.col("source").alias("dst"))
    links = links.join(arts.withColumnRenamed("id", "src"), "src", "left_semi").join(arts.withColumnRenamed("id", "dst"), "dst", "left_semi")
    owners = _owners(parts)
    walked = reach.distances(links, owners.select(F.col("artifact").alias("id")).distinct(), most).filter("hops > 0")
    met = owners.join(walked.withColumnRenamed("origin", "artifact"), "artifact")
    return _edges(met, "code", "id", "affects", "link_closure", F.round(F.greatest(F.lit(0.5), F.lit(0.7) - F.lit(0.1) * (F.col("hops") - 1)), 2), F.col("hops"))


def header_closure(nodes: DataFrame, edges: DataFrame, so_far: DataFrame, most: int = 2) -> DataFrame:
    """Headers at up to ``most`` include hops from a file affect its artifacts; system headers are passed through."""
    system = _system(nodes)
    inc = edges.filter(F.col("kind") == "include").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    owns = so_far.filter(F.col("kind").isin("part_of", "affects")).select(F.col("source").alias("start"), F.col("target").alias("artifact")).distinct()
    owns = owns.join(system.withColumnRenamed("id", "start"), "start", "left_anti").filter(~F.col("start").startswith("//system:"))
    walked = reach.distances(inc, owns.select(F.col("start").alias("id")).distinct(), most).filter("hops > 0")
    shown = walked.filter(~F.col("id").startswith("//system:")).join(system, "id", "left_anti")
    met = owns.join(shown.withColumnRenamed("origin", "start"), "start")
    return _edges(met, "id", "artifact", "affects", "include_closure", F.round(F.greatest(F.lit(0.5), F.lit(0.6) - F.lit(0.1) * (F.col("hops") - 1)), 2), F.col("hops"))


def include_placeholders(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``//include:x`` met with headers named x under an include directory of the including code's artifact."""
    path = F.split(F.substring("id", 3, 1 << 20), ":")[0]
    heads = nodes.filter((F.col("type") == "code") & F.col("id").startswith("//")).select(F.col("id").alias("header"), path.alias("p"))
    heads = heads.filter(F.lower("p").rlike(r"\.(h|hpp|hh|hxx)$")).select("header", F.substring_index("p", "/", -1).alias("base"), F.when(F.contains("p", F.lit("/")), F.regexp_replace("p", "/[^/]*$", "")).otherwise(F.col("p")).alias("dir"))
    wants = edges.filter((F.col("kind") == "include") & F.col("target").startswith("//include:")).select(F.col("source").alias("code"), F.regexp_replace("target", "^//include:", "").alias("base"))
    dirs = nodes.filter(F.size("include_dirs") > 0).select(F.col("id").alias("artifact"), F.transform("include_dirs", lambda d: F.ltrim(F.replace(d, F.lit("\\"), F.lit("/")), F.lit("/"))).alias("dirs"))
    met = wants.join(heads, "base").join(_owners(parts), "code").join(dirs, "artifact").filter(F.exists("dirs", lambda d: F.startswith(F.col("dir"), d)))
    return _edges(met, "header", "artifact", "affects", "include_dir_resolve", 0.75)


def _unowned(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    files = nodes.filter(F.col("type").isin(*FALLBACK_TYPES) & ~F.col("id").startswith("//system:"))
    return files.join(parts.select(F.col("source").alias("id")), "id", "left_anti")


def import_inherited(nodes: DataFrame, edges: DataFrame, parts: DataFrame, most: int | None = None) -> DataFrame:
    """A file without an artifact takes those of the files that import or include it.

    ``most`` keeps the first artifacts by the importer's edge, then by id.
    """
    from pyspark.sql import Window

    free = _unowned(nodes, parts).filter(~F.col("id").startswith("//external:")).select("id")
    uses = edges.filter(F.col("kind").isin("import", "include")).select(F.col("source").alias("code"), F.col("target").alias("id"), "seq").join(free, "id", "left_semi")
    got = uses.join(_owners(parts), "code").groupBy("id", "artifact").agg(F.min("seq").alias("seq"))
    if most:
        got = got.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("seq", "artifact"))).filter(F.col("r") <= most)
    return _edges(got, "id", "artifact", "affects", "fallback:import_inherited", 0.6)


def nearest_directory(nodes: DataFrame, parts: DataFrame, path: str = "src_path") -> DataFrame:
    """A file without an artifact takes the artifact whose directory is the deepest above it."""
    free = _unowned(nodes, parts).filter(F.col(path).isNotNull()).select("id", slashes(path).alias("p"))
    arts = nodes.filter(F.col("type").isin(*ARTIFACT_TYPES) & F.col(path).isNotNull()).select(F.col("id").alias("artifact"), F.regexp_replace(slashes(path), "/[^/]*$", "").alias("d"), "seq")
    best = deepest_directory(free, "id", F.col("p"), arts, "artifact", F.col("d"), "seq")
    return _edges(best, "id", "artifact", "affects", "fallback:nearest_dir", 0.5)


def fuse(edges: DataFrame) -> DataFrame:
    """One edge per ``source, target, kind``: greatest confidence, all evidence sorted; hops kept only by single edges.

    Returns ``source, target, kind, derived_from`` (array), ``confidence, hops, fallback, rules``.
    """
    fallback = F.col("derived_from").startswith("fallback:")
    rule = F.when(fallback, F.regexp_replace("derived_from", "^fallback:", ""))
    return edges.groupBy("source", "target", "kind").agg(
        F.array_sort(F.collect_set("derived_from")).alias("derived_from"),
        F.max("confidence").alias("confidence"),
        F.when(F.count(F.lit(1)) == 1, F.max("hops")).alias("hops"),
        F.coalesce(F.bool_or(fallback), F.lit(False)).alias("fallback"),
        F.array_sort(F.collect_set(rule)).alias("rules"),
    )


@dataclass(frozen=True)
class ProjectionRules:
    fallback: bool = True
    links: bool = True
    link_hops: int = 3
    headers: bool = True
    header_hops: int = 2
    placeholders: bool = True
    most_per_file: int | None = None
    inherit: bool = True
    nearest: bool = True
    fused: bool = True


def project(nodes: DataFrame, edges: DataFrame, rules: ProjectionRules = ProjectionRules()) -> DataFrame:
    """All projection edges of a graph, by the steps above in their order; run it on raw edges."""
    held = subdirectory_containment(nodes)
    parts = reach.cut(part_of(edges.select("source", "target", "kind").unionByName(held.select("source", "target", "kind"))))
    near = reach.cut(include_affects(nodes, edges, parts))
    out = [held, parts, near]
    if rules.links:
        out.append(link_closure(nodes, edges, parts, rules.link_hops))
    if rules.headers and rules.header_hops > 0:
        so_far = parts.unionByName(near)
        for more in out[3:]:
            so_far = so_far.unionByName(more)
        out.append(header_closure(nodes, edges, so_far, rules.header_hops))
    if rules.placeholders and "include_dirs" in nodes.columns:
        out.append(include_placeholders(nodes, edges, parts))
    if rules.fallback and rules.inherit:
        out.append(import_inherited(nodes, edges, parts, rules.most_per_file))
    if rules.fallback and rules.nearest:
        out.append(nearest_directory(nodes, parts))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return fuse(every) if rules.fused else every


def alive(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of nodes reachable from entry points over all edges, and from members to their containers."""
    forward = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = edges.filter(F.col("kind") == "contains").select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return reach.reach(forward.unionByName(back), nodes.filter(F.col("type").isin(*ENTRY_TYPES)).select("id"))


def dead_code(nodes: DataFrame, edges: DataFrame, main: str | None = None) -> DataFrame:
    """Nodes that no entry point reaches; with ``main`` only those of that graph."""
    dead = nodes.join(alive(nodes, edges), "id", "left_anti")
    return dead.filter(F.col("graph_id") == main) if main is not None else dead


def asset_artifacts(nodes: DataFrame, edges: DataFrame, assets: tuple[str, ...], artifacts: tuple[str, ...], most: int | None = None) -> DataFrame:
    """``asset, artifact, hops``: the artifacts each asset leads to over any edges.

    ``most`` bounds the hops; without it the walk goes on to the end, over nodes only that an artifact
    lies behind.
    """
    starts, goals = (nodes.filter(F.col("type").isin(*types)).select("id") for types in (assets, artifacts))
    pairs = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    if most is not None:
        walked = reach.distances(pairs, starts, most).filter("hops > 0")
        return walked.join(goals, "id", "left_semi").select(F.col("origin").alias("asset"), F.col("id").alias("artifact"), "hops")
    # the rounds walk over numbers, which take less room than ids
    pairs = pairs.filter("src <> dst").distinct()
    every = nodes.select("id").unionByName(pairs.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    of = reach.cut(every.withColumn("n", F.monotonically_increasing_id()))
    number = lambda ids, c="id", to="id": ids.join(of.withColumnRenamed("id", c).withColumnRenamed("n", f"{to}_"), c).drop(c).withColumnRenamed(f"{to}_", to)
    pairs = reach.cut(number(number(pairs, "src", "src"), "dst", "dst"))
    starts, goals = number(starts), reach.cut(number(goals))
    useful = reach.cut(reach.reach(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), goals))
    pairs, starts = pairs.join(useful.withColumnRenamed("id", "dst"), "dst", "left_semi"), starts.join(useful, "id", "left_semi")
    met = reach.distances(pairs, starts).filter("hops > 0").join(goals, "id", "left_semi")
    named = met.join(of.select(F.col("n").alias("origin"), F.col("id").alias("asset")), "origin")
    return named.join(of.select(F.col("n").alias("id"), F.col("id").alias("artifact")), "id").select("asset", "artifact", "hops")
