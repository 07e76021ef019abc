"""Joins between the parts of a graph: contracts, path containment, merging, licenses and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import depth, namespaced
from ..functions.vocab import ARTIFACT_TYPES
from ..session import cut, release
from .project import ancestors, slashes
from .skew import split_lookup


def ranked(df: DataFrame, key: str, order: str, name: str = "k") -> DataFrame:
    """``df`` with the rank (from 1) of each row within its key, also if one key holds most rows.

    Rows are put in ranges of (key, order), so a hot key spans many tasks; a row's rank is its place
    within its range plus the rows of its key in the ranges before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, key, order).withColumn("__p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__p", key).orderBy(order))
    counts = placed.groupBy("__p", key).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", key, before.alias("__o"))
    return placed.withColumn("__i", inside).join(offsets, ["__p", key]).withColumn(name, F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")


def match_contracts(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """The k-th consumer of each artifact name meets its k-th provider, by ``seq``.

    Both have ``seq, artifact, artifact_name, confidence``. The stronger confidence is kept; the
    result is ``artifact_name, provider, consumer, confidence``. Null names match nothing.
    """
    p = ranked(providers.filter("artifact_name is not null"), "artifact_name", "seq").select("artifact_name", "k", F.col("artifact").alias("provider"), F.col("confidence").alias("pc"))
    c = ranked(consumers.filter("artifact_name is not null"), "artifact_name", "seq").select("artifact_name", "k", F.col("artifact").alias("consumer"), F.col("confidence").alias("cc"))
    return p.join(c, ["artifact_name", "k"]).select("artifact_name", "provider", "consumer", F.greatest("pc", "cc").alias("confidence"))


def contract_edges(matches: DataFrame) -> DataFrame:
    """Each consumer depends on its provider."""
    return matches.select(F.col("consumer").alias("source"), F.col("provider").alias("target"), F.lit("depends_on").alias("kind"), F.lit("build_contract").alias("derived_from"), "confidence")


def native_implementations(contracts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each implementation file of a contract implements each of its interface files, if both are nodes."""
    pairs = contracts.select(F.explode("impl_files").alias("source"), "interface_files").select("source", F.explode("interface_files").alias("target")).distinct()
    ids = nodes.select("id")
    known = pairs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return known.withColumn("kind", F.lit("implements_native"))


def _placed(graph: str, path: Column) -> Column:
    """A path within its graph, as one key."""
    return F.concat_ws("\x00", graph, path)


def module_members(nodes: DataFrame, modules: tuple[str, ...], files: tuple[str, ...], rooted: bool = False, hot_share: float = 0.01) -> DataFrame:
    """``module, file``: every file in or below the directory of a module of its graph; with ``rooted`` also below one of its source roots.

    The graph is part of the key, so equal paths of two checkouts don't mix; nodes without graph hold nothing. Files meet modules through the directories above them, by equality; a directory that holds very
    many files is treated apart.
    """
    owners = nodes.filter(F.col("type").isin(*modules) & (F.col("src_path") != "")).filter("graph_id is not null").select(_placed("graph_id", slashes("src_path")).alias("dir"), F.struct(F.col("id").alias("module"), F.coalesce("source_roots", F.array().cast("array<string>")).alias("roots")).alias("m"))
    per_dir = owners.groupBy("dir").agg(F.collect_set("m").alias("ms"))
    inside = nodes.filter(F.col("type").isin(*files) & F.col("src_path").isNotNull() & F.col("graph_id").isNotNull()).select(F.col("id").alias("file"), "graph_id", slashes("src_path").alias("p"))
    above = inside.select("file", "graph_id", "p", F.explode(ancestors(F.col("p"))).alias("x")).select("file", _placed("graph_id", F.col("p")).alias("p"), _placed("graph_id", F.col("x.dir")).alias("dir"))
    met = split_lookup(above, per_dir, "dir", hot_share, how="inner").select("file", "p", "dir", F.explode("ms").alias("m")).select("m.module", "m.roots", "file", "p", "dir")
    if rooted:
        met = met.filter((F.size("roots") == 0) | F.exists("roots", lambda r: F.startswith(F.col("p"), F.concat("dir", F.lit("/"), r, F.lit("/")))))
    return met.select("module", "file").distinct()


def native_bridges(nodes: DataFrame) -> DataFrame:
    """``module, target``: native directories of modules and directories of build targets of one graph where one holds the other.

    A native directory counts from its module's path. Two equality joins over the directories above
    each side take the place of a join on prefixes.
    """
    native = nodes.filter((F.col("src_path") != "") & (F.size("native_dirs") > 0)).select(F.col("id").alias("module"), "graph_id", F.explode("native_dirs").alias("d"), slashes("src_path").alias("p"))
    native = native.select("module", "graph_id", F.regexp_replace(F.concat("p", F.lit("/"), slashes("d")), "/+$", "").alias("nd")).distinct()
    file = F.regexp_replace(F.split(F.regexp_replace("id", "^//", ""), ":")[0], "/?[^/]*$", "")
    targets = nodes.filter(F.col("type").isin("shared_library", "static_library", "executable", "target") & F.col("id").startswith("//")).select(F.col("id").alias("target"), "graph_id", F.concat(F.lit("/ws/"), file).alias("td"))
    self_and_up = lambda c: F.concat(F.transform(ancestors(F.col(c)), lambda x: x["dir"]), F.array(F.col(c)))
    down = native.select("module", "graph_id", F.explode(self_and_up("nd")).alias("td")).join(targets, ["graph_id", "td"]).select("module", "target")
    up = targets.select("target", "graph_id", F.explode(self_and_up("td")).alias("nd")).join(native, ["graph_id", "nd"]).select("module", "target")
    return down.unionByName(up).distinct()


def workspace_members(roots: DataFrame, dirs: DataFrame) -> DataFrame:
    """``root, dir`` of directories that match a workspace pattern of a root above them.

    ``roots`` have ``root, path, pattern`` (``x/*``: one level, ``x/**``: any); ``dirs`` have ``dir, path``.
    """
    above = dirs.select("dir", F.col("path").alias("p"), F.explode(ancestors(F.col("path"))).alias("x")).select("dir", "p", F.col("x.dir").alias("path"))
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"\*\*", "\x00"), r"\*", "[^/]*"), "\x00", ".*"), F.lit("$"))
    met = roots.join(above, "path").filter(F.regexp(F.substring(F.col("p"), F.length("path") + 2, F.lit(1 << 20)), regex))
    return met.select("root", "dir").distinct()


def packaging(nodes: DataFrame) -> DataFrame:
    """``package, module, package_type``: each packaged module with its package node."""
    rows = nodes.filter(F.col("type").isin("hap", "har", "hsp"))
    return rows.select(F.concat("type", F.lit(":"), F.regexp_replace("id", "^module:", "")).alias("package"), F.col("id").alias("module"), F.col("type").alias("package_type")).distinct()


def unique_namespaces(graphs: DataFrame) -> DataFrame:
    """``graph_id, namespace`` with a hash of the id after names taken by an earlier graph (by id)."""
    first = graphs.groupBy("namespace").agg(F.min("graph_id").alias("first"))
    suffix = F.concat("namespace", F.lit("-"), F.substring(F.sha2("graph_id", 256), 1, 6))
    return split_lookup(graphs, first, "namespace").select("graph_id", F.when(F.col("graph_id") == F.col("first"), F.col("namespace")).otherwise(suffix).alias("namespace"))


def merged_nodes(nodes: DataFrame, namespaces: DataFrame, main: str) -> DataFrame:
    """``id, type, graph_id, orig_id``: nodes of the main graph as they are, those of other graphs under their namespace."""
    known = split_lookup(nodes.filter("graph_id is not null"), namespaces, "graph_id", how="inner")
    moved = F.when(F.col("graph_id") == main, F.col("id")).otherwise(namespaced("id", "namespace"))
    return known.select(moved.alias("id"), "type", "graph_id", F.col("id").alias("orig_id"))


def merged_edges(nodes: DataFrame, edges: DataFrame, namespaces: DataFrame, main: str) -> DataFrame:
    """``source, target, kind, link_class`` of the merged graph, with the ids of :func:`merged_nodes`.

    Edges keep their kind (``local``); each node that stands for another graph depends on that
    graph's roots, which nothing points at (``cross_graph``). Ends that are no node of a merged
    graph stay as they are. Targets are uneven: their lookup treats heavy ones apart.
    """
    new = cut(merged_nodes(nodes, namespaces, main).select("orig_id", F.col("id").alias("new"), "graph_id"))
    ids = new.select("orig_id", "new")
    e = split_lookup(edges.select("source", "target", "kind"), ids.select(F.col("orig_id").alias("target"), F.col("new").alias("t")), "target")
    e = split_lookup(e, ids.select(F.col("orig_id").alias("source"), F.col("new").alias("s")), "source")
    local = e.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "kind", F.lit("local").alias("link_class"))
    roots = new.join(edges.select(F.col("target").alias("orig_id")), "orig_id", "left_anti").select(F.col("graph_id").alias("child_graph_id"), F.col("new").alias("target"))
    proxies = nodes.filter("child_graph_id <> ''").select(F.col("id").alias("orig_id"), "child_graph_id").join(ids, "orig_id", "left").select(F.coalesce("new", "orig_id").alias("source"), "child_graph_id")
    cross = proxies.join(roots, "child_graph_id").select("source", "target", F.lit("depends_on").alias("kind"), F.lit("cross_graph").alias("link_class"))
    return local.unionByName(cross)


def merged_links(nodes: DataFrame, edges: DataFrame, namespaces: DataFrame, main: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of :func:`merged_edges`, those across graphs in two factors: local edges (``src, dst, kind``), heads (``src, via``), tails (``via, dst``).

    A head is a node that stands for the graph ``via``, a tail a root of that graph. There is an edge
    across graphs from each head to each tail of a graph. The pairs grow faster than the tables, the factors don't.
    """
    known = split_lookup(nodes, namespaces, "graph_id")
    moved = F.when(F.col("namespace").isNull() | (F.col("graph_id") == main), F.col("id")).otherwise(namespaced("id", "namespace"))
    new = cut(known.select("id", moved.alias("new"), "graph_id", "child_graph_id", F.col("namespace").isNotNull().alias("merged")))
    ids = new.filter("merged").select("id", "new")
    e = split_lookup(edges.select("source", "target", "kind"), ids.select(F.col("id").alias("target"), F.col("new").alias("t")), "target")
    e = e.join(ids.select(F.col("id").alias("source"), F.col("new").alias("s")), "source", "left")
    local = cut(e.select(F.coalesce("s", "source").alias("src"), F.coalesce("t", "target").alias("dst"), "kind"))
    heads = cut(new.filter("child_graph_id <> ''").select(F.col("new").alias("src"), F.col("child_graph_id").alias("via")).distinct())
    roots = new.filter("merged").join(heads.select(F.col("via").alias("graph_id")).distinct(), "graph_id", "left_semi").join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    tails = cut(roots.select(F.col("graph_id").alias("via"), F.col("new").alias("dst")).distinct())
    release(new)
    return local, heads, tails


def merged_graph(nodes: DataFrame, edges: DataFrame, namespaces: DataFrame, main: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, type, graph_id, orig_id``) and edges of the merged graph; nodes without graph are shared and keep their ids."""
    shared = nodes.filter("graph_id is null").select("id", "type", "graph_id", F.col("id").alias("orig_id"))
    return merged_nodes(nodes, namespaces, main).unionByName(shared), merged_edges(nodes, edges, namespaces, main)


def cross_graph_edges(nodes: DataFrame, edges: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Each node that stands for another graph depends on the roots (nothing points at them) of that graph."""
    roots = nodes.filter("graph_id is not null").select("graph_id", "id").join(edges.select(F.col("target").alias("id")), "id", "left_anti").select(F.col("graph_id").alias("child_graph_id"), F.col("id").alias("root"))
    proxies = nodes.filter("child_graph_id <> ''").select(F.col("id").alias("source"), "child_graph_id")
    named = namespaces.withColumnRenamed("graph_id", "child_graph_id")
    return roots.join(proxies, "child_graph_id").join(named, "child_graph_id").select("source", namespaced("root", "namespace").alias("target"), F.lit("depends_on").alias("kind"), F.lit("cross_graph").alias("link_class"))


def parent_proxies(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``child_graph, parent_graph, proxy``: the nodes of each parent package that stand for the child."""
    proxies = nodes.filter("child_graph_id <> '' and graph_id is not null").select(F.lower("child_graph_id").alias("child_graph"), F.lower("graph_id").alias("parent_graph"), F.col("id").alias("proxy"))
    return links.select(F.col("src").alias("parent_graph"), F.col("dst").alias("child_graph")).join(proxies, ["parent_graph", "child_graph"]).distinct()


def license_coverage(nodes: DataFrame, licenses: DataFrame) -> DataFrame:
    """One row: ``graph_nodes, licensed_nodes, matched, missing_in_graph, missing_license, coverage``; ``licenses(id)``."""
    both = nodes.select("id", F.lit(1).alias("n")).join(licenses.select("id", F.lit(1).alias("l")).distinct(), "id", "full_outer")
    out = both.agg(F.count("n").alias("graph_nodes"), F.count("l").alias("licensed_nodes"), F.count(F.when(F.col("n").isNotNull() & F.col("l").isNotNull(), 1)).alias("matched"))
    return out.select("graph_nodes", "licensed_nodes", "matched", (F.col("licensed_nodes") - F.col("matched")).alias("missing_in_graph"), (F.col("graph_nodes") - F.col("matched")).alias("missing_license"), F.round(F.col("matched") / F.greatest("graph_nodes", F.lit(1)), 6).alias("coverage"))


def license_attachment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``contains`` edges from each root of a graph to each license node of the same graph that lack one.

    The pairs are bounded by roots times licenses of one graph, both few.
    """
    roots = nodes.filter("graph_id is not null").join(edges.select(F.col("target").alias("id")), "id", "left_anti").join(edges.select(F.col("source").alias("id")), "id", "left_semi")
    held = nodes.filter("type = 'license' and graph_id is not null").select("graph_id", F.col("id").alias("target"))
    pairs = roots.select("graph_id", F.col("id").alias("source")).join(held, "graph_id").filter("source <> target")
    return pairs.join(edges.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", F.lit("contains").alias("kind"))


def untracked_files(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``graph_id, id`` of files that no node stands for; ``files(graph_id, id)``."""
    return files.select("graph_id", "id").distinct().join(nodes.select("id"), "id", "left_anti")


def best_license_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``graph_id, id, score``: the node of each graph that a package's license belongs on.

    ``wanted`` has ``graph_id, name, version``. A match of the name counts 3, of the version 2, a
    package-like type 1; without a match there is none. Shallower, then shorter ids win.
    """
    has = lambda c: F.contains(F.lower("id"), F.lower(c)) | (F.lower(F.coalesce("node_name", F.lit(""))) == F.lower(c))
    rows = nodes.filter("graph_id is not null").select("graph_id", "id", "type", F.col("name").alias("node_name")).join(wanted, "graph_id")
    name = F.coalesce((F.col("name") != "") & has(F.col("name")), F.lit(False))
    version = F.coalesce((F.col("version") != "") & has(F.col("version")), F.lit(False))
    kind = F.col("type").isin("module", "external_dep", "external_library", "hap", "har", "hsp")
    score = F.when(name, 3).otherwise(0) + F.when(version, 2).otherwise(0) + F.when(kind, 1).otherwise(0)
    best = F.max(F.struct(score.alias("score"), (-depth("id")).alias("d"), (-F.length("id")).alias("l"), F.col("id").alias("id"))).alias("b")
    return rows.filter(name | version).groupBy("graph_id").agg(best).select("graph_id", "b.id", "b.score")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """``file, include, target``: each include beside its file, else under the repository's include directory, else a placeholder.

    ``includes(file, include)`` and ``files(id)`` hold path ids; candidates are met by equality, the
    first that is a file wins.
    """
    here = F.regexp_replace("file", "/[^/]*$", "")
    top = F.regexp_extract("file", "^(//[^/]+)/", 1)
    spots = F.array(F.concat(here, F.lit("/"), "include"), F.concat(top, F.lit("/include/"), "include"), F.concat(top, F.lit("/"), "include"))
    tries = includes.select("file", "include", F.posexplode(spots).alias("rank", "id"))
    hit = tries.join(files.select("id").distinct(), "id").groupBy("file", "include").agg(F.min_by("id", "rank").alias("target"))
    return includes.join(hit, ["file", "include"], "left").select("file", "include", F.coalesce("target", F.concat(F.lit("//include:"), "include")).alias("target"))


def resolve_modules(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ets", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".json")) -> DataFrame:
    """``file, module, target``: relative imports as files, by extension or an index file; null if there is none."""
    here = F.split(F.regexp_replace("file", "/[^/]*$", ""), "/")
    steps = F.split("module", "/")
    # parts of the path so far; '..' drops the last one
    walk = F.aggregate(steps, here, lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s))))
    base = F.array_join(walk, "/")
    ends = ["", *extensions, *[f"/index{e}" for e in extensions]]
    relative = imports.filter(F.col("module").startswith("."))
    tries = relative.select("file", "module", F.posexplode(F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(base, e))).alias("rank", "id"))
    hit = tries.join(files.select("id").distinct(), "id").groupBy("file", "module").agg(F.min_by("id", "rank").alias("target"))
    return relative.join(hit, ["file", "module"], "left").select("file", "module", "target")


def resolve_packages(names: DataFrame, packages: DataFrame) -> DataFrame:
    """``module, id``: a package node by the whole name, the name without ``@``, or its first part; the first by ``seq``.

    ``packages`` have ``name, id, seq``.
    """
    index = packages.groupBy("name").agg(F.min_by("id", "seq").alias("id"))
    keys = F.array(F.col("module"), F.regexp_replace("module", "^@", ""), F.split("module", "/")[0])
    tries = names.select("module").distinct().select("module", F.posexplode(keys).alias("rank", "name"))
    return tries.join(index, "name").groupBy("module").agg(F.min_by("id", "rank").alias("id"))


def resolve_versions(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``name, spec, version``: the version of each asked range.

    ``asked`` has ``name, spec``, ``known`` has ``name, version``. An exact version wins, then the
    greatest within the range, then the greatest of all; null if the name isn't known.
    """
    from ..functions.names import release, version_bounds

    b = version_bounds("spec")
    pairs = asked.select("name", "spec").distinct().withColumn("b", b).join(known.select("name", "version").distinct(), "name", "left").withColumn("r", release("version"))
    inside = (F.col("b.low").isNull() | (F.col("r") >= F.col("b.low"))) & (F.col("b.high").isNull() | (F.col("r") < F.col("b.high"))) & (~F.col("b.exact") | (F.col("spec") == F.col("version")))
    rank = F.when(F.col("version") == F.col("spec"), 2).when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return pairs.groupBy("name", "spec").agg(F.max_by("version", F.struct(rank, "r", "version")).alias("version"))


def entry_points(nodes: DataFrame, mains: DataFrame) -> DataFrame:
    """``module, file``: the file each module names as its entry; ``mains(module, path)``, the first node by ``seq`` of a path."""
    by_path = nodes.filter("src_path is not null").groupBy(slashes("src_path").alias("path")).agg(F.min_by("id", "seq").alias("file"))
    return mains.select("module", slashes("path").alias("path")).join(by_path, "path").select("module", "file")


def dependency_specs(nodes: DataFrame) -> DataFrame:
    """``name, version, nodes, first_node``: distinct dependencies of external-library nodes with where they come from."""
    rows = nodes.filter(F.col("type").isin("external_library", "external_dep")).select("id", "seq", F.regexp_replace("id", "^ext_lib:", "").alias("s"))
    at = F.length("s") - F.length(F.substring_index("s", "@", -1)) - 1
    named = rows.select("id", "seq", F.when(at > 0, F.substring("s", 1, at)).otherwise(F.col("s")).alias("name"), F.when(at > 0, F.substring_index("s", "@", -1)).alias("version"))
    return named.groupBy("name", "version").agg(F.count(F.lit(1)).alias("nodes"), F.min_by("id", "seq").alias("first_node"))


def first_by_path(nodes: DataFrame) -> DataFrame:
    """``graph_id, path, id``: of the nodes of one path in one graph the first by ``seq``."""
    return nodes.filter("src_path is not null").groupBy("graph_id", slashes("src_path").alias("path")).agg(F.min_by("id", "seq").alias("id"))


def merged_attributes(rows: DataFrame, key: str, order: str, lists: tuple[str, ...], scalars: tuple[str, ...], flags: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: lists are united (sorted), of scalars the last that isn't null counts, flags stay set."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in scalars]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def fan_out(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """``module, target``: dependencies of a repository go to all its modules; both have ``repo``."""
    return dependencies.join(modules, "repo").select("module", "target").distinct()


def native_consumers(libraries: DataFrame) -> DataFrame:
    """``consumer, artifact_name`` of ``libraries(file, library)``: code that loads a native library asks for its artifact."""
    return libraries.select(F.col("file").alias("consumer"), F.concat(F.lit("lib"), "library", F.lit(".so")).alias("artifact_name")).distinct()


def attach_resolved(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes with the graph and path of their resolved dependency; ``resolved(id, child_graph_id, resolved_path)``."""
    new = resolved.select("id", F.col("child_graph_id").alias("__g"), "resolved_path")
    return nodes.join(new, "id", "left").withColumn("child_graph_id", F.coalesce("child_graph_id", "__g")).drop("__g")


def import_edges(imports: DataFrame, kind: str = "import", placeholder: str = "//external:") -> DataFrame:
    """``source, target, kind, confidence``: what a file imports as edges; ``imports(file, module, target)``.

    A module that is no file becomes a placeholder, of half the confidence. Repeated imports give one edge.
    """
    known = F.col("target").isNotNull()
    return imports.select(F.col("file").alias("source"), F.when(known, F.col("target")).otherwise(F.concat(F.lit(placeholder), "module")).alias("target"), F.lit(kind).alias("kind"), F.when(known, 1.0).otherwise(0.5).alias("confidence")).distinct()


def file_completeness(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, type, name, graph_id``) and ``contains`` edges for files that no node stands for; ``files(graph_id, id)``.

    A file hangs on the nearest node above it, its directory by equality of ids; without one it stays a root.
    """
    new = cut(untracked_files(files, nodes).filter("id is not null"))
    name = F.substring_index("id", "/", -1)
    kind = F.when(F.lower(name).rlike(r"\.(c|cc|cpp|cxx|java|js|ts|ets|py)$"), "code").when(F.lower(name).rlike(r"\.(h|hh|hpp|hxx)$"), "project_header").when(F.lower(name).rlike(r"\.(json|json5|xml|txt|cmake)$"), "config").when(name.rlike("^(?i:licen[sc]e|copying)"), "license").otherwise("asset")
    made = new.select("id", kind.alias("type"), name.alias("name"), "graph_id")
    above = new.select("id", F.explode(ancestors(F.col("id"))).alias("x")).select("id", "x.depth", F.col("x.dir").alias("up"))
    best = above.join(nodes.select(F.col("id").alias("up")), "up").groupBy("id").agg(F.max_by("up", "depth").alias("source"))
    return made, best.select("source", F.col("id").alias("target"), F.lit("contains").alias("kind"))
