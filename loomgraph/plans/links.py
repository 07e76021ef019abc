"""Queries of the linking, naming and text operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph as G
from ..functions import names as N
from ..operators import build, project, reach
from ..operators import linking as L
from ..session import cut, release
from ..sources import graphfiles, manifests
from ..tables import read
from .graphs import _KEY, EDGES, NODES, graph, packages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_graph: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{NODES}, {EDGES}" + ("" if sql.lstrip().upper().startswith("SELECT") else ",") + f" {sql}") if with_graph else sql
        return f

    return add


# --- contracts -----------------------------------------------------------------------------

_CON = """WITH p AS (SELECT 's' || lpad(s_suppkey::VARCHAR, 9, '0') AS seq, '//lib/s' || s_suppkey AS artifact, 'lib' || s_nationkey || '.so' AS artifact_name, 0.9::DOUBLE AS confidence FROM supplier),
 c AS (SELECT 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS seq, '//app/c' || c_custkey AS artifact, 'lib' || c_nationkey || '.so' AS artifact_name, 0.0::DOUBLE AS confidence FROM customer),
 m AS (SELECT p.artifact_name, p.artifact AS provider, c.artifact AS consumer, greatest(p.confidence, c.confidence) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY artifact_name ORDER BY seq) k FROM p) p JOIN (SELECT *, row_number() OVER (PARTITION BY artifact_name ORDER BY seq) k FROM c) c USING (artifact_name, k))"""


def _contracts(spark, d):
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    make = lambda df, tag, key, nation, node, conf: df.select(F.concat(F.lit(tag), F.lpad(F.col(key).cast("string"), 9, "0")).alias("seq"), F.concat(F.lit(node), key).alias("artifact"), F.concat(F.lit("lib"), nation, F.lit(".so")).alias("artifact_name"), F.lit(conf).alias("confidence"))
    return make(s, "s", "s_suppkey", "s_nationkey", "//lib/s", 0.9), make(c, "c", "c_custkey", "c_nationkey", "//app/c", 0.0)


@query(f"{_CON} SELECT artifact_name, provider, consumer, confidence FROM m", False)
def contract_matches(spark: SparkSession, d: str) -> DataFrame:
    return L.match_contracts(*_contracts(spark, d))


@query(f"{_CON} SELECT consumer AS source, provider AS target, 'depends_on' AS kind, 'build_contract' AS derived_from, confidence FROM m", False)
def contract_edges(spark: SparkSession, d: str) -> DataFrame:
    return L.contract_edges(L.match_contracts(*_contracts(spark, d)))


@query(f"{_CON} SELECT artifact_name, (SELECT count(*) FROM p WHERE p.artifact_name = a.artifact_name) AS providers, count(*) AS consumers, (SELECT count(*) FROM m WHERE m.artifact_name = a.artifact_name) AS complete FROM c a GROUP BY artifact_name", False)
def contract_statistics(spark: SparkSession, d: str) -> DataFrame:
    p, c = _contracts(spark, d)
    n = lambda df, name: df.groupBy("artifact_name").agg(F.count(F.lit(1)).alias(name))
    both = n(c, "consumers").join(n(p, "providers"), "artifact_name", "left")
    return both.select("artifact_name", F.coalesce("providers", F.lit(0)).alias("providers"), "consumers", F.least(F.coalesce("providers", F.lit(0)), "consumers").alias("complete"))


# --- containment ---------------------------------------------------------------------------


@query(" SELECT DISTINCT m.id AS module, f.id AS file FROM g_nodes m JOIN g_nodes f ON m.graph_id = f.graph_id AND starts_with(replace(f.src_path, chr(92), '/'), replace(m.src_path, chr(92), '/') || '/') WHERE m.type IN ('module', 'hap', 'har', 'hsp') AND m.src_path <> '' AND f.type IN ('code', 'project_header')")
def module_members(spark: SparkSession, d: str) -> DataFrame:
    return L.module_members(graph(spark, d).nodes, ("module", "hap", "har", "hsp"), ("code", "project_header"))


@query(
    " SELECT DISTINCT m.id AS module, f.id AS file FROM g_nodes m JOIN g_nodes f ON m.graph_id = f.graph_id AND starts_with(replace(f.src_path, chr(92), '/'), replace(m.src_path, chr(92), '/') || '/') WHERE m.type IN ('module', 'executable') AND m.src_path <> '' AND f.type = 'code'"
    " AND (coalesce(len(m.source_roots), 0) = 0 OR len(list_filter(m.source_roots, lambda r: starts_with(replace(f.src_path, chr(92), '/'), replace(m.src_path, chr(92), '/') || '/' || r || '/'))) > 0)"
)
def module_source_members(spark: SparkSession, d: str) -> DataFrame:
    return L.module_members(graph(spark, d).nodes, ("module", "executable"), ("code",), rooted=True)


@query(
    """ nd AS (SELECT DISTINCT id AS module, graph_id, regexp_replace(replace(src_path, chr(92), '/') || '/' || replace(d, chr(92), '/'), '/+$', '') AS nd FROM (SELECT id, graph_id, src_path, unnest(native_dirs) AS d FROM g_nodes WHERE src_path <> '')),
 td AS (SELECT id AS target, graph_id, '/ws/' || regexp_replace(string_split(regexp_replace(id, '^//', ''), ':')[1], '/?[^/]*$', '') AS td FROM g_nodes WHERE type IN ('shared_library', 'static_library', 'executable', 'target') AND starts_with(id, '//'))
 SELECT DISTINCT module, target FROM nd JOIN td ON nd.graph_id = td.graph_id AND (nd = td OR starts_with(nd, td || '/') OR starts_with(td, nd || '/'))"""
)
def native_bridges(spark: SparkSession, d: str) -> DataFrame:
    return L.native_bridges(graph(spark, d).nodes)


@query(
    """ SELECT DISTINCT m.id AS root, s.id AS dir FROM g_nodes m JOIN g_nodes s ON s.type = 'subdirectory' AND starts_with(s.src_path, m.src_path || '/') AND regexp_matches(substr(s.src_path, length(m.src_path) + 2), '^(src/[^/]*|third_party/.*)$') WHERE m.type = 'module' AND m.src_path <> ''"""
)
def workspace_members(spark: SparkSession, d: str) -> DataFrame:
    n = graph(spark, d).nodes
    roots = n.filter("type = 'module' and src_path <> ''").select(F.col("id").alias("root"), F.col("src_path").alias("path"), F.explode(F.array(F.lit("src/*"), F.lit("third_party/**"))).alias("pattern"))
    return L.workspace_members(roots, n.filter("type = 'subdirectory' and src_path is not null").select(F.col("id").alias("dir"), F.col("src_path").alias("path")))


@query(" SELECT type || ':' || regexp_replace(id, '^module:', '') AS package, id AS module, type AS package_type FROM g_nodes WHERE type IN ('hap', 'har', 'hsp')")
def packaging(spark: SparkSession, d: str) -> DataFrame:
    return L.packaging(graph(spark, d).nodes)


# --- merging -------------------------------------------------------------------------------

_NSQ = r"""ns0 AS (SELECT graph_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(min(regexp_extract(id, '^//([^/]+)/', 1)), ''), '[\\/: _]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'anon') AS namespace FROM g_nodes WHERE graph_id IS NOT NULL AND regexp_extract(id, '^//([^/:]+)/', 1) <> '' GROUP BY graph_id),
 ns AS (SELECT graph_id, CASE WHEN graph_id = min(graph_id) OVER (PARTITION BY namespace) THEN namespace ELSE namespace || '-' || substr(sha256(graph_id), 1, 6) END AS namespace FROM ns0)"""
_PREF = "'//dep/' || namespace || '/' || replace(regexp_replace({c}, '^/+', ''), ':', '/')"


def _namespaces(nodes: DataFrame) -> DataFrame:
    top = F.regexp_extract("id", "^//([^/:]+)/", 1)
    named = nodes.filter("graph_id is not null").filter(top != "").groupBy("graph_id").agg(F.min(F.regexp_extract("id", "^//([^/]+)/", 1)).alias("t"))
    return L.unique_namespaces(named.select("graph_id", F.when(N.fragment("t") != "", N.fragment("t")).otherwise("anon").alias("namespace")))


@query(f" {_NSQ} SELECT graph_id, namespace FROM ns")
def graph_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return _namespaces(graph(spark, d).nodes)


@query(f" {_NSQ} SELECT CASE WHEN graph_id = (SELECT min(graph_id) FROM ns) THEN id ELSE {_PREF.format(c='id')} END AS id, type, graph_id, id AS orig_id FROM g_nodes JOIN ns USING (graph_id)")
def merged_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = graph(spark, d).nodes
    spaces = _namespaces(n)
    main = spaces.agg(F.min("graph_id").alias("g")).first().g
    return L.merged_nodes(n, spaces, main or "")


@query(f" {_NSQ} SELECT p.id AS source, {_PREF.format(c='r.id')} AS target, 'depends_on' AS kind, 'cross_graph' AS link_class FROM g_nodes p JOIN g_nodes r ON r.graph_id = p.child_graph_id JOIN ns ON ns.graph_id = p.child_graph_id WHERE p.child_graph_id <> '' AND r.id NOT IN (SELECT target FROM g_edges)")
def cross_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return L.cross_graph_edges(g.nodes, g.edges, _namespaces(g.nodes))


_MERGED = f""" {_NSQ}, mg AS (SELECT CASE WHEN graph_id = (SELECT min(graph_id) FROM ns) THEN id ELSE {_PREF.format(c='id')} END AS new, id, type, graph_id FROM g_nodes JOIN ns USING (graph_id)),
 m_nodes AS (SELECT new AS id, type, graph_id FROM mg UNION ALL SELECT id, type, graph_id FROM g_nodes WHERE graph_id IS NULL),
 m_edges AS (SELECT coalesce(s.new, e.source) AS source, coalesce(t.new, e.target) AS target, kind, 'local' AS link_class FROM g_edges e LEFT JOIN mg s ON s.id = e.source LEFT JOIN mg t ON t.id = e.target
  UNION ALL SELECT coalesce(q.new, p.id), r.new, 'depends_on', 'cross_graph' FROM g_nodes p LEFT JOIN mg q ON q.id = p.id JOIN mg r ON r.graph_id = p.child_graph_id WHERE p.child_graph_id <> '' AND r.id NOT IN (SELECT target FROM g_edges))"""


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = graph(spark, d)
    spaces = cut(_namespaces(g.nodes))
    main = spaces.agg(F.min("graph_id").alias("g")).first().g
    return L.merged_graph(g.nodes, g.edges, spaces, main or "")


@query(f"{_MERGED} SELECT source, target, kind, link_class FROM m_edges")
def merged_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge of the merged graph between rewritten ids, those across graphs among them."""
    return _merged(spark, d)[1]


@query(
    f"{_MERGED}, al(id) AS (SELECT id FROM m_nodes WHERE type IN ('hap', 'har', 'hsp', 'executable') UNION SELECT b FROM al JOIN (SELECT source AS a, target AS b FROM m_edges UNION ALL SELECT target, source FROM m_edges WHERE kind = 'contains') x ON x.a = al.id)"
    " SELECT DISTINCT id, type FROM m_nodes WHERE id NOT IN (SELECT id FROM al)",
    recursive=True,
)
def merged_dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the merged graph that no entry point of any graph reaches."""
    nodes, edges = _merged(spark, d)
    return project.dead_code(nodes, cut(edges)).select("id", "type").distinct()


@query()
def merged_acyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    """The merged graph with each strong component hung under a cluster, as an export writes it.

    The edges across graphs stay in two factors up to the result. Rows are built without the fields that come after
    the last one needed: the first row of an id or of a ``seq`` is told by its fields in order.
    """
    without = lambda rows, fields: rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in fields})
    nodes, edges = read(spark, d, "nodes"), read(spark, d, "edges")
    nodes = cut(G.upsert_nodes(without(nodes, G.NODE_FIELDS[G.NODE_FIELDS.index("child_graph_id") + 1 :])).select("id", "graph_id", "child_graph_id"))
    edges = cut(G.append_edges(without(edges.repartition("seq"), ("parser_name", "confidence", "derived_from"))).select("source", "target", "kind"))
    spaces = cut(_namespaces(nodes))
    main = spaces.agg(F.min("graph_id").alias("g")).first().g
    local, heads, tails = L.merged_links(nodes, edges, spaces, main or "")
    release(nodes, edges, spaces)
    whole = reach.break_factored_cycles(local, heads, tails, "depends_on")
    release(local, heads, tails)
    return whole


@query(f"{_MERGED} SELECT coalesce(graph_id, '') AS graph_id, type, count(*) AS nodes FROM m_nodes GROUP BY ALL")
def export_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of an export of the merged graph: its nodes by graph and type."""
    return _merged(spark, d)[0].groupBy(F.coalesce("graph_id", F.lit("")).alias("graph_id"), "type").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    r""" pk AS (SELECT DISTINCT lower(trim(parent_id)) AS src, lower(trim(child_id)) AS dst FROM dag_edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL)
 SELECT DISTINCT dst AS child_graph, src AS parent_graph, id AS proxy FROM pk JOIN g_nodes ON lower(graph_id) = src AND lower(child_graph_id) = dst"""
)
def parent_proxies(spark: SparkSession, d: str) -> DataFrame:
    return L.parent_proxies(graph(spark, d).nodes, packages(spark, d))


@query(" SELECT 'main' AS part, id, id AS orig_id FROM g_nodes WHERE graph_id IS NULL UNION ALL SELECT 'dep', 'dep:' || graph_id || ':' || id, id FROM g_nodes WHERE graph_id IS NOT NULL")
def composite_view(spark: SparkSession, d: str) -> DataFrame:
    """A lazy union of the shared nodes and every graph's nodes under a prefix."""
    n = graph(spark, d).nodes
    main = n.filter("graph_id is null").select(F.lit("main").alias("part"), "id", F.col("id").alias("orig_id"))
    deps = n.filter("graph_id is not null").select(F.lit("dep").alias("part"), F.concat(F.lit("dep:"), "graph_id", F.lit(":"), "id").alias("id"), F.col("id").alias("orig_id"))
    return main.unionByName(deps)


# --- licenses and files --------------------------------------------------------------------

_LIC = "lic AS (SELECT " + _KEY.format(c="node_id") + " AS id, trim(spdx) AS spdx FROM licenses WHERE node_id IS NOT NULL AND trim(coalesce(spdx, '')) <> '')"


def _licenses(spark, d):
    rows = read(spark, d, "licenses").select(G.canonical_id("node_id").alias("id"), F.trim("spdx").alias("spdx"))
    return rows.filter("id is not null and coalesce(spdx, '') <> ''")


@query(f" {_LIC} SELECT DISTINCT lic.id, spdx FROM lic WHERE lic.id IN (SELECT id FROM g_nodes)")
def license_map(spark: SparkSession, d: str) -> DataFrame:
    """Map entries of known nodes."""
    return _licenses(spark, d).join(graph(spark, d).nodes.select("id"), "id", "left_semi").distinct()


@query(f""" {_LIC}, l AS (SELECT DISTINCT id FROM lic), c AS (SELECT (SELECT count(*) FROM g_nodes) AS n, (SELECT count(*) FROM l) AS k, (SELECT count(*) FROM l WHERE id IN (SELECT id FROM g_nodes)) AS m)
 SELECT n AS graph_nodes, k AS licensed_nodes, m AS matched, k - m AS missing_in_graph, n - m AS missing_license, round(m / greatest(n, 1), 6) AS coverage FROM c""")
def license_alignment(spark: SparkSession, d: str) -> DataFrame:
    return L.license_coverage(graph(spark, d).nodes, _licenses(spark, d))


@query(
    r"""SELECT DISTINCT spdx AS raw, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(spdx, '([()])', ' \1 ', 'g'), '\s+'), lambda w: w <> ''), lambda w: CASE WHEN upper(w) IN ('AND', 'OR', 'WITH') THEN upper(w) ELSE w END), ' ') AS spdx FROM licenses WHERE spdx IS NOT NULL""",
    False,
)
def spdx_expressions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "licenses").filter("spdx is not null").select(F.col("spdx").alias("raw"), N.spdx_case("spdx").alias("spdx")).distinct()


@query(" SELECT DISTINCT r.id AS source, l.id AS target, 'contains' AS kind FROM g_nodes r JOIN g_nodes l ON l.graph_id = r.graph_id AND l.type = 'license' AND l.id <> r.id WHERE r.id NOT IN (SELECT target FROM g_edges) AND r.id IN (SELECT source FROM g_edges) AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.source = r.id AND e.target = l.id)")
def license_attachment(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return L.license_attachment(g.nodes, g.edges)


_SEEN = f"seen AS (SELECT graph_id, {_KEY.format(c='path')} AS id FROM files WHERE path IS NOT NULL UNION SELECT NULL, {_KEY.format(c='node_id')} FROM licenses WHERE node_id IS NOT NULL)"


def _seen_files(spark: SparkSession, d: str) -> DataFrame:
    """``graph_id, id`` of all files that the scan or the license scanner has met."""
    f = read(spark, d, "files").filter("path is not null").select("graph_id", G.canonical_id("path").alias("id"))
    return f.unionByName(read(spark, d, "licenses").filter("node_id is not null").select(F.lit(None).cast("string").alias("graph_id"), G.canonical_id("node_id").alias("id")))


@query(f" {_SEEN} SELECT DISTINCT graph_id, id FROM seen WHERE id NOT IN (SELECT id FROM g_nodes)")
def untracked_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that a scanner has met and no node stands for."""
    return L.untracked_files(_seen_files(spark, d), graph(spark, d).nodes)


@query()
def completed_files(spark: SparkSession, d: str) -> DataFrame:
    """The nodes made for files that no node stands for, with the node that holds each."""
    made, held = L.file_completeness(_seen_files(spark, d), graph(spark, d).nodes)
    return made.join(held.select(F.col("target").alias("id"), F.col("source").alias("holder")), "id", "left")


@query(
    r""" w AS (SELECT DISTINCT graph_id, lower(regexp_extract(path, '^//([^/]+)/', 1)) AS name FROM files WHERE graph_id IS NOT NULL AND path IS NOT NULL),
 sc AS (SELECT n.graph_id, n.id, 3 + CASE WHEN n.type IN ('module', 'external_dep', 'external_library', 'hap', 'har', 'hsp') THEN 1 ELSE 0 END AS score FROM g_nodes n JOIN w USING (graph_id) WHERE w.name <> '' AND (contains(lower(n.id), w.name) OR lower(coalesce(n.name, '')) = w.name))
 SELECT graph_id, id, CAST(score AS INTEGER) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, len(list_filter(string_split(id, '/'), lambda p: p <> '')), length(id), id DESC) = 1"""
)
def license_nodes(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "files").filter("graph_id is not null and path is not null").select("graph_id", F.lower(F.regexp_extract("path", "^//([^/]+)/", 1)).alias("name"), F.lit("").alias("version")).distinct()
    return L.best_license_node(graph(spark, d).nodes, wanted)


# --- names ---------------------------------------------------------------------------------


@query(
    r""" b AS (SELECT id, trim(id) AS v, replace(regexp_replace(trim(id), '^/+', ''), chr(92), '/') AS body FROM g_nodes)
 SELECT id, CASE WHEN v = '' THEN v WHEN regexp_matches(body, '^(system|external|include|proxy):') THEN '//' || body ELSE '//' || array_to_string(list_filter(flatten(list_transform(string_split(body, '/'), lambda s: CASE WHEN starts_with(s, '@') THEN [s] ELSE string_split(s, ':') END)), lambda p: p <> ''), '/') END AS export_id FROM b"""
)
def export_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.select("id", N.export_id("id").alias("export_id"))


@query(r" SELECT id, CAST(len(list_filter(string_split(id, '/'), lambda p: p <> '')) AS INTEGER) AS depth, CASE WHEN regexp_matches(regexp_replace(id, '/[^/]*$', ''), '^//[^/]') THEN regexp_replace(id, '/[^/]*$', '') END AS parent_id FROM g_nodes")
def id_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.select("id", N.depth("id").alias("depth"), N.parent_id("id").alias("parent_id"))


@query(
    r""" SELECT DISTINCT src_path, CASE WHEN src_path = '/ws' THEN '//' WHEN starts_with(src_path, '/ws/') THEN '//' || substr(src_path, 5) ELSE '//external/' || substr(sha256(src_path), 1, 8) || '/' || regexp_extract(src_path, '[^/]*$') END AS id FROM (SELECT replace(src_path, chr(92), '/') AS src_path FROM g_nodes WHERE src_path IS NOT NULL)"""
)
def workspace_ids(spark: SparkSession, d: str) -> DataFrame:
    paths = graph(spark, d).nodes.filter("src_path is not null").select(F.replace("src_path", F.lit("\\"), F.lit("/")).alias("src_path")).distinct()
    return paths.select("src_path", N.workspace_id("src_path", "/ws").alias("id"))


# --- code ----------------------------------------------------------------------------------

_CODE = "f AS (SELECT DISTINCT " + _KEY.format(c="path") + " AS file, content FROM files WHERE path IS NOT NULL AND content IS NOT NULL AND regexp_matches(path, 'EXT'))"


def _code(spark, d, ext):
    return read(spark, d, "files").filter(F.col("path").isNotNull() & F.col("content").isNotNull() & F.col("path").rlike(ext)).select(G.canonical_id("path").alias("file"), "content").distinct()


_C, _JS, _JAVA, _ETS = r"\.(c|cc|cpp|h)$", r"\.(js|ts)$", r"\.java$", r"\.ets$"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The rules of the scanner: tokens without comments, then what stands before a quoted text or after a word.
_TS = f"ts AS (SELECT file, list_filter(regexp_extract_all(content, {_quoted(N.TOKENS)}), lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*')) AS t FROM f), tk AS (SELECT file, t, unnest(range(1, len(t) + 1)) AS i FROM ts)"
_MODULES = (
    _TS + ", i AS (SELECT DISTINCT file, substr(t[i], 2, length(t[i]) - 2) AS module FROM tk WHERE t[i][1] IN (chr(39), chr(34)) AND length(t[i]) > 2"
    " AND ((i > 1 AND t[i - 1] IN ('from', 'import') AND (i < 3 OR t[i - 2] <> '.')) OR (i > 2 AND t[i - 1] = '(' AND t[i - 2] IN ('require', 'import') AND (i < 4 OR t[i - 3] <> '.'))))"
)
_STATED = (
    _TS + ", st AS (SELECT file, i, t[i] AS w, t[i + 1:] AS r FROM tk WHERE t[i] IN ('import', 'package') AND (i = 1 OR t[i - 1] IN (';', '}'))),"
    " sm AS (SELECT file, i, w, array_to_string(CASE WHEN r[1] = 'static' THEN r[2:list_position(r, ';') - 1] ELSE r[1:list_position(r, ';') - 1] END, '') AS name FROM st WHERE list_contains(r, ';'))"
)
_INCLUDED = (
    f"list_transform(list_filter(regexp_extract_all(content, {_quoted(N.C_PIECES)}), lambda x: starts_with(x, '#')),"
    """ lambda x: regexp_replace(regexp_replace(x, '^[^<"]*[<"]', ''), '[>"]$', ''))"""
)
_INC = f"i AS (SELECT DISTINCT file, include FROM (SELECT file, unnest({_INCLUDED}) AS include FROM f) WHERE include <> '')"


@query(f"WITH {_CODE.replace('EXT', _C)}, {_INC} SELECT file, include FROM i", False)
def include_lines(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d, _C).select("file", F.explode(N.c_includes("content")).alias("include"))


@query(
    f"WITH {_CODE.replace('EXT', _JS)}, {_MODULES} SELECT file, module, CASE WHEN starts_with(module, '.') OR starts_with(module, '/') THEN 'relative' WHEN string_split(regexp_replace(module, '^node:', ''), '/')[1] IN {str(N.RUNTIME_MODULES)} THEN 'builtin' ELSE 'package' END AS class,"
    " CASE WHEN starts_with(module, '@') AND len(string_split(module, '/')) > 1 THEN string_split(module, '/')[1] || '/' || string_split(module, '/')[2] ELSE string_split(module, '/')[1] END AS package FROM i",
    False,
)
def js_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = _code(spark, d, _JS).select("file", F.explode(N.js_imports("content")).alias("module"))
    return rows.select("file", "module", N.import_class("module").alias("class"), N.package_of("module").alias("package"))


@query(f"WITH {_CODE.replace('EXT', _JAVA)}, {_STATED} SELECT DISTINCT file, (SELECT arg_min(name, i) FROM sm p WHERE p.file = sm.file AND p.w = 'package') AS package, name AS imported FROM sm WHERE w = 'import'", False)
def java_imports(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d, _JAVA).select("file", N.java_package("content").alias("package"), F.explode(N.java_imports("content")).alias("imported"))


@query(f"WITH {_CODE.replace('EXT', _ETS)}, {_MODULES} SELECT file, module FROM i WHERE NOT starts_with(module, '@ohos')", False)
def ets_imports(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d, _ETS).select("file", F.explode(N.ets_imports("content")).alias("module"))


@query(
    f"""WITH {_CODE.replace('EXT', _C)}, {_INC}, a AS (SELECT DISTINCT {_KEY.format(c='path')} AS id FROM files WHERE path IS NOT NULL),
 t AS (SELECT file, include, 0 AS r, regexp_replace(file, '/[^/]*$', '') || '/' || include AS id FROM i UNION ALL SELECT file, include, 1, regexp_extract(file, '^(//[^/]+)/', 1) || '/include/' || include FROM i UNION ALL SELECT file, include, 2, regexp_extract(file, '^(//[^/]+)/', 1) || '/' || include FROM i)
 SELECT i.file, i.include, coalesce((SELECT arg_min(t.id, t.r) FROM t WHERE t.file = i.file AND t.include = i.include AND t.id IN (SELECT id FROM a)), '//include:' || i.include) AS target FROM i""",
    False,
)
def resolved_includes(spark: SparkSession, d: str) -> DataFrame:
    every = read(spark, d, "files").filter("path is not null").select(G.canonical_id("path").alias("id"))
    return L.resolve_includes(include_lines(spark, d), every)


@query()
def resolved_modules(spark: SparkSession, d: str) -> DataFrame:
    every = read(spark, d, "files").filter("path is not null").select(G.canonical_id("path").alias("id"))
    both = js_imports(spark, d).select("file", "module").unionByName(ets_imports(spark, d)).distinct()
    return L.resolve_modules(both, every)


@query()
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Imports of scripts and includes of C files as edges of the graph."""
    resolved = resolved_modules(spark, d)
    modules = js_imports(spark, d).select("file", "module").unionByName(ets_imports(spark, d)).distinct()
    scripts = L.import_edges(modules.join(resolved, ["file", "module"], "left"))
    found = resolved_includes(spark, d).select("file", F.col("include").alias("module"), F.when(~F.col("target").startswith("//include:"), F.col("target")).alias("target"))
    return scripts.unionByName(L.import_edges(found, "include", "//include:"))


# --- manifests -----------------------------------------------------------------------------


@query()
def npm_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return manifests.npm_dependencies(read(spark, d, "files")).withColumn("class", N.dependency_class("spec"))


@query()
def maven_modules(spark: SparkSession, d: str) -> DataFrame:
    return manifests.maven_modules(read(spark, d, "files"))


@query()
def hvigor_packages(spark: SparkSession, d: str) -> DataFrame:
    return manifests.hvigor_packages(read(spark, d, "files"))


@query()
def cmake_targets(spark: SparkSession, d: str) -> DataFrame:
    return manifests.cmake_targets(read(spark, d, "files"))


@query()
def resolved_versions(spark: SparkSession, d: str) -> DataFrame:
    """npm ranges against the versions of all external libraries, by name."""
    libs = graph(spark, d).of_type("external_library").select(F.regexp_extract("id", "^ext_lib:(.+)@", 1).alias("name"), F.regexp_extract("id", "@([^@]+)$", 1).alias("version")).filter("name <> ''")
    asked = libs.select("name", F.concat(F.lit("^"), F.regexp_extract("version", r"^(\d+)", 1), F.lit(".0.0")).alias("spec"))
    return L.resolve_versions(asked, libs)


# --- registry ------------------------------------------------------------------------------


@query("SELECT graph_id, cache_path, strftime(registered_at, '%Y-%m-%d %H:%M:%S.%f') AS registered_at FROM registry WHERE graph_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY registered_at DESC NULLS LAST, cache_path DESC NULLS LAST) = 1", False)
def registry_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last registration of each graph."""
    last = F.max(F.struct("registered_at", "cache_path")).alias("r")
    rows = read(spark, d, "registry").filter("graph_id is not null").groupBy("graph_id").agg(last)
    return rows.select("graph_id", "r.cache_path", F.date_format("r.registered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("registered_at"))


@query("SELECT event_type, count(*) AS events, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type", False)
def metric_timers(spark: SparkSession, d: str) -> DataFrame:
    """Count, extremes and mean per kind of event."""
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


# --- dependencies --------------------------------------------------------------------------


@query(
    r""" s AS (SELECT id, seq, regexp_replace(id, '^ext_lib:', '') AS s FROM g_nodes WHERE type IN ('external_library', 'external_dep')), n AS (SELECT id, seq, CASE WHEN regexp_matches(s, '.@') THEN regexp_extract(s, '^(.+)@[^@]*$', 1) ELSE s END AS name, CASE WHEN regexp_matches(s, '.@') THEN regexp_extract(s, '@([^@]*)$', 1) END AS version FROM s)
 SELECT name, version, count(*) AS nodes, arg_min(id, seq) AS first_node FROM n GROUP BY name, version"""
)
def dependency_specs(spark: SparkSession, d: str) -> DataFrame:
    return L.dependency_specs(graph(spark, d).nodes)


@query(" SELECT graph_id, replace(src_path, chr(92), '/') AS path, arg_min(id, seq) AS id FROM g_nodes WHERE src_path IS NOT NULL GROUP BY 1, 2")
def first_by_path(spark: SparkSession, d: str) -> DataFrame:
    return L.first_by_path(graph(spark, d).nodes)


@query(
    "WITH r AS (SELECT DISTINCT " + _KEY.format(c="id") + " AS id, seq, parser_name, include_dirs, deleted_at IS NOT NULL AS gone FROM nodes WHERE id IS NOT NULL), i AS (SELECT id, string_agg(x, ',' ORDER BY x) AS include_dirs FROM (SELECT DISTINCT id, unnest(include_dirs) AS x FROM r) GROUP BY id)"
    " SELECT r.id, coalesce(max(i.include_dirs), '') AS include_dirs, arg_max(parser_name, {'seq': seq, 'p': parser_name}) FILTER (WHERE parser_name IS NOT NULL) AS parser_name, bool_or(gone) AS gone FROM r LEFT JOIN i USING (id) GROUP BY r.id",
    False,
)
def merged_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of all lives of a node in one row."""
    rows = read(spark, d, "nodes").filter("id is not null").select(G.canonical_id("id").alias("id"), "seq", "parser_name", "include_dirs", F.col("deleted_at").isNotNull().alias("gone"))
    return L.merged_attributes(rows, "id", "seq", ("include_dirs",), ("parser_name",), ("gone",)).withColumn("include_dirs", F.coalesce(F.array_join("include_dirs", ","), F.lit("")))


@query(" SELECT DISTINCT m.id AS module, e.target FROM g_nodes m JOIN g_nodes s ON s.graph_id = m.graph_id AND s.type = 'config' JOIN g_edges e ON e.source = s.id AND e.kind = 'depends_on' WHERE m.type IN ('module', 'hap', 'har', 'hsp') AND m.graph_id IS NOT NULL")
def root_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies that a repository's configuration states, for each of its modules."""
    g = graph(spark, d)
    modules = g.of_type("module", "hap", "har", "hsp").filter("graph_id is not null").select(F.col("graph_id").alias("repo"), F.col("id").alias("module"))
    stated = g.of_kind("depends_on").join(g.of_type("config").select(F.col("id").alias("source"), F.col("graph_id").alias("repo")), "source").select("repo", "target").distinct()
    return L.fan_out(stated, modules)


@query(" SELECT r.graph_id, (SELECT count(*) FROM g_nodes n WHERE n.graph_id = r.graph_id) AS nodes, (SELECT count(*) FROM g_edges e WHERE e.graph_id = r.graph_id) AS edges FROM (SELECT DISTINCT graph_id FROM registry WHERE graph_id IS NOT NULL) r")
def graph_bundle(spark: SparkSession, d: str) -> DataFrame:
    """What an export of all registered graphs holds."""
    g = graph(spark, d)
    return graphfiles.bundle(read(spark, d, "registry").filter("graph_id is not null"), g.nodes, g.edges)


@query(
    r"""WITH RECURSIVE pk AS (SELECT DISTINCT lower(regexp_replace(parent_id, '^\s+|\s+$', '', 'g')) AS src, lower(regexp_replace(child_id, '^\s+|\s+$', '', 'g')) AS dst FROM dag_edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL),
 up(s, t) AS (SELECT src, dst FROM pk WHERE src NOT IN (SELECT dst FROM pk) UNION SELECT up.s, pk.dst FROM up JOIN pk ON pk.src = up.t) SELECT s AS root, t AS member FROM up""",
    False,
)
def graph_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each top package with all that it leads to."""
    pairs = packages(spark, d)
    tops = pairs.select("src").join(pairs.select(F.col("dst").alias("src")), "src", "left_anti").distinct()
    return reach.closure(pairs).join(tops, "src", "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("member"))


# --- build graph ---------------------------------------------------------------------------


@query()
def build_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph that all build files state, of every ecosystem."""
    return build.default_ecosystems().edges(read(spark, d, "files"))


@query()
def cmake_providers(spark: SparkSession, d: str) -> DataFrame:
    return build.cmake_providers(manifests.cmake_targets(read(spark, d, "files")))


_EXPORT = r"""b AS (SELECT *, trim(id) AS v, replace(regexp_replace(trim(id), '^/+', ''), chr(92), '/') AS body FROM g_nodes),
 x AS (SELECT *, CASE WHEN starts_with(id, 'ext_lib:') THEN '//ext_lib/' || replace(substr(id, 9), '/', '.') WHEN starts_with(id, 'module:') THEN '//module/' || replace(substr(id, 8), ':', '/') WHEN v = '' THEN v WHEN regexp_matches(body, '^(system|external|include|proxy):') THEN '//' || body
 ELSE '//' || array_to_string(list_filter(flatten(list_transform(string_split(body, '/'), lambda s: CASE WHEN starts_with(s, '@') THEN [s] ELSE string_split(s, ':') END)), lambda p: p <> ''), '/') END AS new FROM b)"""


@query(f" {_EXPORT} SELECT new AS id, id AS orig_id, type, coalesce(nullif(name, ''), CASE WHEN src_path <> '' THEN regexp_extract(replace(src_path, chr(92), '/'), '[^/]*$') END) AS name, new AS label, confidence, 'definite' AS uncertainty_category FROM x")
def exported_nodes(spark: SparkSession, d: str) -> DataFrame:
    return build.export_nodes(graph(spark, d).nodes)


@query(f" {_EXPORT} SELECT coalesce(s.new, e.source) AS source, coalesce(t.new, e.target) AS target, kind, kind AS label, e.confidence FROM g_edges e LEFT JOIN x s ON s.id = e.source LEFT JOIN x t ON t.id = e.target")
def exported_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return build.export_edges(g.edges, build.export_nodes(g.nodes))


@query(
    f"""WITH {_CODE.replace('EXT', _JAVA)}, {_STATED}, i AS (SELECT DISTINCT file, name AS imported FROM sm WHERE w = 'import'), a AS (SELECT DISTINCT {_KEY.format(c='path')} AS id FROM files WHERE path IS NOT NULL),
 r AS (SELECT DISTINCT regexp_extract(id, '^(//[^/]+)/', 1) AS repo, regexp_extract(id, '^(//[^/]+)/', 1) || '/' || root AS root FROM a, (VALUES ('src'), ('lib')) v(root)),
 h AS (SELECT i.file, i.imported, min(a.id) AS hit FROM i JOIN r ON r.repo = regexp_extract(i.file, '^(//[^/]+)/', 1) JOIN a ON a.id = r.root || '/' || replace(i.imported, '.', '/') || '.java' GROUP BY ALL)
 SELECT i.file, i.imported, coalesce(hit, 'java_import:' || i.imported) AS target, CASE WHEN hit IS NULL THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM i LEFT JOIN h USING (file, imported)""",
    False,
)
def resolved_java_imports(spark: SparkSession, d: str) -> DataFrame:
    every = read(spark, d, "files").filter("path is not null").select(G.canonical_id("path").alias("id")).distinct()
    top = F.regexp_extract("id", "^(//[^/]+)/", 1)
    roots = every.select(top.alias("repo")).distinct().select("repo", F.explode(F.array(F.concat("repo", F.lit("/src")), F.concat("repo", F.lit("/lib")))).alias("root"))
    return build.resolve_java(java_imports(spark, d).select("file", "imported").distinct(), every, roots)
