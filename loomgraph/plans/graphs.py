"""Queries of the graph operators over whole tables, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph as G
from ..functions.ids import package_key
from ..functions.vocab import ALL_TYPES, ARTIFACT_TYPES, EDGE_KINDS, NODE_TYPES, sql_list
from ..operators import hierarchy, labels, project, reach
from ..tables import read
from . import warehouse as W

QUERIES: dict = {}
SQL: dict[str, str] = {}

_KEY = r"regexp_replace(regexp_replace(replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), chr(92), '/'), '/{{2,}}', '/', 'g'), '^/', '//')"
_ENUM = "CASE WHEN regexp_replace(lower(trim({c})), '[- ]', '_', 'g') IN {known} THEN regexp_replace(lower(trim({c})), '[- ]', '_', 'g') ELSE '{other}' END"
NODES = (
    "g_nodes AS (SELECT id, seq, " + _ENUM.format(c="type", known=sql_list(ALL_TYPES), other="unknown") + " AS type, graph_id, src_path, name, parser_name, child_graph_id, external_graph_id, include_dirs, native_dirs, source_roots,"
    " least(1.0, greatest(0.0, coalesce(confidence, 1.0))) AS confidence FROM (SELECT * EXCLUDE (id), " + _KEY.format(c="id") + " AS id FROM nodes WHERE id IS NOT NULL)"
    " QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq, ingested_at, type) = 1)"
)
EDGES = (
    "g_edges AS (SELECT seq, graph_id, " + _KEY.format(c="source") + " AS source, " + _KEY.format(c="target") + " AS target, " + _ENUM.format(c="kind", known=sql_list(EDGE_KINDS), other="depends_on") + " AS kind, parser_name,"
    " least(1.0, greatest(0.0, coalesce(confidence, 1.0))) AS confidence, derived_from FROM edges WHERE source IS NOT NULL AND target IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY seq ORDER BY ingested_at, graph_id, edges.source, edges.target) = 1)"
)
KEYS = "g_keys AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, target ORDER BY seq) - 1 AS INTEGER) AS key FROM g_edges)"


def query(sql: str | None = None, on: str = "g"):
    """Register a query under its function's name; ``sql`` continues the definition of the graph's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            before = {"g": f"{NODES}, {EDGES}, {KEYS}", "w": W.SQL, "": ""}[on]
            SQL[f.__name__] = f"WITH RECURSIVE {before}{'' if sql.lstrip().upper().startswith('SELECT') else ', '}{sql}" if before else sql
        return f

    return add


def graph(spark: SparkSession, d: str) -> G.Graph:
    return G.Graph.build(read(spark, d, "nodes"), read(spark, d, "edges"))


def _list(c: str):
    return F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",").alias(c)


# --- the graph as built -------------------------------------------------------------------


@query(" SELECT id, seq, type, graph_id, src_path, name, confidence FROM g_nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.select("id", "seq", "type", "graph_id", "src_path", "name", "confidence")


@query(" SELECT seq, source, target, key, kind, parser_name, confidence, coalesce(array_to_string(list_sort(derived_from), ','), '') AS derived_from FROM g_keys")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_keys(graph(spark, d).edges).select("seq", "source", "target", "key", "kind", "parser_name", "confidence", _list("derived_from"))


@query(" SELECT DISTINCT id, 'unknown' AS type, true AS provisional FROM (SELECT source AS id FROM g_edges UNION SELECT target FROM g_edges) WHERE id NOT IN (SELECT id FROM g_nodes)")
def provisional_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).provisional()


@query(" SELECT CASE " + " ".join(f"WHEN type IN {sql_list(v)} THEN '{k}'" for k, v in NODE_TYPES.items()) + " ELSE 'misc' END AS category, type, count(*) AS nodes FROM g_nodes GROUP BY ALL")
def nodes_by_category(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.groupBy(G.category("type").alias("category"), "type").agg(F.count(F.lit(1)).alias("nodes"))


@query(" SELECT kind, count(*) AS edges, count(DISTINCT source) AS sources FROM g_edges GROUP BY kind")
def edge_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    per = graph(spark, d).edges.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("sources"))


@query(" SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(DISTINCT graph_id) FROM g_nodes) AS graphs")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("graph_id").alias("graphs"))
    return n.crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges"))).select("nodes", "edges", "graphs")


@query(" SELECT n.id, (SELECT count(*) FROM g_edges WHERE target = n.id) AS in_degree, (SELECT count(*) FROM g_edges WHERE source = n.id) AS out_degree FROM g_nodes n")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).degrees()


@query(" SELECT id, sum(s)::BIGINT AS successors, sum(p)::BIGINT AS predecessors FROM (SELECT source AS id, count(DISTINCT target) AS s, 0 AS p FROM g_edges GROUP BY source UNION ALL SELECT target, 0, count(DISTINCT source) FROM g_edges GROUP BY target) GROUP BY id")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).neighbours()


@query(" SELECT id, type FROM g_nodes WHERE id NOT IN (SELECT source FROM g_edges) AND id NOT IN (SELECT target FROM g_edges)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).isolated().select("id", "type")


@query(" SELECT id FROM g_nodes WHERE id IN (SELECT source FROM g_edges) AND id NOT IN (SELECT target FROM g_edges)")
def root_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).roots().select("id")


@query(" SELECT graph_id, count(*) AS roots FROM g_nodes WHERE id NOT IN (SELECT target FROM g_edges) GROUP BY graph_id")
def in_degree_zero_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).in_degree_zero().groupBy("graph_id").agg(F.count(F.lit(1)).alias("roots"))


@query(" SELECT source, target, kind, seq FROM g_edges WHERE source IN (SELECT id FROM g_nodes WHERE type IN ('code', 'project_header')) AND target IN (SELECT id FROM g_nodes WHERE type IN ('code', 'project_header'))")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.subgraph(g.of_type("code", "project_header")).edges.select("source", "target", "kind", "seq")


@query(" SELECT source, target, kind, seq FROM g_edges WHERE source NOT IN (SELECT id FROM g_nodes WHERE type = 'external_library') AND target NOT IN (SELECT id FROM g_nodes WHERE type = 'external_library')")
def delete_external_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.delete_nodes(g.of_type("external_library")).edges.select("source", "target", "kind", "seq")


@query(" SELECT id, CASE WHEN parser_name = 'cmake' AND type = 'unknown' THEN 'target' ELSE type END AS type FROM g_nodes")
def retyped_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    change = g.nodes.filter("parser_name = 'cmake' and type = 'unknown'").select("id", F.lit("target").alias("type"))
    return g.update_nodes(change).nodes.select("id", "type")


@query(" SELECT id, '[' || type || '] ' || coalesce(name, id) AS display FROM g_nodes WHERE contains(lower(concat_ws(' ', id, type, name)), 'ledger') ORDER BY id LIMIT 50")
def node_search(spark: SparkSession, d: str) -> DataFrame:
    return G.search(graph(spark, d).nodes, "Ledger", 50)


@query(" SELECT id, string_split(id, ':')[2] AS graph, array_to_string(string_split(id, ':')[3:], ':') AS node FROM g_nodes WHERE starts_with(id, '//proxy:') AND len(string_split(id, ':')) >= 3")
def proxy_references(spark: SparkSession, d: str) -> DataFrame:
    parts = G.proxy_parts(F.col("id"))
    return graph(spark, d).nodes.select("id", parts.alias("p")).filter("p is not null").select("id", "p.graph", "p.node")


@query(" SELECT id, type FROM g_nodes WHERE starts_with(id, '//external') OR starts_with(id, 'ext_lib:') OR starts_with(id, '//system:')")
def external_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.filter(G.is_external(F.col("id"))).select("id", "type")


@query(
    f"""SELECT DISTINCT seq, unnest(list_filter([CASE WHEN id IS NULL THEN 'no id' END, CASE WHEN NOT coalesce(lower(trim(type)) IN {sql_list(ALL_TYPES)}, false) THEN 'unknown type' END,
 CASE WHEN lower(trim(type)) IN ('config', 'module', 'subdirectory') AND src_path IS NULL THEN 'no src_path' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END], lambda x: x IS NOT NULL)) AS problem FROM nodes""",
    on="",
)
def invalid_node_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.invalid_nodes(read(spark, d, "nodes"))


@query(
    f"""SELECT DISTINCT seq, unnest(list_filter([CASE WHEN source IS NULL THEN 'no source' END, CASE WHEN target IS NULL THEN 'no target' END,
 CASE WHEN NOT coalesce(kind IN {sql_list(EDGE_KINDS)}, false) THEN 'unknown kind' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END], lambda x: x IS NOT NULL)) AS problem FROM edges""",
    on="",
)
def invalid_edge_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.invalid_edges(read(spark, d, "edges"))


@query(" SELECT q.source, q.target, count(e.seq) > 0 AS present, count(e.seq) AS parallel FROM (SELECT DISTINCT target AS source, source AS target FROM g_edges) q LEFT JOIN g_edges e ON e.source = q.source AND e.target = q.target GROUP BY ALL")
def edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Whether the reverse of each edge is there."""
    e = graph(spark, d).edges
    asked = e.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    per = e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(per, ["source", "target"], "left").select("source", "target", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("parallel"))


# --- labels --------------------------------------------------------------------------------


@query(
    """ SELECT e.source || '->' || e.target || ':' || e.key AS edge_id, CASE WHEN e.confidence < 0.5 THEN 'unknown' WHEN n.type IN ('shared_library', 'hap', 'har', 'hsp') THEN 'dynamic'
 WHEN n.type = 'static_library' THEN 'static' WHEN n.type = 'module' THEN 'module' ELSE 'unknown' END AS linkage_type FROM g_keys e LEFT JOIN g_nodes n ON n.id = e.target WHERE e.kind IN ('links', 'link_libraries')"""
)
def linkage_types(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return labels.linkage(G.edge_keys(g.edges), g.nodes)


@query(
    """ lab AS (SELECT id, type = 'proxy' OR coalesce(child_graph_id, '') <> '' AS p, CASE WHEN confidence >= 0.9 THEN 'definite' WHEN confidence >= 0.6 THEN 'probable' ELSE 'conditional' END AS b, type = 'external_dep' AS x FROM g_nodes)
 SELECT id, CASE WHEN p OR x THEN 'conditional' ELSE b END AS uncertainty_category, CASE WHEN p OR x THEN true ELSE b <> 'definite' END AS over_approx,
 array_to_string(list_sort(list_filter([CASE WHEN p THEN 'proxy_reference' END, CASE WHEN x THEN 'unresolved_external' END], lambda v: v IS NOT NULL)), ',') AS reasons FROM lab"""
)
def uncertainty_nodes(spark: SparkSession, d: str) -> DataFrame:
    return labels.node_certainty(graph(spark, d).nodes).withColumn("reasons", F.array_join("reasons", ","))


@query(
    """ lab AS (SELECT seq, coalesce(parser_name = 'projection', false) AS p, list_has_any(coalesce(derived_from, []), ['build_contract', 'contract_binding', 'hvigor_shared_library']) OR coalesce(parser_name IN ('global_contract_linker', 'hvigor_linker'), false) AS c,
 CASE WHEN confidence >= 0.9 THEN 'definite' WHEN confidence >= 0.6 THEN 'probable' ELSE 'conditional' END AS b FROM g_edges),
 fin AS (SELECT *, CASE WHEN (p OR c) AND b <> 'conditional' THEN 'probable' ELSE b END AS f FROM lab)
 SELECT seq, f AS uncertainty_category, f <> 'definite' AS over_approx, array_to_string(list_sort(list_filter([CASE WHEN p THEN 'projection_fallback' END, CASE WHEN c THEN 'build_contract' END], lambda v: v IS NOT NULL)), ',') AS reasons FROM fin WHERE f <> 'definite'"""
)
def uncertain_edges(spark: SparkSession, d: str) -> DataFrame:
    return labels.edge_certainty(graph(spark, d).edges).filter("over_approx").withColumn("reasons", F.array_join("reasons", ","))


# --- projection ----------------------------------------------------------------------------

_ART = sql_list(ARTIFACT_TYPES)
_PART = " w_part AS (SELECT target AS source, source AS target, kind AS derived_from FROM ws_edges WHERE kind IN ('sources', 'contains')), w_own AS (SELECT DISTINCT source AS code, target AS artifact FROM w_part)"
_SYS = "(SELECT id FROM ws_nodes WHERE type = 'system_header')"


def _ws(spark, d):
    return W.nodes(spark, d), W.edges(spark, d)


@query(" SELECT target AS source, source AS target, 'part_of' AS kind, kind AS derived_from, 1.0::DOUBLE AS confidence FROM ws_edges WHERE kind IN ('sources', 'contains')", on="w")
def part_of_projection(spark: SparkSession, d: str) -> DataFrame:
    return project.part_of(W.edges(spark, d)).drop("hops")


@query(
    f" SELECT s.id AS source, a.id AS target FROM ws_nodes a JOIN ws_nodes s ON s.type = 'subdirectory' AND starts_with(a.src_path, s.src_path || '/') WHERE a.type IN {_ART} QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY length(s.src_path) DESC, s.seq) = 1",
    on="w",
)
def subdirectory_containment(spark: SparkSession, d: str) -> DataFrame:
    return project.subdirectory_containment(W.nodes(spark, d)).select("source", "target")


@query(f"{_PART} SELECT e.target AS source, o.artifact AS target, 'affects' AS kind, 0.8::DOUBLE AS confidence FROM ws_edges e JOIN w_own o ON o.code = e.source WHERE e.kind = 'include' AND e.target NOT IN {_SYS}", on="w")
def include_affects(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ws(spark, d)
    return project.include_affects(n, e, project.part_of(e)).select("source", "target", "kind", "confidence")


@query(
    f"""{_PART}, arts AS (SELECT id FROM ws_nodes WHERE type IN {_ART}), lnk AS (SELECT DISTINCT target AS a, source AS b FROM ws_edges WHERE kind = 'link_libraries' AND source IN (SELECT id FROM arts) AND target IN (SELECT id FROM arts)),
 wk(o, id, h) AS (SELECT DISTINCT artifact, artifact, 0 FROM w_own UNION SELECT wk.o, l.b, wk.h + 1 FROM wk JOIN lnk l ON l.a = wk.id WHERE wk.h < 3), best AS (SELECT o, id, min(h) AS h FROM wk GROUP BY o, id)
 SELECT w.code AS source, b.id AS target, b.h AS hops, round(greatest(0.5, 0.7 - 0.1 * (b.h - 1))::DOUBLE, 2) AS confidence FROM w_own w JOIN best b ON b.o = w.artifact WHERE b.h > 0""",
    on="w",
)
def link_closure(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ws(spark, d)
    return project.link_closure(n, e, project.part_of(e)).select("source", "target", "hops", "confidence")


_HEAD = """ inc AS (SELECT DISTINCT source AS a, target AS b FROM ws_edges WHERE kind = 'include' AND source <> target), st AS (SELECT DISTINCT code AS s FROM w_own WHERE code NOT IN (SELECT id FROM ws_nodes WHERE type = 'system_header')),
 hw(o, id, h) AS (SELECT s, s, 0 FROM st UNION SELECT hw.o, i.b, hw.h + 1 FROM hw JOIN inc i ON i.a = hw.id WHERE hw.h < 2), hb AS (SELECT o, id, min(h) AS h FROM hw GROUP BY o, id)"""


@query(f"{_PART},{_HEAD} SELECT b.id AS source, w.artifact AS target, b.h AS hops, round(greatest(0.5, 0.6 - 0.1 * (b.h - 1))::DOUBLE, 2) AS confidence FROM w_own w JOIN hb b ON b.o = w.code WHERE b.h > 0 AND b.id NOT IN {_SYS}", on="w")
def header_closure(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ws(spark, d)
    return project.header_closure(n, e, project.part_of(e)).select("source", "target", "hops", "confidence")


@query(
    f"{_PART} SELECT DISTINCT e.target AS source, o.artifact AS target, 'affects' AS kind FROM ws_edges e JOIN w_own o ON o.code = e.source JOIN ws_nodes n ON n.id = e.target AND n.type IN ('code', 'project_header', 'header') WHERE e.kind IN ('import', 'include') AND e.target NOT IN (SELECT code FROM w_own)",
    on="w",
)
def import_inherited_fallback(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ws(spark, d)
    return project.import_inherited(n, e, project.part_of(e)).select("source", "target", "kind")


@query(
    f"{_PART} SELECT n.id AS source, a.id AS target FROM ws_nodes n JOIN ws_nodes a ON a.type IN {_ART} AND starts_with(n.src_path, regexp_replace(a.src_path, '/[^/]*$', '') || '/') WHERE n.type IN ('code', 'project_header', 'header') AND n.id NOT IN (SELECT code FROM w_own)"
    " QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY length(regexp_replace(a.src_path, '/[^/]*$', '')) DESC, a.seq) = 1",
    on="w",
)
def nearest_directory_fallback(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ws(spark, d)
    return project.nearest_directory(n, project.part_of(e)).select("source", "target")


@query(
    f"""{_PART},{_HEAD}, ev AS (SELECT e.target AS source, o.artifact AS target, 'include+part_of' AS df, 0.8 AS c FROM ws_edges e JOIN w_own o ON o.code = e.source WHERE e.kind = 'include' AND e.target NOT IN {_SYS}
 UNION ALL SELECT b.id, w.artifact, 'include_closure', greatest(0.5, 0.6 - 0.1 * (b.h - 1)) FROM w_own w JOIN hb b ON b.o = w.code WHERE b.h > 0 AND b.id NOT IN {_SYS})
 SELECT source, target, string_agg(DISTINCT df, ',' ORDER BY df) AS derived_from, round(max(c)::DOUBLE, 2) AS confidence FROM ev GROUP BY source, target""",
    on="w",
)
def fused_evidence(spark: SparkSession, d: str) -> DataFrame:
    n, e = _ws(spark, d)
    parts = project.part_of(e)
    both = project.include_affects(n, e, parts).unionByName(project.header_closure(n, e, parts))
    return project.fuse(both).select("source", "target", F.array_join("derived_from", ",").alias("derived_from"), F.round("confidence", 2).alias("confidence"))


@query()
def projection_edges(spark: SparkSession, d: str) -> DataFrame:
    """All steps in their order, fused."""
    out = project.project(*_ws(spark, d))
    return out.select("source", "target", "kind", F.array_join("derived_from", ",").alias("derived_from"), "confidence", "hops", "fallback", F.array_join("rules", ",").alias("rules"))


_ALIVE = """ al(id) AS (SELECT id FROM {n} WHERE type IN ('hap', 'har', 'hsp', 'executable') UNION SELECT b FROM al JOIN (SELECT source AS a, target AS b FROM {e} UNION ALL SELECT target, source FROM {e} WHERE kind = 'contains') x ON x.a = al.id)"""


@query(_ALIVE.format(n="ws_nodes", e="ws_edges") + " SELECT id FROM ws_nodes WHERE id NOT IN (SELECT id FROM al)", on="w")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return project.dead_code(*_ws(spark, d)).select("id")


@query(_ALIVE.format(n="g_nodes", e="g_edges") + " SELECT id FROM g_nodes WHERE id NOT IN (SELECT id FROM al)")
def dead_code_domain(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return project.dead_code(g.nodes, g.edges).select("id")


@query(
    " big AS (SELECT graph_id FROM g_nodes WHERE graph_id IS NOT NULL GROUP BY graph_id ORDER BY count(*) DESC, graph_id LIMIT 1),"
    + _ALIVE.format(n="g_nodes", e="g_edges")
    + " SELECT id FROM g_nodes WHERE id NOT IN (SELECT id FROM al) AND graph_id = (SELECT graph_id FROM big)"
)
def dead_code_main_graph(spark: SparkSession, d: str) -> DataFrame:
    """Dead code of the largest graph."""
    g = graph(spark, d)
    main = g.nodes.filter("graph_id is not null").groupBy("graph_id").count().orderBy(F.desc("count"), "graph_id").limit(1).select("graph_id").first()
    return project.dead_code(g.nodes, g.edges, main.graph_id if main else "").select("id")


_EXPORT_ASSETS = ("asset", "code", "header", "project_header", "system_header", "source")
_EXPORT_GOALS = ("shared_library", "static_library", "executable", "module", "hap", "har", "hsp", "target")
_EXPORTED = f""" ed AS (SELECT DISTINCT source AS a, target AS b FROM g_edges WHERE source <> target), wk(o, id) AS (SELECT id, id FROM g_nodes WHERE type IN {sql_list(_EXPORT_ASSETS)} UNION SELECT wk.o, e.b FROM wk JOIN ed e ON e.a = wk.id),
 m AS (SELECT o AS asset, id AS artifact FROM wk WHERE id IN (SELECT id FROM g_nodes WHERE type IN {sql_list(_EXPORT_GOALS)}))"""


@query(f"{_EXPORTED} SELECT asset, artifact FROM m")
def asset_artifact_map(spark: SparkSession, d: str) -> DataFrame:
    """Files with all artifacts they lead to over any number of hops."""
    g = graph(spark, d)
    return project.asset_artifacts(g.nodes, g.edges, _EXPORT_ASSETS, _EXPORT_GOALS).select("asset", "artifact")


@query(f"{_EXPORTED} SELECT artifact, count(*) AS assets FROM m GROUP BY artifact")
def artifact_summary(spark: SparkSession, d: str) -> DataFrame:
    return asset_artifact_map(spark, d).groupBy("artifact").agg(F.count(F.lit(1)).alias("assets"))


# --- package graph -------------------------------------------------------------------------

_PAIR = """pk AS (SELECT DISTINCT lower(regexp_replace(parent_id, '^\\s+|\\s+$', '', 'g')) AS src, lower(regexp_replace(child_id, '^\\s+|\\s+$', '', 'g')) AS dst FROM dag_edges WHERE parent_id IS NOT NULL AND child_id IS NOT NULL),
 pn AS (SELECT src AS id FROM pk UNION SELECT dst FROM pk)"""


def packages(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst``: every stated package link, once; overruled ones too, so the graph has cycles and joins."""
    return read(spark, d, "dag_edges").select(package_key("parent_id").alias("src"), package_key("child_id").alias("dst")).dropna().distinct()


def package_nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query(f"WITH RECURSIVE {_PAIR}, up(s, t) AS (SELECT src, dst FROM pk UNION SELECT up.s, pk.dst FROM up JOIN pk ON pk.src = up.t) SELECT s AS src, t AS dst FROM up WHERE s <> t", on="")
def transitive_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """All packages below each package, itself excluded even on a cycle."""
    return reach.closure(packages(spark, d)).filter("src <> dst")


@query(f"WITH RECURSIVE {_PAIR}, st AS (SELECT src AS id FROM pk GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), r(id) AS (SELECT id FROM st UNION SELECT pk.dst FROM r JOIN pk ON pk.src = r.id) SELECT id FROM r", on="")
def reachable_packages(spark: SparkSession, d: str) -> DataFrame:
    """What the package with the most direct dependencies reaches."""
    pairs = packages(spark, d)
    start = pairs.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("id"))
    return reach.reach(pairs, start)


@query(f"WITH {_PAIR} SELECT id, (SELECT count(*) FROM pk WHERE src = id) AS dependencies, (SELECT count(*) FROM pk WHERE dst = id) AS dependents FROM pn", on="")
def direct_dependencies(spark: SparkSession, d: str) -> DataFrame:
    pairs = packages(spark, d)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("a").alias("dependencies"), F.sum("b").alias("dependents"))


_MUTUAL = ", up(s, t) AS (SELECT src, dst FROM pk UNION SELECT up.s, pk.dst FROM up JOIN pk ON pk.src = up.t), mu AS (SELECT a.s AS id, least(a.s, min(a.t)) AS component FROM up a JOIN up b ON b.s = a.t AND b.t = a.s WHERE a.s <> a.t GROUP BY a.s)"
_NAMED = _MUTUAL + ", cl AS (SELECT component, 'scc:' || substr(sha256(string_agg(id, ',' ORDER BY id)), 1, 16) AS cluster FROM mu GROUP BY component), cm AS (SELECT id, component, cluster FROM mu JOIN cl USING (component))"


@query(f"WITH RECURSIVE {_PAIR}{_NAMED} SELECT id, component, cluster FROM cm", on="")
def scc_members(spark: SparkSession, d: str) -> DataFrame:
    return reach.cluster_ids(reach.strong_components(packages(spark, d)))


@query(
    f"""WITH RECURSIVE {_PAIR}{_NAMED}, mk AS (SELECT src, dst, a.cluster AS cs, b.cluster AS cd FROM pk LEFT JOIN cm a ON a.id = src LEFT JOIN cm b ON b.id = dst WHERE src <> dst AND (a.cluster IS NULL OR b.cluster IS NULL OR a.cluster <> b.cluster))
 SELECT src, dst, 'depends_on' AS kind FROM mk UNION ALL SELECT * FROM (SELECT src, cd, 'depends_on' FROM mk WHERE cd IS NOT NULL UNION SELECT cs, dst, 'depends_on' FROM mk WHERE cs IS NOT NULL UNION SELECT cs, cd, 'depends_on' FROM mk WHERE cs IS NOT NULL AND cd IS NOT NULL)
 UNION ALL SELECT cluster, id, 'contains' FROM cm""",
    on="",
)
def break_cycles_edges(spark: SparkSession, d: str) -> DataFrame:
    return reach.break_cycles(packages(spark, d).withColumn("kind", F.lit("depends_on")))


@query(
    f"""WITH RECURSIVE {_PAIR}{_MUTUAL}, f AS (SELECT pn.id, coalesce(component, pn.id) AS c FROM pn LEFT JOIN mu ON mu.id = pn.id), s AS (SELECT c, count(*) AS n, string_agg(id, ',' ORDER BY id) AS m FROM f GROUP BY c),
 k AS (SELECT c, 'global_scc:' || (row_number() OVER (ORDER BY n, m) - 1) AS cluster FROM s) SELECT id, cluster FROM f JOIN k USING (c)""",
    on="",
)
def condensation_members(spark: SparkSession, d: str) -> DataFrame:
    pairs = packages(spark, d)
    return reach.condensation(pairs, package_nodes(pairs))[0]


@query(f"WITH RECURSIVE {_PAIR}{_MUTUAL} SELECT (SELECT count(*) FROM mu) + (SELECT count(*) FROM pk WHERE src = dst) > 0 AS has_cycle, (SELECT count(DISTINCT component) FROM mu) AS components", on="")
def cycle_report(spark: SparkSession, d: str) -> DataFrame:
    pairs = packages(spark, d)
    n = reach.strong_components(pairs).agg(F.countDistinct("component").alias("components"))
    loops = pairs.filter("src = dst").agg(F.count(F.lit(1)).alias("loops"))
    return n.crossJoin(loops).select(((F.col("components") + F.col("loops")) > 0).alias("has_cycle"), "components")


@query(f"WITH RECURSIVE {_PAIR}, bo AS (SELECT src, dst FROM pk WHERE src <> dst UNION SELECT dst, src FROM pk WHERE src <> dst), wc(s, t) AS (SELECT src, dst FROM bo UNION SELECT wc.s, bo.dst FROM wc JOIN bo ON bo.src = wc.t) SELECT s AS id, min(t) AS component FROM wc GROUP BY s", on="")
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return reach.weak_components(packages(spark, d))


@query(
    rf"""WITH RECURSIVE {_PAIR}, top AS (SELECT src FROM pk WHERE src <> dst GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), leaf AS (SELECT dst AS id FROM pk WHERE src = (SELECT src FROM top) AND src <> dst), up(o, id, h) AS (SELECT id, id, 0 FROM (SELECT min(id) AS id FROM leaf UNION SELECT max(id) FROM leaf) UNION SELECT up.o, pk.src, up.h + 1 FROM up JOIN pk ON pk.dst = up.id WHERE up.h < 100),
 m AS (SELECT o, id, min(h) AS h FROM up GROUP BY o, id) SELECT a.id AS ancestor, CAST(a.h AS INTEGER) AS hops_first, CAST(b.h AS INTEGER) AS hops_second FROM m a JOIN m b ON a.id = b.id WHERE a.o = (SELECT min(id) FROM leaf) AND b.o = (SELECT max(id) FROM leaf) ORDER BY a.h + b.h, a.id LIMIT 1""",
    on="",
)
def common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Of the first and the last dependency of the package with the most of them."""
    pairs = packages(spark, d).filter("src <> dst")
    top = pairs.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select("src")
    ends = pairs.join(top, "src", "left_semi").agg(F.min("dst").alias("a"), F.max("dst").alias("b")).first()
    return reach.common_ancestor(pairs, ends.a or "", ends.b or "")


@query(
    f"WITH {_PAIR} SELECT id FROM pn WHERE id NOT IN (SELECT dst FROM pk)",
    on="",
)
def top_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages that no other depends on: the roots of the graph sets."""
    pairs = packages(spark, d)
    return package_nodes(pairs).join(pairs.select(F.col("dst").alias("id")), "id", "left_anti")


@query(
    r"""WITH r AS (SELECT lower(regexp_replace(parent_id, '^\s+|\s+$', '', 'g')) AS p, lower(regexp_replace(child_id, '^\s+|\s+$', '', 'g')) AS c, recorded_at AS t FROM dag_edges WHERE child_id IS NOT NULL)
 SELECT p AS parent_id, c AS child_id FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY t DESC NULLS LAST, p DESC NULLS LAST) = 1""",
    on="",
)
def replaced_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Links after every later statement on a child has replaced the earlier ones."""
    out = hierarchy.latest_parents(read(spark, d, "dag_edges").filter("child_id is not null"), "parent_id", "child_id", "recorded_at")
    kept = read(spark, d, "dag_edges").select(package_key("child_id").alias("node")).dropna().distinct()
    return out.join(kept, "node", "left_semi").select(F.col("parent").alias("parent_id"), F.col("node").alias("child_id"))


# --- the package graph whole: levels, cycles, paths ------------------------------------------


def stated_packages(spark: SparkSession, d: str) -> DataFrame:
    """``id``: every package that a link names, those that only have no parent too."""
    return read(spark, d, "dag_edges").select(F.explode(F.array(package_key("parent_id"), package_key("child_id"))).alias("id")).dropna().distinct()


@query(
    f"""WITH RECURSIVE {_PAIR}{_NAMED}, mk AS (SELECT src, dst, a.cluster AS cs, b.cluster AS cd FROM pk LEFT JOIN cm a ON a.id = src LEFT JOIN cm b ON b.id = dst WHERE src <> dst AND (a.cluster IS NULL OR b.cluster IS NULL OR a.cluster <> b.cluster)),
 bk AS (SELECT src, dst FROM mk UNION SELECT src, cd FROM mk WHERE cd IS NOT NULL UNION SELECT cs, dst FROM mk WHERE cs IS NOT NULL UNION SELECT cs, cd FROM mk WHERE cs IS NOT NULL AND cd IS NOT NULL UNION SELECT cluster, id FROM cm),
 every AS (SELECT id FROM (SELECT lower(regexp_replace(unnest([parent_id, child_id]), '^\\s+|\\s+$', '', 'g')) AS id FROM dag_edges) WHERE id <> '' UNION SELECT cluster FROM cm),
 lv(id, l) AS (SELECT id, 0 FROM every WHERE id NOT IN (SELECT dst FROM bk) UNION SELECT bk.dst, lv.l + 1 FROM lv JOIN bk ON bk.src = lv.id) SELECT id, CAST(max(l) AS INTEGER) AS level FROM lv GROUP BY id""",
    on="",
)
def package_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of all packages, and of the clusters of cycles, in the acyclic view."""
    view = reach.cut(reach.break_cycles(packages(spark, d).withColumn("kind", F.lit("depends_on"))))
    return reach.levels(view, stated_packages(spark, d).unionByName(package_nodes(view)))


_CYCLES = f"""WITH RECURSIVE {_PAIR}{_MUTUAL}, inn AS (SELECT src, dst FROM pk JOIN mu a ON a.id = src JOIN mu b ON b.id = dst WHERE src <> dst AND a.component = b.component),
 cy(a, b, path) AS (SELECT src, dst, [src, dst] FROM inn WHERE src < dst UNION ALL SELECT cy.a, inn.dst, list_append(path, inn.dst) FROM cy JOIN inn ON inn.src = cy.b WHERE inn.dst > cy.a AND NOT list_contains(path, inn.dst)),
 al AS (SELECT array_to_string(path, ',') AS cycle, CAST(len(path) AS INTEGER) AS length FROM cy JOIN inn ON inn.src = cy.b AND inn.dst = cy.a UNION ALL SELECT src, 1 FROM pk WHERE src = dst)"""


@query(f"{_CYCLES} SELECT cycle, length FROM al", on="")
def package_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Every simple cycle of packages, however long."""
    return reach.simple_cycles(packages(spark, d))


def _source(summary: str | None) -> str | None:
    """Where a registered graph comes from, in any layout of its summary."""
    try:
        value = json.loads(summary or "")
        value = json.loads(value) if isinstance(value, str) else value
        value = value.get("graph", value) if isinstance(value, dict) and "source" not in value else value
        value = json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return None
    source = value.get("source") if isinstance(value, dict) else None
    return source if isinstance(source, str) and source.strip() else None


@query()
def package_cycle_sources(spark: SparkSession, d: str) -> DataFrame:
    """The cycle report: each package of each cycle in order, with the source of its last registration that tells one."""
    rows = read(spark, d, "registry").select(package_key("graph_id").alias("graph_id"), "registered_at", F.udf(_source, "string")("summary").alias("source"))
    of = rows.filter("graph_id is not null and source is not null").groupBy("graph_id").agg(F.max(F.struct("registered_at", "source"))["source"].alias("source"))
    members = package_cycles(spark, d).select("cycle", "length", F.posexplode(F.split("cycle", ",")).alias("position", "graph_id"))
    return members.join(of, "graph_id", "left").select("cycle", "length", "position", "graph_id", F.coalesce("source", F.lit("unknown")).alias("source"))


@query()
def package_path(spark: SparkSession, d: str) -> DataFrame:
    """From the package with the most direct dependencies to the farthest it reaches."""
    pairs = reach.cut(packages(spark, d).filter("src <> dst"))
    start = pairs.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("id")).first()
    if start is None:
        return reach.shortest_path(pairs, "", "")
    far = reach.distances(pairs, spark.createDataFrame([(start.id,)], "id string")).orderBy(F.desc("hops"), "id").first()
    return reach.shortest_path(pairs, start.id, far.id)
