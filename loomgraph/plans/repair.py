"""Queries over whole tables for the table-repair operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, nested, orphans, skew
from ..session import cut
from ..tables import read

#: The fields of the nested records that mean arrays.
ARRAY_FIELDS = ("targets", "inputs", "dependencies", "exclusions", "evidence", "phases", "tasks", "issues", "related", "abis")
#: Fields of array levels that are numbers; all others are kept as they stand, so that 1.10 stays 1.10.
NUMBERS = {"line": "bigint", "rank": "bigint", "duration_ms": "bigint", "score": "double"}
HEAVY_SHARE = 0.02


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.latest_parents(read(spark, d, "dag_edges"), "parent_id", "child_id", "recorded_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(_parents(spark, d)).select("node_id", "root_id", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve_hierarchy(_parents(spark, d), with_path=True)
    return out.select("node_id", "root_id", "depth", F.coalesce(F.array_join("path", "/"), F.lit("")).alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve_hierarchy(_parents(spark, d), with_path=True))


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    parents = _parents(spark, d)
    return hierarchy.cycle_members(parents, hierarchy.resolve_hierarchy(parents))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(read(spark, d, "edges"), read(spark, d, "nodes"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(read(spark, d, "edges"), read(spark, d, "nodes"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "nodes").select(F.lit("nodes").alias("owner_table"), F.col("seq").cast("string").alias("owner_id"), F.col("data").alias("text"))
    graphs = read(spark, d, "registry").select(F.lit("registry").alias("owner_table"), F.col("graph_id").alias("owner_id"), F.col("summary").alias("text"))
    return nodes.unionByName(graphs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = nested.flatten(_records(spark, d), "owner_id", "text", ARRAY_FIELDS, root=False, fields=False, keep=("owner_table",))
    return found.select("owner_table", "owner_id", "object_path", "parent_path").distinct()


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        nested.merged_schema(read(spark, d, table), owner, text, ARRAY_FIELDS).select(F.lit(table).alias("owner_table"), "*")
        for table, owner, text in (("nodes", "seq", "data"), ("registry", "graph_id", "summary"))
    ]
    return parts[0].unionByName(parts[1])


def p3_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of one array level: the dependencies that a node lists in any layout, with typed columns."""
    objects = nested.flatten(read(spark, d, "nodes"), "seq", "data", ARRAY_FIELDS, root=False)
    return nested.level_table(objects, "dependencies", {"name": "string", "version": "string", "scope": "string"}).distinct()


def _level(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """The child table of one array level of nodes and registry, with the fields that the merged schema has for it."""
        records = _records(spark, d)
        schema = cut(nested.infer(records, "text", ARRAY_FIELDS))
        columns = {f: NUMBERS.get(f, "string") for f in nested.level_fields(schema, ARRAY_FIELDS).get(name, [])}
        objects = nested.flatten(records, "owner_id", "text", ARRAY_FIELDS, root=False, schema=schema, keep=("owner_table",))
        return nested.level_table(objects, name, columns, ("owner_table", "owner_id", "object_path", "parent_path", "ordinal")).distinct()

    return query


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "edges")
    both = edges.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("kind", "target")])).alias("x")).select("x.*")
    return skew.heavy_keys(both, "value", HEAVY_SHARE, by="field").select("field", "value")


def _profile(key: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = skew.per_key_profile(read(spark, d, "edges"), F.col(key), F.col("source"), F.col("observed_at"), HEAVY_SHARE)
        return out.select("value", "rows", "members", _stamp("first_at"), _stamp("last_at"), "heavy")

    return query


QUERIES = {
    "p1_found": p1_found,
    "p1_paths": p1_paths,
    "p1_descendants": p1_descendants,
    "p1_cycles": p1_cycles,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_schema": p3_schema,
    "p3_dependencies": p3_dependencies,
    **{f"p3_level_{name}": _level(name) for name in ARRAY_FIELDS},
    "p5_found": p5_found,
    "p5_targets": _profile("target"),
    "p5_kinds": _profile("kind"),
}

_KEY = r"regexp_replace(replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), chr(92), '/'), '/{{2,}}', '/', 'g')"
_PARENTS = r"""rows_ AS (SELECT nullif(lower(regexp_replace(parent_id, '^\s+|\s+$', '', 'g')), '') p,
       nullif(lower(regexp_replace(child_id, '^\s+|\s+$', '', 'g')), '') c, recorded_at t FROM dag_edges),
 latest AS (SELECT c AS node, p AS parent FROM rows_ WHERE c IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY c ORDER BY t DESC NULLS LAST, p DESC NULLS LAST) = 1),
 par AS (SELECT * FROM latest UNION ALL
   SELECT DISTINCT p, NULL FROM rows_ WHERE p IS NOT NULL AND p NOT IN (SELECT node FROM latest)),
 up(node, anc) AS (SELECT node, parent FROM par WHERE parent IS NOT NULL
   UNION SELECT u.node, q.parent FROM up u JOIN par q ON u.anc = q.node WHERE q.parent IS NOT NULL),
 facts AS (SELECT u.node, count(*) n, bool_or(u.anc = u.node) on_cycle, max(CASE WHEN q.parent IS NULL THEN u.anc END) root
   FROM up u JOIN par q ON u.anc = q.node GROUP BY u.node),
 res AS (SELECT par.node node_id, CASE WHEN par.parent IS NULL THEN par.node ELSE coalesce(f.root, '') END root_id,
   CAST(CASE WHEN par.parent IS NULL THEN 0 WHEN f.on_cycle THEN -1 WHEN f.root IS NULL THEN -2 ELSE f.n END AS BIGINT) depth
   FROM par LEFT JOIN facts f ON f.node = par.node)"""
_ORPHANS = (
    "refs AS (SELECT DISTINCT seq, 'source' endpoint, " + _KEY.format(c="source") + " k, observed_at t FROM edges WHERE source IS NOT NULL"
    " UNION SELECT DISTINCT seq, 'target', " + _KEY.format(c="target") + ", observed_at FROM edges WHERE target IS NOT NULL),"
    " lives AS (SELECT DISTINCT " + _KEY.format(c="id") + " k, created_at b, deleted_at x FROM nodes WHERE id IS NOT NULL),"
    " judged AS (SELECT r.seq, r.endpoint, r.k, r.t, count(l.k) n, coalesce(bool_or(l.b <= r.t AND (l.x IS NULL OR r.t < l.x)), false) alive,"
    " min(l.b) first_b FROM refs r LEFT JOIN lives l ON l.k = r.k GROUP BY ALL),"
    " orphan AS (SELECT DISTINCT seq, endpoint, k, CASE WHEN n = 0 THEN 'missing' WHEN first_b > t THEN 'late' ELSE 'deleted' END reason,"
    " strftime(t, '%Y-%m') period FROM judged WHERE NOT alive)"
)
_PROFILE = """WITH n AS (SELECT count(*) n FROM edges)
SELECT {k} AS value, count(*) AS rows, count(DISTINCT source) AS members, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%f') AS first_at,
 strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%f') AS last_at, count(*) >= 0.02 * (SELECT n FROM n) AS heavy
FROM edges WHERE {k} IS NOT NULL GROUP BY {k}"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_PARENTS} SELECT node_id, root_id, depth FROM res",
    "p1_paths": f"""WITH RECURSIVE {_PARENTS},
 down(node, path) AS (SELECT node, node FROM par WHERE parent IS NULL UNION ALL SELECT p.node, d.path || '/' || p.node FROM down d JOIN par p ON p.parent = d.node)
 SELECT node_id, root_id, depth, coalesce(path, '') AS path FROM res LEFT JOIN down ON down.node = node_id""",
    "p1_descendants": f"""WITH RECURSIVE {_PARENTS}
 SELECT u.anc AS ancestor_id, u.node AS descendant_id, CAST(r.depth - a.depth AS BIGINT) AS distance
 FROM up u JOIN res r ON r.node_id = u.node JOIN res a ON a.node_id = u.anc WHERE r.depth > 0""",
    "p1_cycles": f"""WITH RECURSIVE {_PARENTS}
 SELECT least(min(u.anc), r.node_id) AS cycle_id, r.node_id FROM res r JOIN up u ON u.node = r.node_id WHERE r.depth = -1 GROUP BY r.node_id""",
    "p2_found": f"WITH {_ORPHANS} SELECT DISTINCT seq, endpoint, reason, period FROM orphan",
    "p2_counts": f"""WITH {_ORPHANS} SELECT 'edges' AS table_name, endpoint, period, reason, count(*) AS refs, count(DISTINCT k) AS orphan_keys
 FROM orphan GROUP BY endpoint, period, reason""",
    "p5_found": """WITH n AS (SELECT count(*) n FROM edges), c AS (SELECT 'kind' AS field, kind AS value, count(*) r FROM edges GROUP BY kind
 UNION ALL SELECT 'target', target, count(*) FROM edges GROUP BY target) SELECT field, value FROM c WHERE value IS NOT NULL AND r >= 0.02 * (SELECT n FROM n)""",
    "p5_targets": _PROFILE.format(k="target"),
    "p5_kinds": _PROFILE.format(k="kind"),
}
