"""The construct graph as two DataFrames, built from delivered rows, and its basic reads and writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.ids import node_key
from .functions.vocab import ALL_TYPES, EDGE_KINDS, NODE_TYPES

NODE_FIELDS = ("type", "graph_id", "src_path", "name", "parser_name", "child_graph_id", "external_graph_id", "include_dirs", "native_dirs", "source_roots", "confidence")


def canonical_id(c: Column | str) -> Column:
    """The id as the model writes it: one spelling, two leading separators for paths."""
    return F.regexp_replace(node_key(c), "^/", "//")


def enum_value(c: Column | str, known: tuple[str, ...], otherwise: str) -> Column:
    """A value of an enumeration whatever its case, blanks and hyphens; unknown ones and null as ``otherwise``."""
    v = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    return F.when(v.isin(*known), v).otherwise(otherwise)


def unit(c: Column | str) -> Column:
    """A confidence within 0 and 1; null counts as certain."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(1.0))))


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row per id: insert if absent, so the first row by ``seq`` (then arrival) wins.

    Types outside the enumeration become ``unknown``; null ids are no nodes.
    """
    first = F.min(F.struct("seq", "ingested_at", *NODE_FIELDS)).alias("f")
    one = rows.filter(F.col("id").isNotNull()).groupBy(canonical_id("id").alias("id")).agg(first)
    return one.select("id", "f.seq", *[f"f.{c}" for c in NODE_FIELDS]).withColumns({"type": enum_value("type", ALL_TYPES, "unknown"), "confidence": unit("confidence")})


def append_edges(rows: DataFrame) -> DataFrame:
    """One row per ``seq``; kinds outside the enumeration become ``depends_on``; rows without an endpoint are left out."""
    fields = ("graph_id", "source", "target", "kind", "parser_name", "confidence", "derived_from")
    one = rows.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("seq").agg(F.min(F.struct("ingested_at", *fields)).alias("f"))
    return one.select("seq", *[f"f.{c}" for c in fields]).withColumns(
        {"source": canonical_id("source"), "target": canonical_id("target"), "kind": enum_value("kind", EDGE_KINDS, "depends_on"), "confidence": unit("confidence")}
    )


def edge_keys(edges: DataFrame) -> DataFrame:
    """``key`` numbers parallel edges of one source and target, in the order of ``seq``.

    A window over each pair: as long as a pair has few edges. The hot target is no hot group here,
    since its edges come from many sources.
    """
    from pyspark.sql import Window

    return edges.withColumn("key", (F.row_number().over(Window.partitionBy("source", "target").orderBy("seq")) - 1).cast("int"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Every id that an edge names, once."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


@dataclass(frozen=True)
class Graph:
    """Nodes keyed by ``id`` and directed multi-edges ``source, target, kind``."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def build(nodes: DataFrame, edges: DataFrame) -> Graph:
        return Graph(upsert_nodes(nodes), append_edges(edges))

    def provisional(self) -> DataFrame:
        """Endpoints that no node row names; they become nodes of type ``unknown``."""
        return endpoints(self.edges).join(self.nodes.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("type"), F.lit(True).alias("provisional"))

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.filter(F.col("type").isin(*types))

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def degrees(self) -> DataFrame:
        """``id, in_degree, out_degree`` of all nodes, parallel edges counted; one shuffle of the edges."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        per = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return self.nodes.select("id").join(per, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")])

    def neighbours(self) -> DataFrame:
        """``id, successors, predecessors``: distinct ones, for every node with an edge."""
        pair = self.edges.select("source", "target").distinct()
        ends = pair.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col("target").alias("id"), F.lit(0).alias("s"), F.lit(1).alias("p")))).alias("x")).select("x.*")
        return ends.groupBy("id").agg(F.sum("s").alias("successors"), F.sum("p").alias("predecessors"))

    def isolated(self) -> DataFrame:
        return self.nodes.join(endpoints(self.edges), "id", "left_anti")

    def in_degree_zero(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("target").alias("id")), "id", "left_anti")

    def roots(self) -> DataFrame:
        """Nodes that nothing points at and that point at something."""
        return self.in_degree_zero().join(self.edges.select(F.col("source").alias("id")), "id", "left_semi")

    def subgraph(self, ids: DataFrame) -> Graph:
        """The nodes of ``ids(id)`` and the edges with both ends among them."""
        keep = ids.select("id").distinct()
        within = self.edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
        return Graph(self.nodes.join(keep, "id", "left_semi"), within)

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Without the nodes of ``ids(id)`` and every edge at them."""
        gone = ids.select("id").distinct()
        rest = self.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), rest)

    def delete_edges(self, pairs: DataFrame) -> Graph:
        """Without the edges of ``pairs(source, target[, key])``."""
        return Graph(self.nodes, self.edges.join(pairs, [c for c in ("source", "target", "key") if c in pairs.columns], "left_anti"))

    def update_nodes(self, changes: DataFrame) -> Graph:
        """Overwrite attributes: ``changes`` has ``id`` and columns of nodes; null leaves the old value."""
        columns = [c for c in changes.columns if c != "id"]
        new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
        merged = self.nodes.join(new, "id", "left")
        return Graph(merged.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns]), self.edges)


def category(c: Column | str) -> Column:
    """The category of a node type."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit("misc")
    for name in reversed([n for n in NODE_TYPES if n != "misc"]):
        out = F.when(c.isin(*NODE_TYPES[name]), name).otherwise(out)
    return out


def edge_kind(kind: Column, label: Column, type_: Column) -> Column:
    """The kind of an edge: its kind, else its label, else its type; empty counts as missing."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(kind), some(label), some(type_))


def search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Nodes whose id, type or name holds ``query`` in any case: the first ``limit`` by id, with a display text."""
    text = F.lower(F.concat_ws(" ", "id", "type", "name"))
    found = nodes.filter(F.contains(text, F.lit(query.lower())))
    return found.select("id", F.concat(F.lit("["), "type", F.lit("] "), F.coalesce("name", "id")).alias("display")).orderBy("id").limit(limit)


def is_external(c: Column) -> Column:
    return c.startswith("//external") | c.startswith("ext_lib:") | c.startswith("//system:")


def proxy_parts(c: Column) -> Column:
    """``graph, node`` of an id ``//proxy:{graph}:{node}``; null for others."""
    parts = F.split(c, ":", 3)
    return F.when(c.startswith("//proxy:") & (F.size(parts) == 3), F.struct(parts[1].alias("graph"), parts[2].alias("node")))


def invalid_nodes(rows: DataFrame) -> DataFrame:
    """``seq, problem`` of node rows that break a rule; a row may have several problems."""
    kind = F.lower(F.trim("type"))
    needs_path = kind.isin("config", "module", "subdirectory") & F.col("src_path").isNull()
    problems = F.array(
        F.when(F.col("id").isNull(), "no id"),
        F.when(~F.coalesce(kind.isin(*ALL_TYPES), F.lit(False)), "unknown type"),
        F.when(needs_path, "no src_path"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"),
    )
    return rows.select("seq", F.explode(F.array_compact(problems)).alias("problem")).distinct()


def invalid_edges(rows: DataFrame) -> DataFrame:
    """``seq, problem`` of edge rows that break a rule."""
    problems = F.array(
        F.when(F.col("source").isNull(), "no source"),
        F.when(F.col("target").isNull(), "no target"),
        F.when(~F.coalesce(F.col("kind").isin(*EDGE_KINDS), F.lit(False)), "unknown kind"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"),
    )
    return rows.select("seq", F.explode(F.array_compact(problems)).alias("problem")).distinct()
