"""Graphs and file trees as DataFrames, and back."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import workspace_id
from ..graph import NODE_FIELDS, Graph

# Directories of version control that a scan never enters.
VCS = (".git", ".hg", ".svn")
NODE_JSON = "id string, type string, src_path string, name string, graph_id string, child_graph_id string, confidence double"
EDGE_JSON = "source string, target string, key int, kind string, parser_name string, confidence double"


def ignore_regex(pattern: str) -> str:
    """One line of an ignore file as a regular expression over relative paths; empty if it names nothing."""
    line = pattern.strip()
    if not line or line.startswith(("#", "!")):
        return ""
    rooted, line = line.startswith("/"), line.strip("/")
    body = fnmatch.translate(line).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z")
    return rf"{'^' if rooted or '/' in line else '(^|.*/)'}{body}(/.*)?$"


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*",), ignored: tuple[str, ...] = (), namespace: str | None = None) -> DataFrame:
    """``id, path, name, length, content`` of the files below ``root`` whose names match a pattern.

    Listing and reading run on the cluster. Lines of ignore files and the folders of version control
    are left out. ``content`` is text; bytes that aren't UTF-8 become replacement characters.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    inside = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)
    rows = rows.select(path.alias("path"), inside.alias("inside"), "length", "content")
    for regex in filter(None, map(ignore_regex, (*VCS, *ignored))):
        rows = rows.filter(~F.col("inside").rlike(regex))
    return rows.select(workspace_id("path", root, namespace).alias("id"), "path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.decode("content", "UTF-8").alias("content"))


def detect(files: DataFrame) -> DataFrame:
    """``files`` with the ecosystem a build file belongs to (null for others); build output is no source."""
    path, name = F.col("path"), F.col("name")
    output = path.rlike(r"/(node_modules|dist|build|out|target|\.next|\.nuxt|coverage|oh_modules)/")
    kind = (
        F.when((name == "CMakeLists.txt") | name.endswith(".cmake"), "cpp")
        .when((name == "package.json") & ~output, "npm")
        .when((name == "pom.xml") & ~path.contains("/target/"), "maven")
        .when(name.isin("oh-package.json5", "oh-package-lock.json5", "build-profile.json5", "hvigorfile.ts", "module.json5", "module.json"), "hvigor")
    )
    return files.withColumn("ecosystem", kind)


def read_node_link(spark: SparkSession, path: str) -> Graph:
    """A graph of node-link JSON files: ``edges`` or ``links``, bare or wrapped in ``graph``."""
    edge, node = T.ArrayType(T.StructType.fromDDL(EDGE_JSON)), T.ArrayType(T.StructType.fromDDL(NODE_JSON))
    inner = T.StructType([T.StructField("nodes", node), T.StructField("edges", edge), T.StructField("links", edge)])
    schema = T.StructType([*inner.fields, T.StructField("graph", inner)])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    nodes = raw.select(F.explode(F.coalesce("nodes", "graph.nodes")).alias("n")).select("n.*")
    edges = raw.select(F.explode(F.coalesce("edges", "links", "graph.edges", "graph.links")).alias("e")).select("e.*")
    return Graph(nodes.filter("id is not null"), edges.filter("source is not null and target is not null"))


def write_node_link(graph: Graph, path: str, name: str) -> None:
    """A graph as JSON lines, in as many parts as it has: one line per node and edge, and one of counts.

    A graph of any size can be written, as nothing is gathered in one place; :func:`read_json_lines` reads it.
    """
    keep = [c for c in ("id", *NODE_FIELDS) if c in graph.nodes.columns]
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("record"), *keep)).alias("value"))
    edges = graph.edges.select(F.to_json(F.struct(F.lit("edge").alias("record"), *graph.edges.columns)).alias("value"))
    counts = graph.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("edges")))
    head = counts.select(F.to_json(F.struct(F.lit("graph").alias("record"), F.lit(name).alias("graph_id"), "nodes", "edges")).alias("value"))
    head.unionByName(nodes).unionByName(edges).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str) -> Graph:
    """What :func:`write_node_link` wrote."""
    text = spark.read.text(path)
    record = F.get_json_object("value", "$.record")
    node = F.from_json("value", NODE_JSON)
    edge = F.from_json("value", EDGE_JSON)
    return Graph(text.filter(record == "node").select(node.alias("n")).select("n.*"), text.filter(record == "edge").select(edge.alias("e")).select("e.*"))


def bundle(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, nodes, edges`` counts and the sources of registered graphs with their parts, for an export of many graphs."""
    n = nodes.filter("graph_id is not null").groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.filter("graph_id is not null").groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    return graphs.select("graph_id").distinct().join(n, "graph_id", "left").join(e, "graph_id", "left").select("graph_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


_GML = re.compile(r'"([^"]*)"|([\[\]])|([^\s\[\]"]+)')


def gml_records(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """``(kind, attributes)`` of the nodes and edges of a GML text."""
    tokens = [m[1] if m[1] is not None else m[2] or m[3] for m in _GML.finditer(text)]
    kinds = ["t" if m[1] is not None else "b" if m[2] else "w" for m in _GML.finditer(text)]
    stack: list[tuple[str, dict[str, str]]] = []
    i = 0
    while i < len(tokens):
        if kinds[i] == "b" and tokens[i] == "]":
            kind, found = stack.pop() if stack else ("", {})
            if kind in ("node", "edge"):
                yield kind, found
            i += 1
        elif i + 1 < len(tokens) and kinds[i + 1] == "b" and tokens[i + 1] == "[":
            stack.append((tokens[i], {}))
            i += 2
        else:
            if stack and i + 1 < len(tokens):
                stack[-1][1][tokens[i]] = tokens[i + 1]
            i += 2


def read_gml(spark: SparkSession, path: str) -> Graph:
    """A graph of GML files; ids are the labels where nodes have them."""
    texts = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["value"]:
                records = list(gml_records(text))
                names = {a["id"]: a.get("label", a["id"]) for k, a in records if k == "node" and "id" in a}
                rows += [("node", names[a["id"]], None, a.get("type")) for k, a in records if k == "node" and "id" in a]
                rows += [("edge", names.get(a["source"], a["source"]), names.get(a["target"], a["target"]), a.get("kind")) for k, a in records if k == "edge" and {"source", "target"} <= set(a)]
            yield pd.DataFrame(rows, columns=["record", "a", "b", "kind"])

    found = texts.mapInPandas(run, "record string, a string, b string, kind string")
    return Graph(found.filter("record = 'node'").select(F.col("a").alias("id"), F.col("kind").alias("type")), found.filter("record = 'edge'").select(F.col("a").alias("source"), F.col("b").alias("target"), "kind"))


def write_gml(graph: Graph, path: str) -> None:
    """A graph as one GML text file, for graphs a single viewer can open."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    nodes = graph.nodes.select(F.lit(1).alias("o"), F.concat(F.lit("  node [ id "), quote("id"), F.lit(" label "), quote("id"), F.lit(" type "), quote("type"), F.lit(" ]")).alias("value"))
    edges = graph.edges.select(F.lit(2).alias("o"), F.concat(F.lit("  edge [ source "), quote("source"), F.lit(" target "), quote("target"), F.lit(" kind "), quote("kind"), F.lit(" ]")).alias("value"))
    spark = graph.nodes.sparkSession
    ends = spark.createDataFrame([(0, "graph [\n  directed 1"), (3, "]")], "o int, value string")
    ends.unionByName(nodes).unionByName(edges).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def load_config(source: str | dict) -> dict:
    """A build configuration: a mapping, a TOML or JSON text, or the path of such a file (driver side)."""
    import json
    import tomllib

    if isinstance(source, dict):
        return source
    if os.path.exists(source):
        with open(source, encoding="utf-8") as f:
            text = f.read()
    else:
        text = source
    return json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
