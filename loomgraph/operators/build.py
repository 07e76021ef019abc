"""Build facts as graph edges and contracts, export defaults, and ecosystem plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_key
from ..functions.names import export_id
from .skew import split_lookup

#: Directories beside a build file where its libraries may be put; the last is its own.
OUTPUT_DIRS = ("build/", "lib/", "out/", "")


def _folder(path: str = "path") -> Column:
    return F.regexp_replace(F.regexp_replace(node_key(path), "^/", "//"), "/[^/]*$", "")


def _id(path: str = "path") -> Column:
    return F.regexp_replace(node_key(path), "^/", "//")


def cmake_edges(facts: DataFrame) -> DataFrame:
    """``source, target, kind`` of the facts of CMake files.

    A target ``//dir/CMakeLists.txt:name`` produces ``...:artifact``, has ``sources``, links (a local
    target of the same file, else a placeholder), include directories under ``...:include_dirs`` and may stand for
    another (``alias_of``). External libraries and subdirectories hang on the file. Repeated facts
    give one edge.
    """
    file, here = _id(), _folder()
    target = F.concat(file, F.lit(":"), "subject")
    local = facts.filter("fact = 'target'").select("path", F.col("subject").alias("object"), F.lit(True).alias("local")).distinct()
    marked = facts.join(local, ["path", "object"], "left")
    beside = F.concat(here, F.lit("/"), "object")
    linked = F.when(F.col("local"), F.concat(file, F.lit(":"), "object")).when(F.col("object").startswith("//"), F.col("object")).otherwise(F.concat(F.lit("//external:"), "object"))
    rule = {
        "target": [(target, F.concat(target, F.lit(":artifact")), "produces"), (target, file, "defined_by")],
        "sources": [(target, beside, "sources")],
        "link_libraries": [(target, linked, "link_libraries")],
        "include_dirs": [(target, F.concat(target, F.lit(":include_dirs")), "include_dirs")],
        "alias_of": [(target, F.concat(file, F.lit(":"), "object"), "alias_of")],
        "external_library": [(file, F.concat(F.lit("ext_lib:"), "subject", F.coalesce(F.concat(F.lit("@"), "object"), F.lit(""))), "depends_on")],
        "subdirectory": [(file, F.concat(here, F.lit("/"), "subject"), "contains")],
    }
    made = F.lit(None)
    for fact, edges in rule.items():
        made = F.when(F.col("fact") == fact, F.array(*[F.struct(s.alias("source"), t.alias("target"), F.lit(k).alias("kind")) for s, t, k in edges])).otherwise(made)
    return marked.select(F.explode(made).alias("e")).select("e.*").filter("source is not null and target is not null").distinct()


def cmake_providers(facts: DataFrame) -> DataFrame:
    """``artifact_name, artifact, target, confidence``: where each library target may put ``lib{name}.so``."""
    libs = facts.filter("fact = 'target' and kind in ('shared_library', 'static_library', 'module')").select("path", "subject").distinct()
    name = F.concat(F.lit("lib"), "subject", F.lit(".so"))
    at = F.explode(F.array(*[F.concat(_folder(), F.lit(f"/{d}"), name) for d in OUTPUT_DIRS]))
    return libs.select(name.alias("artifact_name"), at.alias("artifact"), F.concat(_id(), F.lit(":"), "subject").alias("target"), F.lit(0.9).alias("confidence"))


def merge_contracts(pairs: DataFrame) -> DataFrame:
    """Matched halves as whole contracts: united lists, the stronger type, the higher confidence.

    ``pairs`` have ``p`` and ``c`` structs of ``artifact, contract_type, confidence, evidence, metadata``;
    of metadata keys on both sides the consumer's value counts.
    """
    strength = lambda c: F.when(c == "napi", 5).when(c == "extern_c", 4).when(c == "artifact_name", 3).when(c == "config", 2).when(c == "path", 1).otherwise(0)
    p, c = F.col("p"), F.col("c")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    left = F.map_filter(F.coalesce(p["metadata"], none), lambda k, _: ~F.coalesce(F.map_contains_key(c["metadata"], k), F.lit(False)))
    unite = lambda name: F.array_sort(F.array_union(F.coalesce(p[name], F.array().cast("array<string>")), F.coalesce(c[name], F.array().cast("array<string>"))))
    return pairs.select(
        "artifact_name", p["artifact"].alias("provider"), c["artifact"].alias("consumer"),
        F.when(strength(p["contract_type"]) >= strength(c["contract_type"]), p["contract_type"]).otherwise(c["contract_type"]).alias("contract_type"),
        F.greatest(p["confidence"], c["confidence"]).alias("confidence"), unite("evidence").alias("evidence"), F.map_concat(left, F.coalesce(c["metadata"], none)).alias("metadata"),
    )


def maven_edges(facts: DataFrame) -> DataFrame:
    """``source, target, kind``: modules with the file that defines them, the artifact they produce, their modules and dependencies.

    A dependency that is a module of these files is that module, else an external library.
    """
    gav = F.concat(F.coalesce("group_id", F.lit("")), F.lit(":"), "artifact_id")
    module = F.concat(F.lit("module:maven:"), gav)
    own = facts.filter("fact = 'module' and artifact_id is not null")
    known = own.select(gav.alias("target"), F.lit(True).alias("known")).distinct()
    base = own.select(F.explode(F.array(
        F.struct(module.alias("source"), _id().alias("target"), F.lit("defined_by").alias("kind")),
        F.struct(module.alias("source"), F.concat(F.lit("artifact:maven:"), gav, F.lit(":"), "packaging").alias("target"), F.lit("produces").alias("kind")),
    )).alias("e")).select("e.*")
    holds = facts.filter("fact = 'contains'").select(module.alias("source"), F.concat(_folder(), F.lit("/"), "target").alias("target"), F.lit("contains").alias("kind"))
    needs = facts.filter("fact = 'depends_on'").select(module.alias("source"), "target", "target_version").join(known, "target", "left")
    outside = F.concat(F.lit("ext_lib:maven:"), "target", F.coalesce(F.concat(F.lit("@"), "target_version"), F.lit("")))
    needs = needs.select("source", F.when(F.col("known"), F.concat(F.lit("module:maven:"), "target")).otherwise(outside).alias("target"), F.lit("depends_on").alias("kind"))
    return base.unionByName(holds).unionByName(needs).distinct()


def npm_edges(facts: DataFrame) -> DataFrame:
    """``source, target, kind`` of packages: each depends on ``ext_lib:name@spec``; local ones on the folder."""
    module = F.concat(F.lit("module:npm:"), F.coalesce("package", _folder()))
    local = F.concat(_folder(), F.lit("/"), F.regexp_replace("spec", "^file:", ""))
    goal = F.when(F.col("spec").startswith("file:"), local).otherwise(F.concat(F.lit("ext_lib:"), "name", F.lit("@"), "spec"))
    return facts.filter("scope in ('runtime', 'optional')").select(module.alias("source"), goal.alias("target"), F.lit("depends_on").alias("kind")).distinct()


def hvigor_edges(facts: DataFrame) -> DataFrame:
    """``source, target, kind`` of packages; dependencies on packages of these files are local, whatever is asked for.

    Native dependencies (``.so``) are expected once per ABI under ``libs/``.
    """
    abis = F.array(*map(F.lit, ("arm64-v8a", "armeabi-v7a", "x86_64")))
    module = F.concat(F.lit("module:"), F.coalesce("name", _folder()))
    known = facts.filter("fact = 'module' and name is not null").select(F.col("name").alias("target"), F.lit(True).alias("known")).distinct()
    needs = facts.filter("fact in ('depends_on', 'local')").select(module.alias("source"), "target", "spec").join(known, "target", "left")
    out = needs.select("source", F.when(F.col("known"), F.concat(F.lit("module:"), "target")).otherwise(F.concat(F.lit("ext_lib:"), "target", F.lit("@"), "spec")).alias("target"), F.lit("depends_on").alias("kind"))
    native = facts.filter("fact = 'native'").select(module.alias("source"), _folder().alias("at"), F.substring_index("spec", "/", -1).alias("file"), F.explode(abis).alias("abi"))
    native = native.select("source", F.concat("at", F.lit("/libs/"), "abi", F.lit("/"), "file").alias("target"), F.lit("consumes").alias("kind"))
    return out.unionByName(native).distinct()


def resolve_java(imports: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """``file, imported, target, confidence``: the file of a class below a source root of the same repository, else ``java_import:``.

    ``imports(file, imported)``, ``files(id)`` and ``roots(repo, root)`` hold path ids; of several roots the
    least path counts.
    """
    place = F.replace("imported", F.lit("."), F.lit("/"))
    tries = imports.withColumn("repo", F.regexp_extract("file", "^(//[^/]+)/", 1)).join(roots.distinct(), "repo").select("file", "imported", F.concat("root", F.lit("/"), place, F.lit(".java")).alias("id"))
    hit = tries.join(files.select("id").distinct(), "id").groupBy("file", "imported").agg(F.min("id").alias("hit"))
    return imports.join(hit, ["file", "imported"], "left").select("file", "imported", F.coalesce("hit", F.concat(F.lit("java_import:"), "imported")).alias("target"), F.when(F.col("hit").isNotNull(), 0.7).otherwise(0.5).alias("confidence"))


def export_nodes(nodes: DataFrame, keep_targets: bool = True) -> DataFrame:
    """``id, orig_id, type, name, label`` and defaults, as an export writes nodes.

    Libraries and modules get path-like ids. With ``keep_targets`` an id that is a path stays, else the
    node's file takes its place, so that the targets of one file fall together.
    """
    body = lambda p: F.regexp_replace("id", f"^{p}", "")
    own = export_id("id")
    path = own if keep_targets else F.when(F.col("src_path").isNotNull(), export_id(F.concat(F.lit("//"), F.regexp_replace("src_path", "^/+", "")))).otherwise(own)
    new = F.when(F.col("id").startswith("ext_lib:"), F.concat(F.lit("//ext_lib/"), F.replace(body("ext_lib:"), F.lit("/"), F.lit(".")))).when(F.col("id").startswith("module:"), F.concat(F.lit("//module/"), F.replace(body("module:"), F.lit(":"), F.lit("/")))).otherwise(path)
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.when(F.col("src_path") != "", F.substring_index(F.replace("src_path", F.lit("\\"), F.lit("/")), "/", -1)))
    return nodes.select(new.alias("id"), F.col("id").alias("orig_id"), F.coalesce("type", F.lit("unknown")).alias("type"), name.alias("name"), new.alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit("definite").alias("uncertainty_category"))


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between exported ids, with their kind as label; ``nodes`` are those of :func:`export_nodes`."""
    of = nodes.select("orig_id", F.col("id").alias("new"))
    e = split_lookup(edges.select("source", "target", "kind", "confidence"), of.select(F.col("orig_id").alias("target"), F.col("new").alias("t")), "target")
    e = split_lookup(e, of.select(F.col("orig_id").alias("source"), F.col("new").alias("s")), "source")
    return e.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("kind", F.lit("unknown")).alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


@dataclass
class Ecosystem:
    """What a language brings: which files it reads, and its facts and edges as functions of DataFrames."""

    name: str
    facts: Callable[[DataFrame], DataFrame]
    edges: Callable[[DataFrame], DataFrame]
    settings: dict = field(default_factory=dict)


class Ecosystems:
    """A registry of ecosystems; all of them read one table of files."""

    def __init__(self) -> None:
        self.known: dict[str, Ecosystem] = {}

    def register(self, ecosystem: Ecosystem) -> None:
        if ecosystem.name in self.known:
            raise ValueError(f"{ecosystem.name} is registered already")
        self.known[ecosystem.name] = ecosystem

    def edges(self, files: DataFrame) -> DataFrame:
        """``ecosystem, source, target, kind`` of all registered ecosystems."""
        parts = [e.edges(e.facts(files)).select(F.lit(n).alias("ecosystem"), "source", "target", "kind") for n, e in sorted(self.known.items())]
        if not parts:
            raise ValueError("no ecosystem is registered")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def default_ecosystems() -> Ecosystems:
    from ..sources import manifests as m

    out = Ecosystems()
    for name, facts, edges in (("cpp", m.cmake_targets, cmake_edges), ("hvigor", m.hvigor_packages, hvigor_edges), ("maven", m.maven_modules, maven_edges), ("npm", m.npm_dependencies, npm_edges)):
        out.register(Ecosystem(name, facts, edges))
    return out
