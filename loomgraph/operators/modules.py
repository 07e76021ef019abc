"""Modules of app projects: their nodes and types, what belongs to them, and what their libraries lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_key
from . import reach
from .project import ancestors

#: Kinds of module files and the types of their nodes.
KINDS = {"entry": "hap", "feature": "hap", "har": "har", "shared": "hsp", "hsp": "hsp"}
#: Folders that hold no code of their own.
FOREIGN = ("node_modules", "oh_modules", "build", "target", "dist", ".git")
#: Code files by ecosystem.
CODE = {"cpp": r"\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$", "npm": r"\.(js|jsx|mjs|cjs|ts|tsx)$", "maven": r"\.java$", "hvigor": r"\.(ets|ts|js)$"}


def _path(c: str = "path") -> Column:
    return F.regexp_replace(node_key(c), "^/", "//")


def _folder(c: str = "path") -> Column:
    return F.regexp_replace(_path(c), "/[^/]*$", "")


def _below(folder: Column, sub: Column) -> Column:
    return F.regexp_replace(F.concat(folder, F.lit("/"), F.regexp_replace(F.coalesce(sub, F.lit("")), r"^(\./)+", "")), r"(/\.)*/*$", "")


def module_type(kind: Column | str) -> Column:
    """The type of a module's node: hap, har, hsp, or module for any other kind."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(F.lower(kind) == k, v).otherwise(out)
    return F.coalesce(out, F.lit("module"))


def upgraded(old: Column, new: Column) -> Column:
    """A node's type after another file has named it: ``module`` gives way to hap, har and hsp, nothing else does."""
    return F.when(old.isNull() | ((old == "module") & new.isin("hap", "har", "hsp")), new).otherwise(old)


def module_nodes(profiles: DataFrame, configs: DataFrame, packages: DataFrame) -> DataFrame:
    """``id, type, name, dir, confidence, over_approx`` of the modules of build profiles and module files.

    ``profiles`` and ``configs`` are those of :mod:`~loomgraph.sources.manifests`, ``packages`` have
    ``path``. A module file belongs to the module whose folder is the nearest above it; its kind
    upgrades the type. A package folder with no module in or below it is inferred to be a root module.
    Null names and repeated files give no further rows.
    """
    stated = profiles.filter("name is not null").select("name", _below(_folder(), F.col("src_path")).alias("dir")).distinct()
    at = configs.select(_folder().alias("at"), "name", module_type("kind").alias("type"))
    above = at.select("at", "type", F.explode(F.concat(F.transform(ancestors(F.col("at")), lambda x: x["dir"]), F.array("at"))).alias("dir")).join(stated, "dir")
    kinds = above.groupBy("at").agg(F.max_by(F.struct("dir", "type"), F.length("dir")).alias("m")).select("m.dir", "m.type").groupBy("dir").agg(F.max(F.when(F.col("type") != "module", F.col("type"))).alias("type"))
    named = stated.join(kinds, "dir", "left").select("name", "dir", upgraded(F.lit("module"), F.col("type")).alias("type"), F.lit(1.0).alias("confidence"), F.lit(False).alias("over_approx"))
    alone = at.join(above.select("at").distinct(), "at", "left_anti").filter("name is not null").groupBy("name", F.col("at").alias("dir")).agg(F.max("type").alias("type")).select("name", "dir", "type", F.lit(1.0).alias("confidence"), F.lit(False).alias("over_approx"))
    known = named.unionByName(alone)
    holders = known.select(F.explode(F.concat(F.transform(ancestors(F.col("dir")), lambda x: x["dir"]), F.array("dir"))).alias("dir")).distinct()
    roots = packages.select(_folder().alias("dir")).distinct().join(holders, "dir", "left_anti")
    inferred = roots.select(F.substring_index("dir", "/", -1).alias("name"), "dir", F.lit("module").alias("type"), F.lit(0.7).alias("confidence"), F.lit(True).alias("over_approx"))
    return known.unionByName(inferred).select(F.concat(F.lit("module:"), "name").alias("id"), "type", "name", "dir", "confidence", "over_approx")


def package_aliases(modules: DataFrame, packages: DataFrame) -> DataFrame:
    """``package, id``: the package name that each module's folder states; ``packages`` have ``path, name``."""
    return packages.filter("name is not null").select(_folder().alias("dir"), F.col("name").alias("package")).join(modules.select("dir", "id"), "dir").select("package", "id").distinct()


def native_artifacts(modules: DataFrame, files: DataFrame) -> DataFrame:
    """``id, artifact, name``: shared libraries on disk in or below the folder of a module, of the nearest module only."""
    found = files.select(_path().alias("artifact")).filter(F.col("artifact").endswith(".so")).distinct()
    above = found.select("artifact", F.explode(ancestors(F.col("artifact"))).alias("x")).select("artifact", "x.depth", "x.dir").join(modules.select("dir", "id"), "dir")
    return above.groupBy("artifact").agg(F.max_by("id", "depth").alias("id")).select("id", "artifact", F.substring_index("artifact", "/", -1).alias("name"))


def code_files(configs: DataFrame, files: DataFrame) -> DataFrame:
    """``ecosystem, path``: the code files in or below the folders of build files; ``configs(ecosystem, path)``.

    Folders of other packages and of build results are left out. A file below several build files counts once for each ecosystem.
    """
    dirs = configs.select("ecosystem", _folder().alias("dir")).distinct()
    rest = F.concat(F.lit(r"(^|/)("), F.lit("|".join(d.replace(".", r"\.") for d in FOREIGN)), F.lit(")/"))
    found = files.select(_path().alias("path")).distinct()
    above = found.select("path", F.explode(ancestors(F.col("path"))).alias("x")).select("path", F.col("x.dir").alias("dir")).join(dirs, "dir")
    kept = above.filter(~F.regexp(F.substring(F.col("path"), F.length("dir") + 2, F.lit(1 << 20)), rest))
    wanted = F.lit(False)
    for name, pattern in CODE.items():
        wanted = wanted | ((F.col("ecosystem") == name) & F.col("path").rlike(pattern))
    return kept.filter(wanted).select("ecosystem", "path").distinct()


def accepts(ecosystem: str, path: Column | str) -> Column:
    """Whether a reader of an ecosystem takes a file."""
    return F.coalesce((F.col(path) if isinstance(path, str) else path).rlike(CODE[ecosystem]), F.lit(False))


def expand_globs(globs: DataFrame, files: DataFrame) -> DataFrame:
    """``path, variable, file``: the files that each glob of a CMake file names.

    The part of a pattern before its first sign is a folder, met by equality with the folders above
    each file; only within that folder patterns are matched. ``*`` stays within a folder, unless the glob is a deep one.
    """
    fixed = F.regexp_extract("pattern", r"^([^*?\[]*/)?", 1)
    asked = globs.select("path", "variable", "deep", _below(_folder(), fixed).alias("dir"), F.regexp_replace("pattern", r"^[^*?\[]*/", "").alias("tail")).distinct()
    quoted = F.regexp_replace(F.col("tail"), r"([.+^$(){}|\\])", r"\\$1")
    regex = F.concat(F.when(F.col("deep"), "^(.*/)?").otherwise("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
    found = files.select(_path().alias("file")).distinct()
    above = found.select("file", F.explode(ancestors(F.col("file"))).alias("x")).select("file", F.col("x.dir").alias("dir"))
    return above.join(asked.withColumn("regex", regex), "dir").filter(F.regexp(F.substring(F.col("file"), F.length("dir") + 2, F.lit(1 << 20)), F.col("regex"))).select("path", "variable", "file").distinct()


def shared_library_roots(libraries: DataFrame, nodes: DataFrame, edges: DataFrame, isolated: bool = False) -> DataFrame:
    """``library, root``: the code below the target of a shared library that no other code below it leads to.

    ``libraries`` have ``library, target``. The walk goes over sources and includes. Roots without any
    edge to other code of the target are left out, unless ``isolated`` asks for them or there are no others.
    """
    code = nodes.filter(F.col("type").isin("code", "project_header")).select("id")
    over = edges.filter(F.col("kind").isin("sources", "include", "import", "contains")).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    under = reach.distances(over, libraries.select(F.col("target").alias("id")).distinct()).join(code, "id", "left_semi").select(F.col("origin").alias("target"), "id").distinct()
    inner = over.join(under.withColumnRenamed("id", "src"), "src").join(under.select("target", F.col("id").alias("dst")), ["target", "dst"]).filter("src <> dst").select("target", "src", "dst").distinct()
    roots = under.join(inner.select("target", F.col("dst").alias("id")), ["target", "id"], "left_anti")
    linked = roots.join(inner.select("target", F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True)), ["target", "id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    some = linked.groupBy("target").agg(F.max("linked").alias("some"))
    kept = linked if isolated else linked.join(some, "target").filter("linked or not some")
    return libraries.join(kept.select("target", F.col("id").alias("root")), "target").select("library", "root").distinct()
