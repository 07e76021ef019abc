"""Modules of app projects on small made-up files."""

from loomgraph.operators import modules as M
from loomgraph.sources import manifests
from pyspark.sql import functions as F

FILES = [
    ("//app/build-profile.json5", "{modules: [{name: 'entry', srcPath: './entry', buildOption: {externalNativeOptions: {path: './src/cpp/CMakeLists.txt'}}}, {name: 'util', srcPath: './util',},]}"),
    ("//app/entry/src/main/module.json5", "{module: {name: 'entry', type: 'entry', srcEntry: './ets/A.ets'}}"), ("//app/entry/oh-package.json5", "{name: '@x/entry'}"), ("//lone/oh-package.json5", "{name: 'lone'}"),
    ("//app/util/src/a.ets", ""), ("//app/util/oh_modules/b.ets", ""), ("//app/entry/libs/x/liba.so", ""), ("//cc/CMakeLists.txt", "file(GLOB SRC CONFIGURE_DEPENDS src/*.cpp ${CMAKE_CURRENT_SOURCE_DIR}/m?.c)\nfile(GLOB_RECURSE ALL *.h)"),
    ("//cc/src/a.cpp", ""), ("//cc/src/d/b.cpp", ""), ("//cc/m1.c", ""), ("//cc/x/y/z.h", ""), ("//bad/build-profile.json5", "{modules: "), (None, None),
]


def test_modules_packages_and_files(spark):
    files = spark.createDataFrame([(p, c, p and p.rsplit("/", 1)[1], None) for p, c in FILES] * 2, "path string, content string, name string, id string")
    packages = manifests.hvigor_packages(files)
    modules = M.module_nodes(manifests.build_profiles(files), manifests.module_configs(files), packages).cache()
    assert {(r.id, r.type, r.dir, r.confidence) for r in modules.collect()} == {("module:entry", "hap", "//app/entry", 1.0), ("module:util", "module", "//app/util", 1.0), ("module:lone", "module", "//lone", 0.7)}
    assert {tuple(r) for r in M.package_aliases(modules, packages).collect()} == {("@x/entry", "module:entry"), ("lone", "module:lone")}
    assert [tuple(r) for r in M.native_artifacts(modules, files).collect()] == [("module:entry", "//app/entry/libs/x/liba.so", "liba.so")]
    assert [r.native_path for r in manifests.build_profiles(files).filter("name = 'entry'").distinct().collect()] == ["./src/cpp/CMakeLists.txt"]
    configs = files.filter(manifests.config_kind("path") == "build_profile").select(F.lit("hvigor").alias("ecosystem"), "path")
    assert [tuple(r) for r in M.code_files(configs, files).collect()] == [("hvigor", "//app/util/src/a.ets")]
    assert {tuple(r)[1:] for r in M.expand_globs(manifests.cmake_globs(files), files).collect()} == {("SRC", "//cc/src/a.cpp"), ("SRC", "//cc/m1.c"), ("ALL", "//cc/x/y/z.h")}
    empty = files.limit(0)
    assert M.module_nodes(manifests.build_profiles(empty), manifests.module_configs(empty), manifests.hvigor_packages(empty)).count() == 0


def test_type_upgrades(spark):
    rows = [(None, "har", "har"), ("module", "hap", "hap"), ("har", "hap", "har"), ("module", "module", "module"), ("code", "hap", "code")]
    df = spark.createDataFrame(rows, "old string, new string, want string")
    assert df.filter(M.upgraded(F.col("old"), F.col("new")) != F.col("want")).count() == 0


def test_roots_of_shared_libraries(spark):
    nodes = spark.createDataFrame([(x, "code") for x in "abcz"] + [("t", "shared_library"), ("u", "shared_library")], "id string, type string")
    edges = spark.createDataFrame([("t", "a", "sources"), ("t", "b", "sources"), ("t", "z", "sources"), ("a", "b", "include"), ("b", "c", "include"), ("u", "z", "sources")], "source string, target string, kind string")
    libs = spark.createDataFrame([("lib1", "t"), ("lib2", "u")], "library string, target string")
    assert {tuple(r) for r in M.shared_library_roots(libs, nodes, edges).collect()} == {("lib1", "a"), ("lib2", "z")}
    assert {tuple(r) for r in M.shared_library_roots(libs, nodes, edges, isolated=True).collect()} == {("lib1", "a"), ("lib1", "z"), ("lib2", "z")}
