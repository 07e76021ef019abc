"""Graph operators on the small graphs that define them, and against plain loops."""

import random
from pathlib import Path

import pytest
from loomgraph import graph as G
from loomgraph.functions import names as N
from loomgraph.operators import build, labels, linking, project, reach
from loomgraph.sources import graphfiles, manifests
from pyspark.sql import functions as F


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, dst string")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_break_cycles_keeps_outer_edges_and_copies_them(spark):
    e = pairs(spark, ("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "y")).withColumn("kind", F.lit("depends_on"))
    out = {tuple(r) for r in reach.break_cycles(e).collect()}
    cluster = next(s for s, _, k in out if k == "contains")
    assert cluster.startswith("scc:") and len(cluster) == 20
    assert out == {("x", "a", "depends_on"), ("c", "y", "depends_on"), ("x", cluster, "depends_on"), (cluster, "y", "depends_on"), *((cluster, m, "contains") for m in "abc")}


@pytest.mark.parametrize("code", [F.xxhash64, F.length])
@pytest.mark.parametrize("seed", [1, 2])
def test_factored_cycles_equal_those_of_the_pairs(spark, monkeypatch, code, seed):
    monkeypatch.setattr(reach, "PAIRS", 3)
    rng = random.Random(seed)
    node = lambda n: f"n{'x' * (rng.randrange(n) % 5)}{rng.randrange(n)}"
    local = [(node(9), node(9), rng.choice(["depends_on", "include"])) for _ in range(14)] + [("n1", "n2", "depends_on")] * 2
    heads = {(node(9), rng.choice("gh")) for _ in range(8)} | {("n1", "g"), ("n1", "h"), ("n3", "g")}
    tails = {(rng.choice("gh"), node(9)) for _ in range(8)} | {("g", "n2"), ("h", "n2"), ("g", "n3")}
    across = [(s, d, "depends_on") for s, v in heads for w, d in tails if v == w]
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string, kind string")
    want = sorted(tuple(r) for r in reach.break_cycles(edges(local + across).distinct()).collect())
    got = reach.break_factored_cycles(edges(local), spark.createDataFrame(list(heads), "src string, via string"), spark.createDataFrame(list(tails), "via string, dst string"), "depends_on", code)
    assert sorted(tuple(r) for r in got.select("src", "dst", "kind").collect()) == want


def test_merged_acyclic_edges_stores_no_pairs_across_graphs(spark, tmp_path):
    import __spark_entry__ as entry
    import pyarrow.parquet as pq
    from loomgraph.session import cut_folder

    n = 300
    rows = [(i, f"//m/p{i}", "g1", "g2") for i in range(n)] + [(n + i, f"//d/r{i}", "g2", None) for i in range(n)]
    texts = ("src_path", "name", "parser_name", "external_graph_id")
    nodes = spark.createDataFrame(rows, "seq long, id string, graph_id string, child_graph_id string").withColumns({c: F.lit(None).cast("string") for c in texts})
    nodes = nodes.withColumns({c: F.lit(None).cast("array<string>") for c in ("include_dirs", "native_dirs", "source_roots")}).withColumns({"type": F.lit("code"), "confidence": F.lit(1.0), "ingested_at": F.timestamp_seconds("seq")})
    nodes.write.parquet(f"{tmp_path}/nodes.parquet")
    edges = spark.sql("select 1L as seq, 'g2' as graph_id, '//d/r0' as source, '//m/p0' as target, 'import' as kind, cast(null as string) as parser_name, 1.0D as confidence, cast(null as array<string>) as derived_from, timestamp_seconds(1) as ingested_at")
    edges.write.parquet(f"{tmp_path}/edges.parquet")
    files = lambda: {f: pq.read_metadata(f).num_rows for f in Path(cut_folder(spark).removeprefix("file:")).rglob("*.parquet")}
    before = files()
    out = entry.queries()["merged_acyclic_edges"](spark, str(tmp_path))
    stored = {f: k for f, k in files().items() if f not in before}
    assert stored and max(stored.values()) < 10 * n
    # all pairs but that of the cycle, copies of the others to and from the cluster, its members
    assert out.count() == out.distinct().count() == n * n - 1 + 2 * (n - 1) + 2


def test_self_loop_is_no_cluster(spark):
    e = pairs(spark, ("solo", "solo"), ("origin", "solo")).withColumn("kind", F.lit("depends_on"))
    assert {tuple(r) for r in reach.break_cycles(e).collect()} == {("origin", "solo", "depends_on")}


@pytest.mark.parametrize("local", [reach.LOCAL_CORE, 0])
def test_strong_components(spark, local):
    rng = random.Random(6)
    edges = {(f"n{rng.randrange(24)}", f"n{rng.randrange(24)}") for _ in range(34)}
    up = {a: {b for x, b in edges if x == a} for a, _ in edges}
    reachable = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for b in up.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reachable[a] = seen
    want = {(a, min(b for b in reachable[a] | {a} if a in reachable.get(b, ()) or a == b)) for a in reachable if a in reachable[a] and any(b != a and a in reachable[b] for b in reachable[a])}
    assert {tuple(r) for r in reach.strong_components(pairs(spark, *edges), local=local).collect()} == want


def test_condensation_numbers_by_size_then_members(spark):
    e = pairs(spark, ("b", "a"), ("a", "b"), ("b", "z"), ("y", "b"))
    of, between = reach.condensation(e, spark.createDataFrame([("a",), ("b",), ("y",), ("z",)], "id string"))
    assert {r.id: r.cluster for r in of.collect()} == {"y": "global_scc:0", "z": "global_scc:1", "a": "global_scc:2", "b": "global_scc:2"}
    assert {tuple(r) for r in between.collect()} == {("global_scc:2", "global_scc:1"), ("global_scc:0", "global_scc:2")}


def test_dead_code(spark):
    nodes = spark.createDataFrame([("hap:app", "hap", "m"), ("cluster", "code_scc_cluster", "m"), ("proxy", "proxy", "m"), ("dep", "external_library", "d"), ("unused", "code", "m"), ("unused2", "code", "d")], "id string, type string, graph_id string")
    edges = spark.createDataFrame([("cluster", "hap:app", "contains"), ("cluster", "proxy", "contains"), ("proxy", "dep", "depends_on")], "source string, target string, kind string")
    assert ids(project.dead_code(nodes, edges)) == ["unused", "unused2"]
    assert ids(project.dead_code(nodes, edges, "m")) == ["unused"]


def test_levels_and_cycles(spark):
    e = pairs(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("q", "r"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    assert {r.id: r.level for r in reach.levels(e, nodes).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "p": None, "q": None, "r": None}
    assert [tuple(r) for r in reach.simple_cycles(e, 4, 5).collect()] == [("p,q", 2)]


def test_paths_and_ancestors(spark):
    e = pairs(spark, ("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("b", "y"), ("q", "y"))
    assert [tuple(r) for r in reach.shortest_path(e, "r", "x").collect()] == [("r,a,x", 2)]
    assert reach.shortest_path(e, "x", "r").count() == 0
    assert [tuple(r) for r in reach.common_ancestor(e, "x", "y").collect()] == [("b", 1, 1)]
    assert ids(reach.reach(e, spark.createDataFrame([("b",)], "id string"))) == ["b", "x", "y"]


def test_weak_components(spark):
    e = pairs(spark, *[(f"c{i:02}", f"c{i + 1:02}") for i in range(30)], ("z", "y"), ("s", "s"))
    got = {r.id: r.component for r in reach.weak_components(e).collect()}
    assert got == {f"c{i:02}": "c00" for i in range(31)} | {"y": "y", "z": "y"}


def test_ranks_of_a_hot_key(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i) for i in range(300)], "k string, seq int")
    got = {}
    for r in linking.ranked(df, "k", "seq", "n").collect():
        got.setdefault(r.k, []).append((r.seq, r.n))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_nodes_and_edges_are_cleaned(spark):
    nodes = spark.createDataFrame([(2, " //a//b ", "CODE", 2.0), (1, "\\\\a\\b", "module", None), (3, None, "code", 0.5), (4, "x", "thing", -1.0)], "seq int, id string, type string, confidence double")
    for c in G.NODE_FIELDS:
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("array<string>" if c in ("include_dirs", "native_dirs", "source_roots") else "string"))
    got = {r.id: (r.seq, r.type, r.confidence) for r in G.upsert_nodes(nodes.withColumn("ingested_at", F.current_timestamp())).collect()}
    assert got == {"//a/b": (1, "module", 1.0), "x": (4, "unknown", 0.0)}


def test_linkage_and_certainty(spark):
    nodes = spark.createDataFrame([("s", "shared_library", None, 0.7), ("t", "static_library", "g", 0.95), ("h", "har", None, 0.2)], "id string, type string, child_graph_id string, confidence double")
    edges = spark.createDataFrame([("a", "s", 0, "links", 0.9, None), ("a", "t", 0, "link_libraries", 0.4, None), ("a", "h", 0, "links", 1.0, None), ("a", "none", 0, "links", 1.0, None), ("a", "t", 1, "links", None, "static")], "source string, target string, key int, kind string, confidence double, linkage_type string")
    assert {r.edge_id: r.linkage_type for r in labels.linkage(edges, nodes).collect()} == {"a->s:0": "dynamic", "a->t:0": "unknown", "a->h:0": "dynamic", "a->none:0": "unknown", "a->t:1": "static"}
    assert {r.id: (r.uncertainty_category, r.reasons) for r in labels.node_certainty(nodes).collect()} == {"s": ("probable", []), "t": ("conditional", ["proxy_reference"]), "h": ("conditional", [])}


def test_placeholders_meet_headers(spark):
    nodes = spark.createDataFrame([("//inc/sub/h.h", "code", None), ("//other/h.h", "code", None), ("lib", "shared_library", ["/inc"]), ("//c.c", "code", None)], "id string, type string, include_dirs array<string>")
    edges = spark.createDataFrame([("//c.c", "//include:h.h", "include"), ("lib", "//c.c", "sources")], "source string, target string, kind string")
    out = project.include_placeholders(nodes, edges, project.part_of(edges)).collect()
    assert [(r.source, r.target, r.confidence) for r in out] == [("//inc/sub/h.h", "lib", 0.75)]


def test_fusing_twice_changes_nothing(spark):
    df = spark.createDataFrame([("a", "b", "affects", "fallback:x", 0.5, None), ("a", "b", "affects", "y", 0.8, 2), ("c", "d", "part_of", "y", 1.0, 1)], "source string, target string, kind string, derived_from string, confidence double, hops int")
    got = {(r.source, tuple(r.derived_from), r.confidence, r.hops, r.fallback, tuple(r.rules)) for r in project.fuse(df).collect()}
    assert got == {("a", ("fallback:x", "y"), 0.8, None, True, ("x",)), ("c", ("y",), 1.0, 1, False, ())}


def test_native_implementations(spark):
    c = spark.createDataFrame([(["a.c", "none.c"], ["a.d.ts"])], "impl_files array<string>, interface_files array<string>")
    assert [(r.source, r.target) for r in linking.native_implementations(c, spark.createDataFrame([("a.c",), ("a.d.ts",)], "id string")).collect()] == [("a.c", "a.d.ts")]


def test_packages_and_versions(spark):
    p = spark.createDataFrame([("@ohos/a", "i1", 2), ("@ohos/a", "i0", 1), ("x", "i2", 3)], "name string, id string, seq int")
    names = spark.createDataFrame([("@ohos/a",), ("x/y/z",), ("q",)], "module string")
    assert {tuple(r) for r in linking.resolve_packages(names, p).collect()} == {("@ohos/a", "i0"), ("x/y/z", "i2")}
    known = spark.createDataFrame([("a", v) for v in ("1.0.0", "1.2.3", "1.10.0", "2.0.0", "2.1.0-beta", "0.3.1", "0.3.9", "0.4.0")], "name string, version string")
    asked = {"^1.0.0": "1.10.0", "~1.2.0": "1.2.3", "1.x": "1.10.0", "1.2.x": "1.2.3", "^0.3.1": "0.3.9", ">=1.0.0 <2.0.0": "1.10.0", "1.2.3": "1.2.3", "9.9.9": "2.1.0-beta", "*": "2.1.0-beta", "^2.0.0": "2.1.0-beta"}
    got = {r.spec: r.version for r in linking.resolve_versions(spark.createDataFrame([("a", s) for s in asked], "name string, spec string"), known).collect()}
    assert got == asked


def test_relative_modules(spark):
    files = spark.createDataFrame([("//n/a/b.ts",), ("//n/c/index.ets",), ("//n/a.b.ts",)], "id string")
    imports = spark.createDataFrame([("//n/a/x.ts", m) for m in ("./b", "../c", "../a.b", "./none", "pkg")], "file string, module string")
    assert {r.module: r.target for r in linking.resolve_modules(imports, files).collect()} == {"./b": "//n/a/b.ts", "../c": "//n/c/index.ets", "../a.b": "//n/a.b.ts", "./none": None}


def test_names(spark):
    df = spark.createDataFrame([("//a:b/@s:c//d ", "github:a/b", "https://x/y", "a/../b", "import '@ohos.x'; import y from \"z\"; System.loadLibrary(\"n\")")], "id string, g string, u string, p string, t string")
    r = df.select(N.export_id("id").alias("a"), N.namespaced("id", F.lit("ns")).alias("b"), N.git_url("g").alias("c"), N.safe_url("u").alias("d"), N.safe_path("p").alias("e"), N.ets_imports("t").alias("f"), N.native_libraries("t").alias("g2"), N.dependency_class(F.lit("file:../x")).alias("h")).first()
    assert tuple(r) == ("//a/b/@s:c/d", "//dep/ns/a/b/@s/c//d ", "https://github.com/a/b.git", True, False, ["z"], ["n"], "local")


def test_graph_files(spark, tmp_path):
    text = '{"graph": {"nodes": [{"id": "a", "type": "code"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "kind": "include"}]}}'
    (tmp_path / "g.json").write_text(text)
    g = graphfiles.read_node_link(spark, str(tmp_path / "g.json"))
    assert ids(g.nodes) == ["a", "b"] and g.edges.first().kind == "include"
    graphfiles.write_node_link(g, str(tmp_path / "lines"), "g")
    back = graphfiles.read_json_lines(spark, str(tmp_path / "lines"))
    assert ids(back.nodes) == ["a", "b"] and back.edges.count() == 1
    graphfiles.write_gml(g, str(tmp_path / "gml"))
    gml = graphfiles.read_gml(spark, str(tmp_path / "gml"))
    assert ids(gml.nodes) == ["a", "b"] and [(r.source, r.target, r.kind) for r in gml.edges.collect()] == [("a", "b", "include")]


def test_scan_ignores(spark, tmp_path):
    for name in ("a/pom.xml", "a/target/pom.xml", ".git/pom.xml", "b/package.json", "b/node_modules/x/package.json", "b/skip.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    found = graphfiles.detect(graphfiles.scan(spark, str(tmp_path), ("*",), ("*.log", "# note")))
    assert {r.id: r.ecosystem for r in found.collect()} == {"//a/pom.xml": "maven", "//a/target/pom.xml": None, "//b/package.json": "npm", "//b/node_modules/x/package.json": None}


def test_manifests(spark):
    rows = [
        ("//n/CMakeLists.txt", 'project(p)\nset(SRC a.c)\nlist(APPEND SRC b.c)\nadd_library(${PROJECT_NAME} SHARED ${SRC}) # end\ntarget_link_libraries(p PUBLIC z Foo::bar)\nfind_package(Foo 1.2)'),
        ("//n/package.json", '{"name": "n", "version": "1", "dependencies": {"a": "^1"}, "workspaces": {"packages": ["x/*"]}}'), ("//n/package.json", "{broken"), ("//m/pom.xml", "<not"), ("//h/oh-package.json5", "{name: 'h', dependencies: {'@o/x': 'file:../x',},}"),
    ]
    f = spark.createDataFrame(rows, "path string, content string")
    got = {(r.fact, r.subject, r.kind, r.object) for r in manifests.cmake_targets(f).collect()}
    assert got == {("project", "p", None, None), ("target", "p", "shared_library", None), ("sources", "p", "shared_library", "a.c"), ("sources", "p", "shared_library", "b.c"), ("link_libraries", "p", "imported", "Foo::bar"), ("external_library", "Foo", None, "1.2")}
    assert {(r.scope, r.name, r.spec) for r in manifests.npm_dependencies(f).collect()} == {("runtime", "a", "^1"), ("workspace", "x/*", "")}
    assert {(r.fact, r.target) for r in manifests.hvigor_packages(f).collect()} == {("module", None), ("local", "@o/x")}
    assert manifests.maven_modules(f).count() == 0


def test_config():
    assert graphfiles.load_config('{"a": 1}') == graphfiles.load_config("a = 1") == graphfiles.load_config({"a": 1}) == {"a": 1}


def test_build_graph(spark):
    rows = [
        ("//n/CMakeLists.txt", "add_library(aa SHARED x.c)\nadd_executable(b y.c)\ntarget_link_libraries(b aa zz z)\nadd_library(c ALIAS aa)\nfind_package(F 1.2)\nadd_subdirectory(sub)"),
        ("//m/pom.xml", "<project><groupId>com.example</groupId><artifactId>demo</artifactId><modules><module>child</module></modules><dependencies><dependency><groupId>org.sample</groupId><artifactId>lib</artifactId><version>0.1.0</version></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>"),
        ("//p/package.json", '{"name": "p", "dependencies": {"a": "^1", "b": "file:../b"}}'),
        ("//h/oh-package.json5", "{name: 'h', dependencies: {'libx.so': 'file:./types/libx.so', g: '1'}}"), ("//g/oh-package.json5", "{name: 'g'}"),
    ]
    got = {tuple(r)[1:] for r in build.default_ecosystems().edges(spark.createDataFrame(rows, "path string, content string")).collect()}
    f = "//n/CMakeLists.txt"
    assert got == {
        (f"{f}:aa", f"{f}:aa:artifact", "produces"), (f"{f}:b", f"{f}:b:artifact", "produces"), (f"{f}:aa", f, "defined_by"), (f"{f}:b", f, "defined_by"), (f"{f}:aa", "//n/x.c", "sources"), (f"{f}:b", "//n/y.c", "sources"),
        (f"{f}:b", f"{f}:aa", "link_libraries"), (f"{f}:b", "//external:zz", "link_libraries"), (f"{f}:c", f"{f}:aa", "alias_of"), (f, "ext_lib:F@1.2", "depends_on"), (f, "//n/sub", "contains"),
        ("module:maven:com.example:demo", "//m/pom.xml", "defined_by"), ("module:maven:com.example:demo", "artifact:maven:com.example:demo:jar", "produces"), ("module:maven:com.example:demo", "//m/child", "contains"),
        ("module:maven:com.example:demo", "ext_lib:maven:org.sample:lib@0.1.0", "depends_on"), ("module:npm:p", "ext_lib:a@^1", "depends_on"), ("module:npm:p", "//p/../b", "depends_on"), ("module:h", "module:g", "depends_on"),
        ("module:h", "ext_lib:libx.so@file:./types/libx.so", "depends_on"),
    }
    providers = build.cmake_providers(manifests.cmake_targets(spark.createDataFrame(rows[:1], "path string, content string")))
    assert sorted(r.artifact for r in providers.collect()) == ["//n/build/libaa.so", "//n/lib/libaa.so", "//n/libaa.so", "//n/out/libaa.so"]


def test_contracts_merge(spark):
    half = "struct<artifact string, contract_type string, confidence double, evidence array<string>, metadata map<string,string>>"
    df = spark.createDataFrame([("l", ("p", "path", 0.9, ["b", "a"], {"x": "1", "y": "2"}), ("c", "napi", 0.0, ["a"], {"x": "3"})), ("m", ("p", None, 0.1, None, None), ("c", "path", 0.2, None, None))], f"artifact_name string, p {half}, c {half}")
    got = {r.artifact_name: (r.contract_type, r.confidence, r.evidence, r.metadata) for r in build.merge_contracts(df).collect()}
    assert got == {"l": ("napi", 0.9, ["a", "b"], {"x": "3", "y": "2"}), "m": ("path", 0.2, [], {})}


def test_ecosystem_registry():
    reg = build.default_ecosystems()
    assert sorted(reg.known) == ["cpp", "hvigor", "maven", "npm"]
    with pytest.raises(ValueError):
        reg.register(reg.known["npm"])


def test_attributes_and_entries(spark):
    rows = spark.createDataFrame([("a", 1, ["x"], "p", False), ("a", 2, ["y", "x"], None, True), (None, 3, ["z"], "q", True)], "id string, seq int, dirs array<string>, parser string, flag boolean")
    assert [tuple(r) for r in linking.merged_attributes(rows, "id", "seq", ("dirs",), ("parser",), ("flag",)).collect()] == [("a", ["x", "y"], "p", True)]
    nodes = spark.createDataFrame([("n2", 2, "/w/main.js"), ("n1", 1, "\\w\\main.js"), ("n3", 3, None)], "id string, seq int, src_path string")
    assert [tuple(r) for r in linking.entry_points(nodes, spark.createDataFrame([("m", "/w/main.js"), ("k", None)], "module string, path string")).collect()] == [("m", "n1")]
    assert [tuple(r) for r in linking.native_consumers(spark.createDataFrame([("f", "x")], "file string, library string")).collect()] == [("f", "libx.so")]
    done = linking.attach_resolved(nodes.withColumn("child_graph_id", F.lit(None).cast("string")), spark.createDataFrame([("n1", "g", "/p")], "id string, child_graph_id string, resolved_path string"))
    assert {r.id: (r.child_graph_id, r.resolved_path) for r in done.collect()} == {"n1": ("g", "/p"), "n2": (None, None), "n3": (None, None)}


def test_paths_of_ids(spark):
    asked = {"//a/b.c": "/w/r/a/b.c", "//../x": "/w/x", "//a/../../b": None, "//../../x": None, "//external/1/x": None, "ext_lib:a": None}
    df = spark.createDataFrame([(i,) for i in asked], "id string")
    assert {r.id: r.p for r in df.select("id", N.workspace_path("id", "/w/r").alias("p")).collect()} == asked


def test_lock_files(spark):
    old = "{lockfileVersion: 1, dependencies: {'a': {version: '1.0'}, 'l': {version: 'file:../l'},}}"
    new = "{lockfileVersion: 3, packages: {'@o/b@2.1': {name: '@o/b', version: '2.1', registryType: 'ohpm'}, 'l@x': {version: '1', registryType: 'local'}, '@o/c@3': {}}}"
    rows = [("//h/oh-package-lock.json5", old), ("//i/oh-package-lock.json5", new), ("//j/oh-package-lock.json5", "{"), ("//k/other.json5", new)]
    got = {tuple(r) for r in manifests.locked_packages(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("//h/oh-package-lock.json5", "a", "1.0", 1), ("//i/oh-package-lock.json5", "@o/b", "2.1", 3), ("//i/oh-package-lock.json5", "@o/c", "3", 3)}


def test_assets_lead_to_artifacts_at_any_distance(spark, tmp_path):
    import __spark_entry__ as entry

    base = "/root/testdata/sf0.001"
    node, edge = (spark.read.parquet(f"{base}/{t}.parquet").schema for t in ("nodes", "edges"))
    kinds = {"a0": "code", **{f"a{i}": "config" for i in range(1, 7)}, "far": "hap", "near": "target", "h": "project_header", "alone": "code"}
    links = [*((f"a{i}", f"a{i + 1}") for i in range(6)), ("a6", "far"), ("a6", "a2"), ("h", "near"), ("alone", "a7")]
    rows = [{"seq": i, "id": k, "type": t} for i, (k, t) in enumerate(kinds.items())]
    spark.createDataFrame([tuple(r.get(c) for c in node.names) for r in rows], node).write.parquet(f"{tmp_path}/nodes.parquet")
    rows = [{"seq": i, "source": a, "target": b, "kind": "depends_on"} for i, (a, b) in enumerate(links)]
    spark.createDataFrame([tuple(r.get(c) for c in edge.names) for r in rows], edge).write.parquet(f"{tmp_path}/edges.parquet")
    got = {tuple(r) for r in entry.queries()["asset_artifact_map"](spark, str(tmp_path)).collect()}
    assert got == {("a0", "far"), ("h", "near")}


def test_levels_over_chains_joins_and_cycles(spark):
    chain = [(f"k{i}", f"k{i + 1}") for i in range(40)] + [("a", "k0"), ("k10", "k30"), ("k40", "c"), ("k40", "z2"), ("c", "z2")]
    got = {r.id: r.level for r in reach.levels(pairs(spark, *chain), spark.createDataFrame([("a",), ("c",), ("k40",), ("z2",), ("k30",)], "id string")).collect()}
    assert got == {"a": 0, "k30": 31, "k40": 41, "c": 42, "z2": 43}
    e = pairs(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("q", "p"), ("q", "r"))
    nodes = spark.createDataFrame([(x,) for x in "abcpqrz"], "id string")
    assert {r.id: r.level for r in reach.levels(e, nodes).collect()} == {"a": 0, "b": 1, "c": 2, "p": None, "q": None, "r": None, "z": 0}


def test_packages_have_whole_cycles_with_sources_levels_and_paths(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [*((f"p{i}", f"p{i % 6 + 1}") for i in range(1, 7)), ("p3", "p1"), ("P0 ", "p1"), ("p6", "q"), (None, "alone")]
    spark.createDataFrame(rows, "parent_id string, child_id string").write.parquet(f"{tmp_path}/dag_edges.parquet")
    known = [("p1", '{"source": "one"}', 1), ("p2", '{"graph": {"source": "two"}}', 1), ("p3", '"{\\"source\\": \\"three\\"}"', 1), ("p4", '{"sou', 1), ("p1", None, 2)]
    spark.createDataFrame(known, "graph_id string, summary string, t int").selectExpr("graph_id", "summary", "timestamp_seconds(t) as registered_at").write.parquet(f"{tmp_path}/registry.parquet")
    run = lambda q: entry.queries()[q](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("package_cycles")} == {("p1,p2,p3", 3), ("p1,p2,p3,p4,p5,p6", 6)}
    assert {(r.position, r.graph_id, r.source) for r in run("package_cycle_sources") if r.length == 6} == {(0, "p1", "one"), (1, "p2", "two"), (2, "p3", "three"), (3, "p4", "unknown"), (4, "p5", "unknown"), (5, "p6", "unknown")}
    level = {r.id.split(":")[0]: r.level for r in run("package_levels")}
    assert level == {"p0": 0, "scc": 1, **{f"p{i}": 2 for i in range(1, 7)}, "q": 3, "alone": 0}
    assert [tuple(r) for r in run("package_path")] == [("p3,p4,p5,p6,q", 4)]


def test_the_scanner_leaves_comments_and_texts_out(spark):
    from loomgraph.functions import names as N

    js = """// import 'no1'
/* from 'no2' */ import a, {b as c} from "./a"; import './b'
const s = "import 'no3'"; const t = `require('no4')`;
export * from '../c'; const d = require( 'd' ); x.require('no5'); await import("e"); it's; from
"""
    java = "package a.b ;\n/* import no.One; */ import static a.b.C.*; import a.\n b.D;\nString s = \"import no.Two;\"; import x.Y;"
    c = '#include <a.h>\n  # include "b.h"\n// #include <no1.h>\n/*\n#include <no2.h>\n*/\nchar *s = "#include <no3.h>";'
    df = spark.createDataFrame([(js, java, c), (None, None, None), ("", "", "")], "js string, java string, c string")
    rows = df.select(N.js_imports("js").alias("js"), N.java_imports("java").alias("java"), N.java_package("java").alias("p"), N.c_includes("c").alias("c"), N.native_libraries(F.lit('System.loadLibrary("x"); // System.loadLibrary("no");')).alias("n")).collect()
    assert (rows[0].js, rows[0].java, rows[0].p, rows[0].c, rows[0].n) == (["./a", "./b", "../c", "d", "e"], ["a.b.C.*", "a.b.D", "x.Y"], "a.b", ["a.h", "b.h"], ["x"])
    assert not rows[1].js and rows[2].js == [] and rows[2].p is None
