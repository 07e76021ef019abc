"""Orphans, nested records and heavy keys against plain loops, with dirty rows."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

from loomgraph.operators import nested, orphans, skew
from pyspark.sql import functions as F

T = datetime(2025, 1, 10)
EDGE = "seq bigint, source string, target string, observed_at timestamp"
NODE = "id string, created_at timestamp, deleted_at timestamp"
day = lambda n: T + timedelta(days=n)


def brute(edges, nodes):
    key = lambda s: None if s is None else "/".join(x for x in [""] * s.strip().replace("\\", "/").startswith("/") + [p for p in s.strip().replace("\\", "/").split("/") if p])
    out = set()
    for seq, s, t, at in edges:
        for end, ref in (("source", s), ("target", t)):
            if ref is None:
                continue
            rows = [n for n in nodes if key(n[0]) == key(ref)]
            period = at and at.strftime("%Y-%m")
            if not rows:
                out.add((seq, end, "missing", period))
            elif at and not any(b and b <= at and (d is None or at < d) for _, b, d in rows):
                out.add((seq, end, "late" if all(b is None or b > at for _, b, d in rows) and any(b for _, b, _ in rows) else "deleted", period))
    return out


def test_orphans_against_loops(spark):
    rng = random.Random(3)
    names = [f"//ns/d/f{i}" for i in range(30)]
    spell = lambda s: rng.choice((s, s + " ", s.replace("/", "\\"), s.replace("d/", "d//"), "\t" + s))
    nodes = [(spell(n), day(rng.randint(-20, 20)), rng.choice((None, day(rng.randint(0, 30))))) for n in names[:20] for _ in range(rng.randint(1, 3))]
    nodes += nodes[:5] + [(None, T, None)]
    edges = [(i, spell(names[rng.randrange(30)]) if rng.random() < 0.9 else None, names[0] if i % 3 == 0 else spell(names[rng.randrange(30)]), day(rng.randint(-30, 30))) for i in range(300)]
    edges += edges[:20]
    e, n = spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)
    found = {tuple(r) for r in orphans.find_orphans(e, n).collect()}
    assert found == brute(edges, nodes)
    counts = {(r.endpoint, r.period, r.reason): r.refs for r in orphans.orphan_counts(e, n).collect()}
    assert counts == Counter((end, period, reason) for _, end, reason, period in found)


def test_orphan_edge_cases(spark):
    nodes = spark.createDataFrame([("a", T, None), ("b", T, day(1)), ("c", None, None)], NODE)
    edges = [(1, "a", "b", day(1)), (2, "b", "b", T), (3, "c", "zz", None), (4, " ", None, T), (5, "a", "A", day(-1)), (6, "c", "a", T)]
    got = {tuple(r) for r in orphans.find_orphans(spark.createDataFrame(edges, EDGE), nodes).collect()}
    # the end of a life isn't part of it; without a time only missing can be told; a blank id is an id; case matters
    assert got == {(1, "target", "deleted", "2025-01"), (3, "source", "deleted", None), (3, "target", "missing", None), (4, "source", "missing", "2025-01"), (5, "source", "late", "2025-01"), (5, "target", "missing", "2025-01"), (6, "source", "deleted", "2025-01")}
    for e, n in ((edges[:0], [("a", T, None)]), (edges, [])):
        assert orphans.find_orphans(spark.createDataFrame(e, EDGE), spark.createDataFrame(n, NODE)).count() == (11 if e else 0)


ARRAYS = ("targets", "inputs")


def cases(text):
    return sorted((p, parent) for element, _, p, parent, _, _ in nested.objects_in(text, frozenset(ARRAYS)) if element)


def test_nested_places():
    doc = {"attrs": json.dumps({"targets": {"inputs": [{"a": 1}, None, {"b": {"inputs": {"c": 1}}}]}}), "other": {"x": 1}, "abis": [[{"abi": 1}], []], "list": ["{\"k\": [{}]}", "[{}]", "{oops"]}
    assert cases(json.dumps(doc)) == [
        ("abis[0][0]", ""),
        ("attrs.targets[0]", ""),
        ("attrs.targets[0].inputs[0]", "attrs.targets[0]"),
        ("attrs.targets[0].inputs[2]", "attrs.targets[0]"),
        ("attrs.targets[0].inputs[2].b.inputs[0]", "attrs.targets[0].inputs[2]"),
        ("list[0]", ""),
        ("list[0].k[0]", "list[0]"),
        ("list[1][0]", ""),
    ]
    assert cases(json.dumps(json.dumps([{"targets": [{}]}]))) == [("[0]", ""), ("[0].targets[0]", "[0]")]


def test_unreadable_records_have_no_cases():
    for text in (None, "", " ", "null", "3", '{"targets": [{}]', '{"targets": [{}]} x', '{"targets": [NaN, {}]}', "n/a", "[" * 100_000):
        assert cases(text) == []


def test_nested_tables(spark):
    rows = [(1, '{"targets": {"name": "x", "n": 3, "ok": true, "inputs": [{"f": "a"}]}}', "clash"), (1, '{"targets": []}', "clash"), (None, '{"targets": [{"name": null}]}', "clash"), (2, None, None)]
    df = spark.createDataFrame(rows, "seq bigint, data string, owner_id string")
    out = nested.flatten(df, "seq", "data", ARRAYS)
    got = {(r.owner_id, r.table_path, r.object_path, r.parent_path, r.ordinal) for r in out.collect()}
    assert got == {("1", "", "", None, None), ("1", "targets[]", "targets[0]", "", 0), ("1", "targets[].inputs[]", "targets[0].inputs[0]", "targets[0]", 0), (None, "", "", None, None), (None, "targets[]", "targets[0]", "", 0)}
    flat = {(r.owner_id, r.name, r.n) for r in nested.child_table(out, "targets[]", {"name": "string", "n": "int"}).collect()}
    assert flat == {("1", "x", 3), (None, None, None)}
    schema = {(r.table_path, r.field, r.kind, r.seen) for r in nested.merged_schema(df, "seq", "data", ARRAYS).collect()}
    assert schema == {("", "targets", "array", 3), ("targets[]", "name", "text", 1), ("targets[]", "name", "null", 1), ("targets[]", "n", "number", 1), ("targets[]", "ok", "boolean", 1), ("targets[]", "inputs", "array", 1), ("targets[].inputs[]", "f", "text", 1)}
    assert nested.flatten(df.limit(0), "seq", "data", ARRAYS).count() == 0


ODD = [
    '{"targets": [{"n": %s}]}' % ("7" * 5000), '{"a": ' * 5000 + '{"targets": [{}]}' + "}" * 5000, '{"targets": [{"s": "\\ud800"}]}', '{"targets": [{"a": 1, "a": 2}]}',
    '{"targets": [{"s": "1.0", "f": 1.5, "t": "true", "b": true}]}', '{"targets": [{}]} {}', '{"targets": [{}]}]', '{"targets": [{}]},"x":{"y":1}', json.dumps(json.dumps({"inputs": {"k": "[[{}]"}})),
    json.dumps({"k": '{"inputs": {"a": 1, "a": 2}}'}), json.dumps({"k": '{"inputs": [{"n": %s}]}' % ("1" * 2000)}), "[[], [{}, null, [{}]]]", '"x"', '{"": [{"": [{}]}], "a.b": [{}], "c[]": [{}]}', "{" * 50,
]


def test_every_record_as_the_walk_reads_it(spark):
    deep = '{"x": [' * 40 + '{"targets": [{"inputs": {}}]}' + "]}" * 40
    rows = [(str(i), t) for i, t in enumerate([*ODD, deep, None, "", " "])]
    want = {(k, p, parent, i) for k, t in rows for element, _, p, parent, i, _ in nested.objects_in(t, frozenset(ARRAYS)) if element}
    df = spark.createDataFrame(rows, "k string, t string")
    found = nested.flatten(df, "k", "t", ARRAYS, root=False)
    assert {(r.owner_id, r.object_path, r.parent_path, r.ordinal) for r in found.collect()} == want
    assert {"0", "1", "2", "3", "9", "10"} <= {k for k, *_ in want} and not {"5", "6", "7", "14"} & {k for k, *_ in want}
    fields = {r.owner_id: r.fields for r in found.collect() if r.owner_id in ("2", "4")}
    assert fields == {"2": {"s": "?"}, "4": {"s": "1.0", "f": "1.5", "t": "true", "b": "true"}}
    kinds = {(r.field, r.kind) for r in nested.merged_schema(df.filter("k = '4'"), "k", "t", ARRAYS).collect() if r.table_path}
    assert kinds == {("s", "text"), ("f", "number"), ("t", "text"), ("b", "boolean")}


def test_arrays_in_arrays_are_opened_to_the_end(spark):
    df = spark.createDataFrame([("a", '{"k": [[[[[{}]]]]]}')], "k string, t string")
    assert [r.object_path for r in nested.flatten(df, "k", "t", (), root=False).collect()] == ["k[0][0][0][0][0]"]


def test_wide_record(spark):
    text = json.dumps({"targets": [{"i": i} for i in range(50_000)]})
    assert nested.flatten(spark.createDataFrame([("a", text)], "k string, t string"), "k", "t", ARRAYS, root=False).count() == 50_000


def test_heavy_keys_are_exact(spark):
    values = ["hot"] * 400 + ["edge"] * 20 + ["below"] * 19 + [None] * 100 + [f"v{i}" for i in range(461)]
    df = spark.createDataFrame([(v, "k") for v in values], "value string, rows string")
    assert {(r.value, r.rows, r.total) for r in skew.heavy_keys(df.select("value"), "value", 0.02).collect()} == {("hot", 400, 1000), ("edge", 20, 1000)}
    assert skew.heavy_keys(df.limit(0).select("value"), "value", 0.02).count() == 0


def test_profiles_against_counts(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"v{rng.randrange(50)}", rng.choice((None, f"m{rng.randrange(40)}")), day(rng.randrange(50)) if i % 7 else None, 1) for i in range(3000)] + [(None, "m1", T, 1)]
    df = spark.createDataFrame(rows, "value string, m string, t timestamp, rows int")
    got = {r.value: (r.rows, r.members, r.first_at, r.last_at, r.heavy) for r in skew.per_key_profile(df, F.col("value"), F.col("m"), F.col("t"), 0.1).collect()}
    want = {}
    for v in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == v]
        times = [r[2] for r in own if r[2]]
        want[v] = (len(own), len({r[1] for r in own if r[1]}), min(times, default=None), max(times, default=None), v == "hot")
    assert got == want


def test_split_lookup_keeps_every_row(spark):
    facts = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(500)] + [(None, -1)], "k string, i int")
    lookup = spark.createDataFrame([("hot", "h"), ("k2", "two"), ("unused", "u")], "k string, v string")
    left = {(r.k, r.i, r.v) for r in skew.split_lookup(facts, lookup, "k").collect()}
    assert left == {("hot", i, "h") for i in range(1, 500, 2)} | {(f"k{i}", i, "two" if i == 2 else None) for i in range(0, 500, 2)} | {(None, -1, None)}
    assert skew.split_lookup(facts, lookup, "k", how="inner").count() == 251


def test_every_array_level_has_a_whole_child_table(spark):
    from loomgraph.plans import repair

    base = "/root/testdata/sf0.001"
    found = repair.p3_found(spark, base).count()
    tables = {name: repair.QUERIES[f"p3_level_{name}"](spark, base) for name in repair.ARRAY_FIELDS}
    assert found > 0 and sum(t.count() for t in tables.values()) == found
    assert {"name", "version", "scope"} <= set(tables["dependencies"].columns)


def test_dependencies_of_any_layout(spark, tmp_path):
    from loomgraph.plans import repair

    rows = [(1, '{"dependencies": [{"name": "a", "version": "1.10"}]}'), (2, '{"graph": {"dependencies": {"name": "b", "Owner_ID": 3}}}'), (3, '{"my_dependencies": [{"name": "c"}]}')]
    spark.createDataFrame(rows, "seq bigint, data string").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([("g", '{"dependencies": [{"name": "d", "issues": null}]}')], "graph_id string, summary string").write.parquet(f"{tmp_path}/registry.parquet")
    got = {(r.owner_id, r.object_path, r.name, r.version) for r in repair.p3_dependencies(spark, str(tmp_path)).collect()}
    assert got == {("1", "dependencies[0]", "a", "1.10"), ("2", "graph.dependencies[0]", "b", None)}
    both = repair.QUERIES["p3_level_dependencies"](spark, str(tmp_path))
    assert both.columns == ["owner_table", "owner_id", "object_path", "parent_path", "ordinal", "Owner_ID_", "name", "version"]
    assert {(r.owner_table, r.owner_id, r.name) for r in both.collect()} == {("nodes", "1", "a"), ("nodes", "2", "b"), ("registry", "g", "d")}
