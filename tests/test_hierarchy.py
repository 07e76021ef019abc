"""Hierarchies against a walk in memory."""

import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomgraph.operators import hierarchy as H

START = datetime(2025, 1, 1)
SCHEMA = "parent_id string, child_id string, recorded_at timestamp"


def walk(parents):
    out = {}
    for n in parents:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parents[x]
        out[n] = (seen[-1], len(seen) - 1, seen[::-1]) if x is None else ("", -1 if x == n else -2, None)
    return out


def resolve(spark, parents):
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    return {r.node_id: (r.root_id, r.depth, r.path) for r in H.resolve_hierarchy(df, with_path=True).collect()}


def test_forest_with_cycles(spark):
    rng = random.Random(5)
    parents = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(300)}
    parents |= {f"c{i}": f"c{(i + 1) % 7}" for i in range(7)} | {"self": "self", "t0": "c3"} | {f"t{i}": f"t{i - 1}" for i in range(1, 20)}
    parents |= {f"hub{i}": "n1" for i in range(400)}  # one parent of most nodes
    assert resolve(spark, parents) == walk(parents)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 11)), min_size=12, max_size=12))
def test_any_functional_graph(spark, targets):
    parents = {f"n{i}": None if t is None else f"n{t}" for i, t in enumerate(targets)}
    assert resolve(spark, parents) == walk(parents)


def test_latest_row_wins_and_dirt_is_cleaned(spark):
    at = lambda d: START + timedelta(days=d)
    rows = [
        ("A ", "b", at(0)), ("a", "B", at(0)), ("c", "b", at(2)), ("a", "b", at(1)),  # c is the latest
        (None, "d", at(1)), ("a", "d", at(0)),  # d has no parent any more
        ("e", None, at(1)), (None, None, at(1)), ("  ", "f", at(1)),  # e occurs; a blank parent is none
        ("x", "g", None), ("y", "g", at(0)), ("p", "h", at(3)), ("q", "h", at(3)),  # a tie: the greatest parent
    ]
    got = {r.node: r.parent for r in H.latest_parents(spark.createDataFrame(rows, SCHEMA), "parent_id", "child_id", "recorded_at").collect()}
    assert got == {"a": None, "b": "c", "c": None, "d": None, "e": None, "f": None, "x": None, "y": None, "g": "y", "p": None, "q": None, "h": "q"}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    parents = H.latest_parents(empty, "parent_id", "child_id", "recorded_at")
    assert H.resolve_hierarchy(parents).count() == 0
    extra = spark.createDataFrame([("a", "b", START, "n", "p", 1)], SCHEMA + ", node string, parent string, depth int")
    assert H.resolve_hierarchy(H.latest_parents(extra, "parent_id", "child_id", "recorded_at")).count() == 2


def test_descendants_and_cycles(spark):
    parents = {"r": None, "a": "r", "b": "a", "x": "y", "y": "x", "z": "x"}
    df = spark.createDataFrame(list(parents.items()), "node string, parent string")
    done = H.resolve_hierarchy(df, with_path=True)
    assert {tuple(r) for r in H.descendants(done).collect()} == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1)}
    assert {tuple(r) for r in H.cycle_members(df, done).collect()} == {("x", "x"), ("x", "y")}


def test_size_estimates_stay_flat_over_many_rounds(spark):
    from loomgraph.session import cut, release

    df = cut(spark.createDataFrame([(f"n{i}", f"n{i // 2}") for i in range(50)], "node string, anc string"))
    sizes = []
    for _ in range(25):
        new = cut(df.join(df.selectExpr("node as anc", "anc as a2"), "anc").selectExpr("node", "a2 as anc"))
        release(df)
        df = new
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
    assert max(sizes) <= 24
