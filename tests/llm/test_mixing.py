"""Shares, caps and the choice of documents."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

M = pytest.importorskip("loomgraph.llm.mixing")


def test_clamped_sources_hand_over_their_part():
    plan = {q.source: q for q in M.water_fill([("a", 0.5, 1, 100), ("b", 0.25, 4, 1000), ("c", 0.25, 4, 1000), ("none", 0.0, 4, 50), ("empty", 0.1, 2, 0)], 1000)}
    assert plan["a"].tokens == 100 and plan["a"].clamped and plan["b"].tokens == plan["c"].tokens == 450
    assert plan["none"].tokens == plan["empty"].tokens == 0 and plan["empty"].clamped and not plan["none"].clamped


def test_all_clamped():
    assert [q.tokens for q in M.water_fill([("a", 0.5, 2, 10), ("b", 0.5, 1, 10)], 1000)] == [20, 10]
    assert M.water_fill([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), st.integers(0, 10_000)), min_size=1, max_size=8), st.integers(0, 50_000))
def test_never_over_the_caps(sources, total):
    plan = M.water_fill([(f"s{i}", *s) for i, s in enumerate(sources)], total)
    assert all(0 <= q.tokens <= q.max_repeats * q.available for q in plan)
    assert sum(q.tokens for q in plan) <= total
    room = sum(q.max_repeats * q.available for q in plan if q.target_share > 0 and q.max_repeats > 0)
    assert sum(q.tokens for q in plan) >= min(total, room) - len(plan)


WORDS = "one two three four five six seven eight nine ten".split()


def corpus(spark, n=400):
    rows = [(i, " ".join(WORDS[: 1 + i % 10]), ("Web Crawl", "web-crawl ", "web_crawl")[i % 3] if i % 4 else "books", 0) for i in range(n)]
    rows += [(n, None, "books", 0), (n + 1, "", "books", 0), (n + 2, "text", None, 0), (n + 3, "text", "other", 0), (n + 4, "text", " ", 0), (None, "text", "books", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")


def weights(spark):
    return spark.createDataFrame([("web_crawl", 0.25, 1), ("books", 0.65, 4), ("missing", 0.1, 3)], "source string, target_share double, max_repeats int")


def test_mixture(spark):
    chosen, shares = M.mix(corpus(spark), weights(spark))
    rows, by = chosen.collect(), {r.source: r for r in shares.collect()}
    assert set(by) == {"web_crawl", "books", "missing"}
    assert all(1 <= r.repeats <= by[r.source].max_repeats and r.tokens > 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    for s in ("web_crawl", "books"):
        own = [r for r in rows if r.source == s]
        assert sum(r.tokens * r.repeats for r in own) == by[s].actual_tokens and len(own) == by[s].used_documents
        assert max(r.repeats for r in own) - min(r.repeats for r in own) <= 1
    assert by["missing"].actual_tokens == 0 and by["missing"].shortfall == by["missing"].target_tokens > 0
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    again = M.mix(corpus(spark).repartition(7), weights(spark))[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    other = M.mix(corpus(spark), weights(spark), seed=5)[0]
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in rows}


def test_rest_is_filled_to_one_document(spark):
    sized = spark.createDataFrame([(i, "s", 1 + i % 10) for i in range(3000)], "doc_id bigint, source string, tokens bigint")
    q = M.Quota("s", 1.0, 3, 16_500, 16_500 + 7001, False)
    rows = M.choose(sized, [q], "doc_id").collect()
    used = sum(r.tokens * r.repeats for r in rows)
    assert len(rows) == 3000 and q.tokens - 10 < used <= q.tokens


def test_empty(spark):
    chosen, shares = M.mix(corpus(spark).limit(0), weights(spark))
    assert chosen.count() == 0 and [r.actual_share for r in shares.collect()] == [0.0] * 3
