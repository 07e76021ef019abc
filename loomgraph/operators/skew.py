"""Heavy keys: find them with a mergeable sketch, treat them apart, keep every row.

A frequent-items sketch of a column is small, whatever the table holds, and it never misses a
key above its error bound. All operators here use it in the same way: the keys it names are at
most ``1 / share`` many, so what belongs to them may be broadcast; everything else takes an
ordinary shuffle, and a union puts the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items a sketch tracks. Its count of a key is off by at most about rows / (0.75 * TRACKED).
TRACKED = 4096
#: First-level sketches are merged in so many groups before the last merge.
MERGE_GROUPS = 64


def _likely(df: DataFrame, key: str, share: float, groups: list[str]) -> DataFrame:
    """``[groups,] __h, total``: hashes of the keys that may reach the share, from one pass over ``df``.

    The sketch is over 64-bit hashes, so its size doesn't depend on the length of the values. At
    most ``1 / (share - error)`` hashes can reach the share: the proven bound of all broadcasts here.
    """
    if not 0.001 <= share <= 1:
        raise ValueError("share must be from 0.001 to 1")
    k = min(TRACKED // 2, int(2 / share) + 16)
    hashed = df.select(*groups, F.when(F.col(key).isNotNull(), F.xxhash64(key)).alias("__h"))
    part = (F.spark_partition_id() % MERGE_GROUPS).alias("__g")
    sketch = (
        hashed.groupBy(*groups, part)
        .agg(F.expr(f"approx_top_k_accumulate(__h, {TRACKED})").alias("__s"), F.count(F.lit(1)).alias("__n"))
        # grouped by a constant where there are no groups: no input then gives no row
        .groupBy(*(groups or [F.lit(0).alias("__all")]))
        .agg(F.expr(f"approx_top_k_combine(__s, {TRACKED})").alias("__s"), F.sum("__n").alias("total"))
    )
    return (
        sketch.select(*groups, "total", F.explode(F.expr(f"approx_top_k_estimate(__s, {k})")).alias("__e"))
        .select(*groups, "total", F.col("__e.item").alias("__h"), F.col("__e.count").alias("__c"))
        .filter(F.col("__h").isNotNull() & (F.col("__c") >= F.col("total") * (share - 2.0 / TRACKED)))
        .drop("__c")
    )


def heavy_keys(df: DataFrame, key: str, share: float, by: str | None = None) -> DataFrame:
    """The values of ``key`` that hold at least ``share`` of the rows (of each ``by`` value).

    Returns ``[by,] key, rows, total``, all exact: the sketch names the candidates, a second pass
    counts them. Values that share a hash are told apart by that count. Null keys are no values,
    but their rows count in ``total``. An empty table gives no rows.
    """
    groups = [by] if by else []
    near = df.select(*groups, key, F.xxhash64(key).alias("__h")).filter(F.col(key).isNotNull())
    near = near.join(F.broadcast(_likely(df, key, share, groups)), [*groups, "__h"])
    counted = near.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("rows"), F.first("total").alias("total"))
    return counted.filter(F.col("rows") >= F.col("total") * F.lit(share))


def split_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, share: float = 0.01, how: str = "left"
) -> DataFrame:
    """``facts`` join ``lookup`` on ``key``, where few keys may hold most of ``facts``.

    ``lookup`` has at most one row per key. Heavy keys of ``facts`` (at most about ``1 / share``)
    are broadcast together with their one row of ``lookup``, so their facts stay where they are;
    the others are shuffled. ``how`` is ``left`` or ``inner``. Null keys match nothing.
    """
    heavy = F.broadcast(_likely(facts.select(key), key, share, []).select("__h", F.lit(True).alias("__heavy")))
    marked = facts.withColumn("__h", F.xxhash64(key)).join(heavy, "__h", "left").drop("__h")
    hot_rows = lookup.withColumn("__h", F.xxhash64(key)).join(heavy, "__h", "left_semi").drop("__h")
    hot = marked.filter(F.col("__heavy")).drop("__heavy").join(F.broadcast(hot_rows), key, how)
    rest = marked.filter(F.col("__heavy").isNull()).drop("__heavy").join(lookup, key, how)
    return hot.unionByName(rest)


def per_key_profile(
    df: DataFrame, key: Column, member: Column, at: Column, share: float = 0.02, salts: int = 64
) -> DataFrame:
    """Rows, distinct members, first and last time of every key, however uneven the keys are.

    Returns ``value, rows, members, first_at, last_at, heavy``; one row per non-null key.
    Null members count as no member, null times are ignored.

    Keys with at least ``share`` of the rows are found by :func:`heavy_keys` and picked out by a
    broadcast join; their rows are spread by a salt that is a function of the member, so that the
    distinct counts of the salts add up. All other keys take one ordinary aggregation. No task
    gets more than its part of a key.
    """
    rows = df.select(key.alias("value"), member.alias("__m"), at.alias("__t")).filter(F.col("value").isNotNull())
    heavy = F.broadcast(heavy_keys(df.select(key.alias("value")), "value", share).select("value"))
    salted = (
        rows.join(heavy, "value")
        .groupBy("value", F.pmod(F.xxhash64("__m"), F.lit(salts)).alias("__salt"), "__m")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("lo"), F.max("__t").alias("hi"))
        .groupBy("value", "__salt")
        .agg(F.sum("n").alias("n"), F.count("__m").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("value")
        .agg(F.sum("n").alias("rows"), F.sum("d").alias("members"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))
        .withColumn("heavy", F.lit(True))
    )
    light = (
        rows.join(heavy, "value", "left_anti")
        .groupBy("value", "__m")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("lo"), F.max("__t").alias("hi"))
        .groupBy("value")
        .agg(F.sum("n").alias("rows"), F.count("__m").alias("members"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))
        .withColumn("heavy", F.lit(False))
    )
    return salted.unionByName(light)
