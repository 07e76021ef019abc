"""References to records that are missing, gone or created only later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_key
from .skew import split_lookup


def lives_by_key(nodes: DataFrame, id_col: str = "id", born: str = "created_at", died: str = "deleted_at") -> DataFrame:
    """``key, first_born, lives``: one row per node, with its distinct lives.

    A life runs from ``born`` up to, not including, ``died`` (null: it goes on). Rows without id
    name no node; rows without ``born`` tell that the node exists, but are never alive. Redelivered
    rows are one life. The array holds the distinct lives of a single node: it grows with how often
    one node is created anew, not with the rows of the table, as equal rows meet before the
    shuffle.
    """
    rows = nodes.select(node_key(id_col).alias("key"), F.col(born).alias("born"), F.col(died).alias("died")).filter(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.min("born").alias("first_born"), F.collect_set(F.struct("born", "died")).alias("lives"))


def references(edges: DataFrame, endpoints: tuple[str, ...] = ("source", "target"), row_id: str = "seq", at: str = "observed_at") -> DataFrame:
    """``seq, endpoint, key, at``: one row per endpoint that isn't null; one scan of ``edges``."""
    parts = [F.struct(F.lit(e).alias("endpoint"), node_key(e).alias("key")) for e in endpoints]
    return (
        edges.select(F.col(row_id).alias("seq"), F.col(at).alias("at"), F.explode(F.array(*parts)).alias("x"))
        .select("seq", "x.endpoint", "x.key", "at")
        .filter(F.col("key").isNotNull())
    )


def _reason(first_born, lives, at):
    alive = F.exists(lives, lambda x: (x["born"] <= at) & (x["died"].isNull() | (at < x["died"])))
    return (
        F.when(lives.isNull(), "missing")
        .when(F.coalesce(alive, F.lit(False)), None)
        .when(at.isNull() & first_born.isNotNull(), None)
        .when(first_born.isNull() | (first_born <= at), "deleted")
        .otherwise("late")
    )


def _orphan_references(edges: DataFrame, nodes: DataFrame, hot_share: float) -> DataFrame:
    """``seq, endpoint, key, period, reason`` of each orphan reference, without repeats.

    A few targets hold most references: their lives are broadcast (at most about ``1 / hot_share``
    nodes) and their references judged where they are; the others are met by an ordinary shuffle,
    and both parts are put together. Only orphans, a small part of all, are made distinct.
    """
    judged = split_lookup(references(edges), lives_by_key(nodes), "key", hot_share)
    reason = _reason(F.col("first_born"), F.col("lives"), F.col("at"))
    found = judged.select("seq", "endpoint", "key", F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason"))
    return found.filter(F.col("reason").isNotNull()).distinct()


def find_orphans(edges: DataFrame, nodes: DataFrame, hot_share: float = 0.01) -> DataFrame:
    """``seq, endpoint, reason, period`` of each endpoint with no node alive at ``observed_at``.

    ``reason`` is ``missing`` (no row of that id), ``late`` (each row's ``created_at`` is after
    ``observed_at``) or else ``deleted``; ``period`` is the month ``YYYY-MM``. Spellings of one id
    are the same (see :func:`~loomgraph.functions.ids.node_key`); a blank id is an id of its own,
    null endpoints are no references. Without ``observed_at`` only ``missing`` can be told, with a
    null period. Redelivered edges give one row.
    """
    return _orphan_references(edges, nodes, hot_share).select("seq", "endpoint", "reason", "period").distinct()


def orphan_counts(edges: DataFrame, nodes: DataFrame, table: str = "edges", hot_share: float = 0.01) -> DataFrame:
    """``table_name, endpoint, period, reason, refs, orphan_keys`` per table, month and reason.

    The orphan references (distinct by ``seq`` and endpoint) are added up per key and period, then
    over the keys, so a key that holds a third of all rows is a few rows by then; all other
    references have dropped out before anything is made distinct.
    """
    found = _orphan_references(edges, nodes, hot_share).groupBy("endpoint", "period", "reason", "key").agg(F.count(F.lit(1)).alias("n"))
    counted = found.groupBy("endpoint", "period", "reason").agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("orphan_keys"))
    return counted.select(F.lit(table).alias("table_name"), "endpoint", "period", "reason", "refs", "orphan_keys")
