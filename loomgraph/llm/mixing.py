"""Mixing sources to target shares of all tokens, with a cap on how often a document is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .encode import TOKENIZERS, VOCABULARY, count_tokens

#: Documents of a source are put in a seeded order through so many buckets of their hashes.
BUCKETS = 1 << 14


def source_key(c: Column | str) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and hyphens as underscores. Blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")
    return F.when(k != "", k)


@dataclass(frozen=True)
class Quota:
    source: str
    target_share: float
    max_repeats: int
    available: int
    tokens: int
    clamped: bool

    @property
    def whole(self) -> int:
        """How often every document of the source is used."""
        return self.tokens // self.available if self.available else 0

    @property
    def rest(self) -> int:
        """The tokens of the last, partial repetition."""
        return self.tokens - self.whole * self.available


def water_fill(sources: list[tuple[str, float, int, int]], total: int | None = None) -> list[Quota]:
    """Tokens of each source ``(name, share, max_repeats, available)``.

    Sources that can't fill their part of ``total`` even at their most repetitions are clamped there;
    what they leave is shared out among the others in proportion to their shares, which may clamp
    further ones, until no part is too large. ``total`` is all available tokens of the sources with
    a positive share, if it isn't given. If all are clamped the mixture is smaller than ``total``.
    """
    ask = {name: share for name, share, cap, have in sources if share and share > 0 and cap and cap > 0}
    room = {name: cap * have for name, share, cap, have in sources if name in ask}
    if total is None:
        total = sum(have for name, _, _, have in sources if name in ask)
    part: dict[str, int] = {}
    open_ = dict(ask)
    left = float(total)
    while open_:
        weight = sum(open_.values())
        full = [name for name, share in open_.items() if left * share / weight >= room[name]]
        if not full:
            part |= {name: min(int(left * share / weight), room[name]) for name, share in open_.items()}
            break
        for name in full:
            part[name] = room[name]
            left -= room[name]
            del open_[name]
    return [Quota(name, share or 0.0, cap or 0, have, part.get(name, 0), name in ask and name not in open_) for name, share, cap, have in sources]


def sized_documents(documents: DataFrame, key: str, text: str, source: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, source, tokens`` with one spelling of each source."""
    rows = documents.select(F.col(key), source_key(source).alias("source"), F.col(text).alias("text"))
    return count_tokens(rows, [key, "source"], "text", folder, vocabulary)


def quotas(sized: DataFrame, weights: DataFrame, total: int | None = None) -> list[Quota]:
    """The quota of each source of ``weights(source, target_share, max_repeats)``, a table of fixed size.

    Sums by source run on the cluster; the driver sees one row per listed source. Listed spellings of
    one source count once, by their greatest share and repeats.
    """
    listed = weights.select(source_key("source").alias("source"), "target_share", "max_repeats").filter(F.col("source").isNotNull())
    listed = listed.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = listed.join(have, "source", "left").orderBy("source").collect()
    return water_fill([(r.source, r.target_share, r.max_repeats, r.available or 0) for r in rows], total)


def choose(sized: DataFrame, plan: list[Quota], key: str, seed: int = 17) -> DataFrame:
    """``key, source, tokens, repeats`` of the chosen documents.

    Every document of a source is used ``whole`` times; for the partial repetition the documents
    are put in an order by a seeded hash, and as many as fit into the rest are used once more. The
    order is cut in two steps, so no source is sorted in one task: first by the sums of the hash
    buckets (at most BUCKETS rows a source), then within the one bucket where the cut falls. What is
    missing of a source's tokens is less than its first document that didn't fit.
    """
    spark = sized.sparkSession
    kept = [q for q in plan if q.tokens > 0]
    schema = "source string, whole bigint, rest bigint"
    table = F.broadcast(spark.createDataFrame([(q.source, q.whole, q.rest) for q in kept], schema))
    order = F.xxhash64(F.lit(seed), F.col(key))
    rows = sized.filter(F.col("tokens") > 0).join(table, "source").withColumn("__h", order).withColumn("__b", F.pmod("__h", F.lit(BUCKETS)))
    sums = rows.groupBy("source", "rest", "__b").agg(F.sum("tokens").alias("t"))
    up_to = F.sum("t").over(Window.partitionBy("source").orderBy("__b"))
    # the buckets before the cut are taken whole, the one where it falls in part
    cuts = sums.withColumn("upto", up_to).select("source", "__b", (F.col("upto") <= F.col("rest")).alias("all"), (F.col("rest") - F.col("upto") + F.col("t")).alias("left")).filter("left > 0")
    marked = rows.join(F.broadcast(cuts), ["source", "__b"], "left")
    edge = marked.filter(~F.coalesce("all", F.lit(True)))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("extra", (running <= F.col("left")).cast("bigint"))
    rest = marked.filter(F.coalesce("all", F.lit(True))).withColumn("extra", F.coalesce("all", F.lit(False)).cast("bigint"))
    return rest.unionByName(edge).select(key, "source", "tokens", (F.col("whole") + F.col("extra")).alias("repeats")).filter("repeats > 0")


def mix(
    documents: DataFrame,
    weights: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    seed: int = 17,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with repeats, and the shares that came of it.

    The first table is that of :func:`choose`; the second has a row per listed source: ``source,
    target_share, max_repeats, documents, available, target_tokens, used_documents, actual_tokens,
    actual_share, shortfall, clamped``. ``target_tokens`` is the target share of the mixture's
    planned size, ``shortfall`` what is missing to it (0 if nothing). Null, blank or unlisted
    sources take no part; texts without tokens are never chosen; an empty table gives no documents
    and shares of 0. A null ``key`` is a document like any other.
    """
    sized = cut(sized_documents(documents, key, text, source, folder, vocabulary))
    plan = quotas(sized, weights, total)
    chosen = choose(sized, plan, key, seed)
    spark = sized.sparkSession
    planned = sum(q.tokens for q in plan) if total is None else total
    schema = "source string, target_share double, max_repeats int, available bigint, target_tokens bigint, clamped boolean"
    listed = spark.createDataFrame([(q.source, float(q.target_share), int(q.max_repeats), q.available, int(planned * q.target_share), q.clamped) for q in plan], schema)
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"))
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = listed.join(have, "source", "left").join(used, "source", "left")
    joined = joined.select("source", "target_share", "max_repeats", zero("documents"), "available", "target_tokens", zero("used_documents"), zero("actual_tokens"), "clamped")
    # one row per listed source: a window over them all is small
    everything = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))
    shares = joined.withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)))
    return chosen, shares.withColumn("shortfall", F.greatest(F.col("target_tokens") - F.col("actual_tokens"), F.lit(0)))
