"""Labels of nodes and edges: how links are made, and how sure the graph is of itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import split_lookup


def linkage(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("links", "link_libraries")) -> DataFrame:
    """``edge_id, linkage_type`` of each link edge (with ``key``): dynamic, static, module or unknown.

    An explicit ``linkage_type`` of the edge wins, if there is such a column. A low confidence (below
    a half), an over-approximation or a missing target is unknown; else the target's type decides.
    Targets are looked up with heavy targets apart.
    """
    explicit = F.col("linkage_type") if "linkage_type" in edges.columns else F.lit(None).cast("string")
    over = F.coalesce(F.col("over_approx"), F.lit(False)) if "over_approx" in edges.columns else F.lit(False)
    links = edges.filter(F.col("kind").isin(*kinds)).select("source", "target", "key", "confidence", explicit.alias("explicit"), over.alias("over"))
    joined = split_lookup(links, nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target")
    by_type = (
        F.when(F.col("target_type").isin("shared_library", "hap", "har", "hsp"), "dynamic")
        .when(F.col("target_type") == "static_library", "static")
        .when(F.col("target_type") == "module", "module")
        .otherwise("unknown")
    )
    verdict = F.coalesce("explicit", F.when(F.col("over") | (F.coalesce("confidence", F.lit(1.0)) < 0.5), "unknown"), by_type)
    return joined.select(F.concat("source", F.lit("->"), "target", F.lit(":"), F.col("key").cast("string")).alias("edge_id"), verdict.alias("linkage_type"))


@dataclass(frozen=True)
class Certainty:
    """Thresholds and switches of the uncertainty labels."""

    definite: float = 0.9
    probable: float = 0.6
    proxies: bool = True
    unresolved: bool = True
    projections: bool = True
    contracts: bool = True


def _default(confidence: Column, pinned: Column, rule: Certainty) -> Column:
    free = pinned.isNull() | pinned.isin("", "definite")
    by = F.when(confidence >= rule.definite, "definite").when(confidence >= rule.probable, "probable").otherwise("conditional")
    return F.when(free, by).otherwise(pinned)


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def node_certainty(nodes: DataFrame, rule: Certainty = Certainty()) -> DataFrame:
    """``id, uncertainty_category, over_approx, reasons`` (sorted) of each node."""
    base = _default(F.coalesce("confidence", F.lit(1.0)), _column(nodes, "uncertainty_category"), rule)
    proxy = F.lit(rule.proxies) & ((F.col("type") == "proxy") | (F.coalesce(_column(nodes, "child_graph_id"), F.lit("")) != ""))
    loose = F.lit(rule.unresolved) & (F.col("type") == "external_dep") & _column(nodes, "resolved_path").isNull()
    proxy, loose = F.coalesce(proxy, F.lit(False)), F.coalesce(loose, F.lit(False))
    reasons = F.array_sort(F.array_compact(F.array(F.when(proxy, "proxy_reference"), F.when(loose, "unresolved_external"))))
    label = F.when(proxy | loose, "conditional").otherwise(base)
    return nodes.select("id", label.alias("uncertainty_category"), (label != "definite").alias("over_approx"), reasons.alias("reasons"))


def edge_certainty(edges: DataFrame, rule: Certainty = Certainty()) -> DataFrame:
    """``seq, uncertainty_category, over_approx, reasons`` of each edge; conditional edges are never made surer."""
    base = _default(F.coalesce("confidence", F.lit(1.0)), _column(edges, "uncertainty_category"), rule)
    from_ = F.coalesce("derived_from", F.array().cast("array<string>"))
    projected = F.coalesce(F.lit(rule.projections) & (F.col("parser_name") == "projection"), F.lit(False))
    bound = F.arrays_overlap(from_, F.array(*map(F.lit, ("build_contract", "contract_binding", "hvigor_shared_library")))) | F.coalesce(F.col("parser_name").isin("global_contract_linker", "hvigor_linker"), F.lit(False))
    bound = F.coalesce(F.lit(rule.contracts) & bound, F.lit(False))
    reasons = F.array_sort(F.array_compact(F.array(F.when(projected, "projection_fallback"), F.when(bound, "build_contract"))))
    label = F.when((projected | bound) & (base != "conditional"), "probable").otherwise(base)
    return edges.select("seq", label.alias("uncertainty_category"), (label != "definite").alias("over_approx"), reasons.alias("reasons"))
