"""Fixed values of the graph model."""

from __future__ import annotations

# Node types by category, edge kinds, and the type sets that the rules refer to.
NODE_TYPES = {
    "core": ("code", "config", "module", "artifact", "external_dep", "external_library", "license", "proxy", "unknown"),
    "cpp": ("system_header", "project_header", "header", "target", "subdirectory", "toolchain", "build_config", "shared_library", "static_library", "executable"),
    "hvigor": ("hap", "har", "hsp"),
    "analysis": ("scc_cluster", "code_scc_cluster"),
    "misc": ("process", "asset"),
}
EDGE_KINDS = (
    "include", "import", "sources", "depends_on", "link_libraries", "contains", "defined_by", "include_dirs", "alias_of", "implements_native",
    "consumes", "produces", "part_of", "affects", "links",
)
ARTIFACT_TYPES = ("shared_library", "static_library", "executable", "module", "module_library", "interface_library", "object")
ENTRY_TYPES = ("hap", "har", "hsp", "executable")
FALLBACK_TYPES = ("code", "project_header", "header")
ALL_TYPES = tuple(t for types in NODE_TYPES.values() for t in types)


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
