"""Identifier rules as Column expressions: everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c: Column | str) -> Column:
    """Without the white space (also tabs and line ends) around it."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def node_key(c: Column | str) -> Column:
    """One spelling for all spellings of a node id.

    Two spellings name the same node if they differ only in blanks around them, in the direction
    of the separators or in repeated separators. Case matters. Null stays null.
    """
    return F.regexp_replace(F.translate(strip_blanks(c), "\\", "/"), "/{2,}", "/")


def package_key(c: Column | str) -> Column:
    """One spelling of a package graph id: trimmed, lower case. Blank ids count as null."""
    k = F.lower(strip_blanks(c))
    return F.when(k != "", k)
