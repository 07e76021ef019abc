"""Dependency-graph analytics and table repair operators on PySpark DataFrames."""

__version__ = "0.1.0"
