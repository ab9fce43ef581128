"""Intermediate tables and column names of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factmill.sources.shared import materialize, shared_folder

__all__ = ["fresh", "materialize", "shared_folder"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have: the name, with as many underscores before it as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
