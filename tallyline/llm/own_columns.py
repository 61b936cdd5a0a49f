"""Carries a table's own columns through an operator, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, own``: ``own`` holds all columns but the text under neutral names."""
    others = [c for c in docs.columns if c != "text"]
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    return docs.select("doc_id", "text", own.alias("own"))


def unpacked(columns: list[str]) -> list[Column]:
    """The columns that :func:`packed` put away, for a select."""
    others = [c for c in columns if c != "text"]
    return [F.col("text") if c == "text" else F.col(f"own.c{others.index(c)}").alias(c) for c in columns]
