"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import unit_hash


def bounded_sample(rows: DataFrame, key: Column, bound: int, seed: int) -> DataFrame:
    """All rows if there are at most `bound`; else those whose key's hash falls below 0.95 bound / rows. Keys are to be unique."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.filter(unit_hash(key, seed) < 0.95 * bound / total)


def sampled(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """As bounded_sample, by the distinct values of the column key, a hash of id and text, so that null or repeated ids add no more rows.

    Rows that repeat a key all stay or all go; who fits on them takes each key once.
    """
    total = rows.select("key").distinct().count()
    if total <= bound:
        return rows
    return rows.filter(unit_hash(F.col("key"), seed) < 0.95 * bound / total)


def labelled(docs: DataFrame, marked: DataFrame, doc_id: str, text: str, bound: int, seed: int, *more: str) -> DataFrame:
    """(key, y, text, more) of the rows of docs whose id is in marked (id, y; unique ids), by a hash at most `bound` distinct ones."""
    marked = F.broadcast(bounded_sample(marked, F.col("id"), bound, seed))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), *more).join(marked, "id")
    return sampled(rows.select(F.xxhash64("id", "text").alias("key"), "y", "text", *more), bound, seed + 1)
