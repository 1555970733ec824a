"""Staging rows to normalized tables: conflicts, first occurrences, coalescing, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conflicts(staged: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Coordinates at which an attribute has more than one non-null value, and how many of the attributes."""
    counts = staged.groupBy(*keys).agg(*(F.count_distinct(a).alias(a) for a in attrs))
    n = sum((F.when(F.col(a) > 1, 1).otherwise(0) for a in attrs), F.lit(0))
    return counts.withColumn("n_conflicts", n.cast("long")).where("n_conflicts > 0").select(*keys, "n_conflicts")


def coalesce_cells(staged: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """One row a coordinate; nulls are filled from the other staged rows."""
    return staged.groupBy(*keys).agg(*(F.max(a).alias(a) for a in attrs))


def first_occurrence(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value of its first row); nulls of the order come last.  A partial aggregate, no sort of a key's rows."""
    rank = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c).alias(c))), F.col(value).alias("_value"))
    return rows.groupBy(key).agg(F.min(rank).getField("_value").alias(value))


def blobs(rows: DataFrame, text: str) -> DataFrame:
    """Content-addressed distinct texts: (sha256, text, uses)."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("sha256")).agg(F.first(text).alias("json"), F.count("*").alias("uses"))


def range_edges(rows: DataFrame, keys: list[str], provenance: str = "provenance") -> DataFrame:
    """One row a rectangle and source; a cached resolution anywhere wins."""
    return rows.groupBy(*keys).agg(F.max(provenance).alias(provenance))


def logical_checksum(rows: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """Order-free checksum of a table: a hash a row, their sorted lists hashed by bucket, the buckets' hashes hashed in order.

    The bucket is the start of the row's hash, so the result doesn't depend on partitions and no task sorts all rows.
    """
    line = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    h = rows.select(F.sha2(line, 256).alias("h"))
    part = h.groupBy(F.substring("h", 1, 2 if buckets == 256 else 1).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("hb"), F.count("*").alias("n"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "hb"))), lambda s: s["hb"]), ""), 256).alias("checksum"), F.sum("n").alias("n_rows"))
