"""Edges between cells, ranges and bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlineage.operators.grid import in_rectangles

#: First writer of an edge wins; its place in this order is its priority.
KINDS = ("formula", "range_static", "range_dynamic", "cell_dynamic", "udf_call", "call_graph", "vba_ref", "via_vba_paste", "via_offset_static", "via_offset_volatile")


def collapse_cells(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Cell edges (from_cell, to_cell) to binding edges: each end's least binding, no self edges, each pair once with count 1."""
    low = membership.groupBy("cell").agg(F.min("binding").alias("binding"))
    src = low.select(F.col("cell").alias("from_cell"), F.col("binding").alias("from_binding"))
    dst = low.select(F.col("cell").alias("to_cell"), F.col("binding").alias("to_binding"))
    return edges.join(src, "from_cell").join(dst, "to_cell").where("from_binding <> to_binding").select("from_binding", "to_binding").distinct().withColumn("edge_count", F.lit(1).cast("long"))


def collapse_ranges(range_edges: DataFrame, cells: DataFrame, membership: DataFrame) -> DataFrame:
    """Range edges to binding edges; the count is of distinct target cells in the union of the rectangles.

    range_edges: from_cell, sheet_id, r1, c1, r2, c2, is_dynamic.  cells: cell, sheet_id, row, col.  Rectangles are deduplicated by
    source binding before the range join, and are never expanded to cells beyond those that exist.
    """
    low = membership.groupBy("cell").agg(F.min("binding").alias("from_binding")).withColumnRenamed("cell", "from_cell")
    rects = range_edges.join(low, "from_cell").groupBy("from_binding", "sheet_id", "r1", "c1", "r2", "c2").agg(F.max("is_dynamic").alias("is_dynamic"))
    placed = cells.join(membership.select("cell", F.col("binding").alias("to_binding")), "cell")
    hit = in_rectangles(placed, rects).where("from_binding <> to_binding")
    # one row a (source, target cell) before the count, so that a wide source's windows don't multiply the shuffle
    once = hit.groupBy("from_binding", "to_binding", "cell").agg(F.max("is_dynamic").alias("d"))
    out = once.groupBy("from_binding", "to_binding").agg(F.count("*").alias("edge_count"), F.max("d").alias("d"))
    return out.select("from_binding", "to_binding", "edge_count", F.when(F.col("d"), "range_dynamic").otherwise("range_static").alias("kind"))


def merge_kinds(edges: DataFrame) -> DataFrame:
    """One row a pair: the kind that is first in KINDS, with its count."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return edges.groupBy("from_binding", "to_binding").agg(F.min(F.struct(place.alias("p"), "kind", "edge_count")).alias("e")).select("from_binding", "to_binding", "e.kind", "e.edge_count")


def upgrade_dynamic(edges: DataFrame, dynamic_pairs: DataFrame) -> DataFrame:
    """formula edges become cell_dynamic where the pair is dynamic."""
    marked = dynamic_pairs.select("from_binding", "to_binding").distinct().withColumn("_d", F.lit(True))
    return edges.join(marked, ["from_binding", "to_binding"], "left").withColumn("kind", F.when((F.col("kind") == "formula") & F.col("_d"), "cell_dynamic").otherwise(F.col("kind"))).drop("_d")


def cross_sheet(edges: DataFrame, sheets: DataFrame) -> DataFrame:
    """(from_sheet, to_sheet, n) of edges between sheets; sheets: node, sheet."""
    a = sheets.select(F.col("node").alias("src"), F.col("sheet").alias("from_sheet"))
    b = sheets.select(F.col("node").alias("dst"), F.col("sheet").alias("to_sheet"))
    return edges.join(a, "src").join(b, "dst").where("from_sheet <> to_sheet").groupBy("from_sheet", "to_sheet").agg(F.count("*").alias("n"))
