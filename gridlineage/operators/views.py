"""The stable views over a workbook's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class IR:
    """The normalized tables that the views read."""

    sheets: DataFrame
    cells: DataFrame
    formulas: DataFrame
    blobs: DataFrame
    bindings: DataFrame
    internal: DataFrame
    ranges: DataFrame
    external: DataFrame
    procedures: DataFrame
    binding_edges: DataFrame


def agent_cells_light(ir: IR) -> DataFrame:
    """Cells with sheet name and formula texts."""
    c = ir.cells.join(ir.sheets, "sheet_id").join(ir.formulas, "formula_id", "left")
    return c.select("cell_id", "sheet_name", "row", "col", "a1", "formula_r1c1", F.col("formula_a1_example").alias("formula_a1"))


def agent_cells(ir: IR) -> DataFrame:
    """Cells with sheet name, formula texts and value."""
    c = ir.cells.join(ir.sheets, "sheet_id").join(ir.formulas, "formula_id", "left").join(ir.blobs, F.col("value_sha256") == F.col("sha256"), "left")
    return c.select("cell_id", "sheet_name", "row", "col", "a1", "formula_r1c1", F.col("formula_a1_example").alias("formula_a1"), F.col("json").alias("value_json"))


def agent_bindings(ir: IR) -> DataFrame:
    return ir.bindings.join(ir.sheets, "sheet_id").select("binding_id", "sheet_name", "address_a1", "binding_type", "label")


def nodes(ir: IR) -> DataFrame:
    """Bindings and procedures as nodes of one graph; a procedure is vba::module::name::kind, with its compile branch if it has one."""
    b = ir.bindings.join(ir.sheets, "sheet_id").select(F.col("binding_id").alias("node_id"), F.lit("binding").alias("node_type"), "sheet_name", F.col("label").alias("name"))
    vba = F.concat_ws("::", F.lit("vba"), "module_id", "name", "kind", "compile_branch")
    p = ir.procedures.select(vba.alias("node_id"), F.lit("vba_procedure").alias("node_type"), F.lit(None).cast("string").alias("sheet_name"), "name")
    return b.unionByName(p)


def agent_dependencies(ir: IR) -> DataFrame:
    """Cell, range and external edges in one shape."""
    at = ir.cells.join(ir.sheets, "sheet_id").select("cell_id", "sheet_name", "a1")
    src = at.select(F.col("cell_id").alias("from_cell_id"), F.col("sheet_name").alias("from_sheet"), F.col("a1").alias("from_a1"))
    dst = at.select(F.col("cell_id").alias("to_cell_id"), F.col("sheet_name").alias("to_sheet"), F.col("a1").alias("to_a1"))
    text, long = F.lit(None).cast("string"), F.lit(None).cast("long")
    shape = lambda kind, d, to_sheet, to_a1, n, ext: d.select(F.lit(kind).alias("kind"), "from_sheet", "from_a1", to_sheet.alias("to_sheet"), to_a1.alias("to_a1"), n.alias("cell_count"), ext.alias("external_ref"))
    cell = shape("cell", ir.internal.join(src, "from_cell_id").join(dst, "to_cell_id"), F.col("to_sheet"), F.col("to_a1"), long, text)
    named = ir.sheets.select(F.col("sheet_id").alias("to_sheet_id"), F.col("sheet_name").alias("to_sheet"))
    wide = shape("range", ir.ranges.join(src, "from_cell_id").join(named, "to_sheet_id"), F.col("to_sheet"), F.col("to_range_a1"), F.col("cell_count"), text)
    out = shape("external", ir.external.join(src, "from_cell_id"), text, text, long, F.col("external_ref"))
    return cell.unionByName(wide).unionByName(out)


def agent_binding_dependencies(ir: IR) -> DataFrame:
    """Binding edges with both ends' sheet and address; ends that are procedures are on sheet VBA."""
    b = agent_bindings(ir)
    src = b.select(F.col("binding_id").alias("from_binding_id"), F.col("sheet_name").alias("fs"), F.col("address_a1").alias("fa"))
    dst = b.select(F.col("binding_id").alias("to_binding_id"), F.col("sheet_name").alias("ts"), F.col("address_a1").alias("ta"))
    e = ir.binding_edges.join(src, "from_binding_id", "left").join(dst, "to_binding_id", "left")
    vba = F.lit("VBA")
    return e.select("from_binding_id", "to_binding_id", F.coalesce("fs", vba).alias("from_sheet"), F.coalesce("fa", "from_binding_id").alias("from_address"), F.coalesce("ts", vba).alias("to_sheet"), F.coalesce("ta", "to_binding_id").alias("to_address"), "edge_count", "kind")


def register(ir: IR) -> None:
    """All views as temporary views of the session, for user SQL."""
    named = {"agent_cells": agent_cells, "agent_cells_full": agent_cells, "agent_cells_light": agent_cells_light, "agent_bindings": agent_bindings, "agent_nodes": nodes, "agent_dependencies": agent_dependencies, "agent_binding_dependencies": agent_binding_dependencies}
    for name, view in named.items():
        view(ir).createOrReplaceTempView(name)
