"""Refining bindings: splits, merges and joins of adjacent rectangles (sheet, id, r1, c1, r2, c2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlineage.functions.text import is_placeholder, is_scenario_header, is_section_header
from gridlineage.operators.grid import every, in_rectangles


def constant_ranges(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """Referenced rectangles shrunk to their populated bounds, where those are full and free of formulas.  cells: sheet_id, row, col, has_formula."""
    box = ["sheet_id", "r1", "c1", "r2", "c2"]
    hit = in_rectangles(cells, rects.select(*box).distinct())
    got = hit.groupBy(*box).agg(F.min("row").alias("a"), F.min("col").alias("b"), F.max("row").alias("c"), F.max("col").alias("d"), F.count("*").alias("n"), F.bool_or("has_formula").alias("f"))
    return got.where("NOT f AND n = (c - a + 1) * (d - b + 1)").select("sheet_id", F.col("a").alias("r1"), F.col("b").alias("c1"), F.col("c").alias("r2"), F.col("d").alias("c2")).distinct()


def merge_boxes(rects: DataFrame, by: str = "sheet_id") -> DataFrame:
    """Overlapping or touching rectangles of a line merged to their bounding box, to a fixpoint.  A sheet's constants are one group."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        boxes = sorted(group[["r1", "c1", "r2", "c2"]].itertuples(index=False, name=None))
        changed = True
        while changed:
            changed = False
            out: list[tuple] = []
            for b in boxes:
                for k, a in enumerate(out):
                    column = a[1] == b[1] and a[3] == b[3] and b[0] <= a[2] + 1 and a[0] <= b[2] + 1
                    row = a[0] == b[0] and a[2] == b[2] and b[1] <= a[3] + 1 and a[1] <= b[3] + 1
                    if column or row:
                        out[k] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                        changed = True
                        break
                else:
                    out.append(b)
            boxes = sorted(set(out))
        return pd.DataFrame([(group[by].iloc[0], *b) for b in boxes], columns=[by, "r1", "c1", "r2", "c2"])

    kinds = dict(rects.dtypes)
    return rects.select(by, "r1", "c1", "r2", "c2").groupBy(by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (by, "r1", "c1", "r2", "c2")))


def row_cover(rects: DataFrame, by: list[str]) -> DataFrame:
    """Row intervals of rectangles (by, r1, r2) as disjoint ones: a running maximum finds where a new one begins."""
    w = Window.partitionBy(*by).orderBy("r1", "r2")
    far = F.max("r2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rects.select(*by, "r1", "r2").distinct().withColumn("_new", F.when(far.isNull() | (F.col("r1") > far + 1), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(w)).groupBy(*by, "_g").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")).drop("_g")


def noise(cells: DataFrame, read: DataFrame) -> DataFrame:
    """(id, reason) of constant bindings that aren't variables: empty; or, unless a formula reads a cell of them, placeholders alone
    in more than one cell, or texts with a section header in 2 to 10 cells.  cells: id, value, is_text, has_formula; read: id.
    """
    text = F.when(F.trim("value") != "", F.col("is_text"))  # null for blanks, which don't count
    mark = every(text & F.when(text.isNotNull(), is_placeholder(F.col("value"))))
    head = every(text) & F.bool_or(is_section_header(F.col("value")))
    gone = every((F.coalesce("value", F.lit("")) == "") & ~F.col("has_formula"))
    facts = cells.groupBy("id").agg(F.count("*").alias("n"), gone.alias("empty"), mark.alias("placeholder"), F.coalesce(head, F.lit(False)).alias("header"))
    used = read.select("id").distinct().withColumn("_read", F.lit(True))
    free = F.col("_read").isNull()
    reason = F.when(F.col("empty"), "empty").when(free & F.col("placeholder") & (F.col("n") > 1), "placeholder").when(free & F.col("header") & F.col("n").between(2, 10), "section_header")
    return facts.join(used, "id", "left").select("id", reason.alias("reason")).where("reason IS NOT NULL")


def split_scenarios(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Constant blocks of 2 to 20 columns under at least two distinct scenario headers, cut into columns; others stay whole.  headers: sheet, row, col, text."""
    n, rows = F.col("c2") - F.col("c1") + 1, F.col("r2") - F.col("r1") + 1
    fits = n.between(2, 20) & (rows >= 2) & (n * rows <= 10_000)
    each = blocks.where(fits).withColumn("col", F.explode(F.sequence("c1", "c2"))).withColumn("row", F.col("r1") - 1)
    named = each.join(headers.where(is_scenario_header(F.col("text"))), ["sheet", "row", "col"])
    split = named.groupBy("sheet", "id").agg(F.count_distinct(F.lower("text")).alias("n")).where("n >= 2").select("sheet", "id", F.lit(True).alias("split"))
    d = blocks.join(split, ["sheet", "id"], "left")
    return d.withColumn("c", F.explode(F.when(F.col("split"), F.sequence("c1", "c2")).otherwise(F.array("c1")))).select("sheet", "id", "r1", F.col("c").alias("c1"), "r2", F.when(F.col("split"), F.col("c")).otherwise(F.col("c2")).alias("c2"))


def merge_index_vectors(vectors: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, index_id): tables with the column of consecutive integers just left of them that has the same rows.

    Many may meet many, so that the pairs outgrow the input: tables are dealt over 512 tasks, whose number the input's size doesn't lower.
    """
    v = vectors.select("sheet", F.col("id").alias("index_id"), "r1", "r2", (F.col("c2") + 1).alias("c1"))
    on = ["sheet", "r1", "r2", "c1"]
    t = tables.select("sheet", F.col("id").alias("table_id"), "r1", "r2", "c1")
    return t.repartition(512, *on).join(v.repartition(512, *on).hint("merge"), on).select("table_id", "index_id")


def anchor_merge(anchors: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(anchor_id, vector_id): a 1x1 constant joins the vector below it, else right of it, that depends on it; each is used once."""
    at = anchors.select("sheet", F.col("id").alias("anchor_id"), F.col("r1").alias("r"), F.col("c1").alias("c"))
    down = at.join(vectors.where("c1 = c2").select("sheet", F.col("id").alias("vector_id"), (F.col("r1") - 1).alias("r"), F.col("c1").alias("c")), ["sheet", "r", "c"]).withColumn("p", F.lit(0))
    right = at.join(vectors.where("r1 = r2").select("sheet", F.col("id").alias("vector_id"), F.col("r1").alias("r"), (F.col("c1") - 1).alias("c")), ["sheet", "r", "c"]).withColumn("p", F.lit(1))
    found = down.unionByName(right).join(edges.select(F.col("src").alias("vector_id"), F.col("dst").alias("anchor_id")).distinct(), ["vector_id", "anchor_id"], "left_semi")
    first = found.groupBy("anchor_id").agg(F.min(F.struct("p", "vector_id")).alias("m")).select("anchor_id", "m.p", "m.vector_id")
    return first.groupBy("vector_id").agg(F.min(F.struct("p", "anchor_id"))["anchor_id"].alias("anchor_id")).select("anchor_id", "vector_id")


def merge_segments(segments: DataFrame, by: list[str]) -> DataFrame:
    """One-dimensional segments (by, first, last) that follow each other without a gap, joined: (by, first, last, parts)."""
    w = Window.partitionBy(*by).orderBy("first", "last")
    d = segments.withColumn("_new", F.when(F.lag("last").over(w) + 1 == F.col("first"), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(*by, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("parts")).drop("_g")


def init_score(references, adjacent, coherence, constant, same_sheet):
    """Score of a seed cell and a recurrence being one variable; they merge from 0.6."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return one(references, 0.4) + one(adjacent, 0.2) + 0.2 * F.least(coherence, F.lit(1.0)) + one(constant, 0.1) + one(same_sheet, 0.1)


def keep_matrix(range_edges: DataFrame) -> DataFrame:
    """Rectangles (from_cell, rect, rows, cols) that one cell reads together with an axis of theirs: a vector as long as their rows or columns."""
    a = range_edges.where("rows > 1 AND cols > 1")
    b = range_edges.where("rows = 1 OR cols = 1").select("from_cell", F.greatest("rows", "cols").alias("n"))
    return a.join(b, "from_cell").where("n = rows OR n = cols").select("rect").distinct()
