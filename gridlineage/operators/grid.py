"""Operators on cells of a grid: islands, rectangles, range joins, nearest cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: (by, first, last, n)."""
    step = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return rows.withColumn("_g", step).groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_g")


def wide_islands(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """islands of groups too large for one task: rows are numbered in spans of 2**16 places, after those of the spans before."""
    span = F.shiftright(F.col(at).cast("long"), 16)
    placed = rows.withColumn("_s", span)
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "_s").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.struct(*by, "_s").alias("_k"), "_before")
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(at))).withColumn("_k", F.struct(*by, "_s"))
    step = F.col(at) - F.col("_r") - F.col("_before")
    joined = numbered.join(counts.withColumnRenamed("_k", "_c"), F.col("_k").eqNullSafe(F.col("_c")))
    return joined.withColumn("_g", step).groupBy(*by, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_g")


def rectangles(cells: DataFrame, by: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Maximal row-span rectangles of equal cells: runs along each row, then equal runs down the rows.  (by, r1, c1, r2, c2)"""
    runs = islands(cells, [*by, row], col).select(*by, row, F.col("first").alias("c1"), F.col("last").alias("c2"))
    down = islands(runs, [*by, "c1", "c2"], row)
    return down.select(*by, F.col("first").alias("r1"), "c1", F.col("last").alias("r2"), "c2")


def in_rectangles(cells: DataFrame, rects: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """Range join: cells (sheet, row, col, ...) with the rectangles (sheet, r1, c1, r2, c2, ...) that hold them.

    An equi-join on sheet, level and row bucket; the rest is a filter.  Rectangles are clipped to the used rows of their sheet.  One of
    up to 2**k rows is of level k, where buckets have 2**k rows: it's sent to the one or two that it touches, and a cell to its bucket
    of each level that its sheet's rectangles have.  So a bucket holds no more cells a column than twice its rectangles' rows.
    """
    used = cells.groupBy(sheet).agg(F.min("row").alias("_lo"), F.max("row").alias("_hi"))
    clipped = rects.join(used, sheet).where("r1 <= _hi AND r2 >= _lo")
    first, last = F.greatest("r1", "_lo"), F.least("r2", "_hi")
    leveled = clipped.withColumns({"_f": first.cast("long"), "_l": last.cast("long")}).withColumn("_k", F.ceil(F.log2(F.col("_l") - F.col("_f") + 1)).cast("int"))
    spread = leveled.withColumn("_b", F.explode(F.expr("sequence(shiftright(_f, _k), shiftright(_l, _k))"))).drop("_lo", "_hi", "_f", "_l")
    levels = leveled.groupBy(sheet).agg(F.collect_set("_k").alias("_ks"))
    placed = cells.join(levels, sheet).withColumn("_k", F.explode("_ks")).withColumn("_b", F.expr("shiftright(CAST(row AS BIGINT), _k)")).drop("_ks")
    return placed.join(spread, [sheet, "_k", "_b"]).where("row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2").drop("_k", "_b")


def nearest(targets: DataFrame, texts: DataFrame, keys: list[str], at: str, most: int = 7) -> DataFrame:
    """Nearest text before each target on the same line: (targets, text, distance); within `most` cells.

    An equi-join on the line and the distance, so that neither side meets all of the other's line.
    """
    spread = targets.withColumn("distance", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_at", F.col(at) - F.col("distance"))
    found = spread.join(texts.select(*keys, F.col(at).alias("_at"), "text"), [*keys, "_at"])
    best = found.groupBy(*targets.columns).agg(F.min(F.struct("distance", "text")).alias("_best"))
    return best.select(*targets.columns, F.col("_best.text").alias("text"), F.col("_best.distance").alias("distance"))


def mode_first(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, value): the most frequent value; a tie goes to that of the least order."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_o"), F.col(value).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(value), (-F.col("_m.n")).alias("n"))


def every(cond: Column) -> Column:
    return F.coalesce(F.bool_and(cond), F.lit(False))


def overlaps(rects: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """(a, b, cells) of each pair of rectangles (id, r1, c1, r2, c2) of a sheet that share cells, a < b.

    Both sides are sent to their row buckets; a pair is kept in the bucket where its shared rows begin, so it comes once.
    """
    from gridlineage.functions.address import overlap_cells

    side = lambda p: rects.select(sheet, *(F.col(c).alias(p + c) for c in ("id", "r1", "c1", "r2", "c2"))).withColumn("_b", F.explode(F.sequence(F.floor(F.col(p + "r1") / 64), F.floor(F.col(p + "r2") / 64))))
    both = side("x").join(side("y"), [sheet, "_b"]).where("xid < yid AND _b = floor(greatest(xr1, yr1) / 64)")
    shared = overlap_cells({c: F.col("x" + c) for c in ("r1", "c1", "r2", "c2")}, {c: F.col("y" + c) for c in ("r1", "c1", "r2", "c2")})
    return both.select(F.col("xid").alias("a"), F.col("yid").alias("b"), shared.alias("cells")).where("cells > 0")
