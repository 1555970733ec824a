"""Lookups resolved on the cached value snapshot: what a call reads, and how sure that is.

Each gives a struct of status and rectangle.  Values compare within their type class only:
callers pass numbers with numbers, folded texts with texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlineage.functions.address import MAX_COL, MAX_ROW, a1, quote_sheet


def match_exact(values: DataFrame, array: DataFrame) -> DataFrame:
    """(value, pos): the first position of array (pos, v) equal to each value; null where there's none."""
    first = array.groupBy("v").agg(F.min("pos").alias("pos"))
    return values.join(first, F.col("value") == F.col("v"), "left").select("value", "pos")


def match_approximate(values: DataFrame, array: DataFrame, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(value, pos) of a scan that stops at the first element beyond the value (above it for order 1, below for -1).

    The scan's stop for a value is the first element beyond it, which is a running maximum of the array.  Running maxima only
    grow, so values and maxima in one descending order give each value's stop: the least place among the maxima passed so far.
    One lookup array is one ordered scan, bounded by the rows or columns of a sheet; `by` names the columns that tell arrays apart, in
    both tables, and each is scanned on its own.
    """
    from pyspark.sql.window import Window

    sign = 1 if order > 0 else -1
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    a = array.select(*by, "pos", (F.col("v") * sign).alias("v")).withColumn("top", F.max("v").over(before)).withColumn("prior", F.lag("pos").over(Window.partitionBy(*by).orderBy("pos")))
    records = a.where("top IS NULL OR v > top").select(*by, F.col("v").alias("k"), F.lit(1).alias("is_record"), F.lit(None).cast("double").alias("value"), F.struct("pos", "prior").alias("at"))
    end = a.groupBy(*by).agg(F.max("pos").alias("pos")).select(*by, F.lit(float("inf")).alias("k"), F.lit(1).alias("is_record"), F.lit(None).cast("double").alias("value"), F.struct((F.col("pos") + 1).alias("pos"), F.col("pos").alias("prior")).alias("at"))
    asked = values.select(*by, (F.col("value") * sign).alias("k"), F.lit(0).alias("is_record"), "value", F.lit(None).cast(records.schema["at"].dataType).alias("at"))
    passed = Window.partitionBy(*by).orderBy(F.desc("k"), "is_record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = records.unionByName(end).unionByName(asked).withColumn("stop", F.min("at").over(passed))
    return found.where("is_record = 0").select(*by, "value", F.col("stop.prior").alias("pos"))


def _box(status: Column, r1: Column, c1: Column, r2: Column, c2: Column, known: Column) -> Column:
    put = lambda c: F.when(known, c.cast("int"))
    return F.struct(status.alias("status"), put(r1).alias("r1"), put(c1).alias("c1"), put(r2).alias("r2"), put(c2).alias("c2"))


def index(box: Column, row: Column, col: Column) -> Column:
    """INDEX: both known give a cell, one a whole row or column (partial), none nothing; 0 is the whole row or column."""
    b = {c: box[c] for c in ("r1", "c1", "r2", "c2")}
    out = (row > b["r2"] - b["r1"] + 1) | (col > b["c2"] - b["c1"] + 1)
    lost = (row.isNull() & col.isNull()) | F.coalesce(out, F.lit(False))
    status = F.when(lost, "unresolved").when(row.isNull() | col.isNull(), "partial_resolved").otherwise("resolved")
    all_rows, all_cols = F.coalesce(row, F.lit(0)) == 0, F.coalesce(col, F.lit(0)) == 0
    return _box(
        status,
        F.when(all_rows, b["r1"]).otherwise(b["r1"] + row - 1),
        F.when(all_cols, b["c1"]).otherwise(b["c1"] + col - 1),
        F.when(all_rows, b["r2"]).otherwise(b["r1"] + row - 1),
        F.when(all_cols, b["c2"]).otherwise(b["c1"] + col - 1),
        ~lost,
    )


def vlookup(box: Column, col: Column) -> Column:
    """VLOOKUP: the return column over all rows, or the whole table where the index isn't in it."""
    fits = F.coalesce(col.between(1, box["c2"] - box["c1"] + 1), F.lit(False))
    at = box["c1"] + col - 1
    return _box(F.when(fits, "resolved").otherwise("conservative_fallback"), box["r1"], F.when(fits, at).otherwise(box["c1"]), box["r2"], F.when(fits, at).otherwise(box["c2"]), F.lit(True))


def hlookup(box: Column, row: Column) -> Column:
    """HLOOKUP: the return row over all columns, or the whole table."""
    fits = F.coalesce(row.between(1, box["r2"] - box["r1"] + 1), F.lit(False))
    at = box["r1"] + row - 1
    return _box(F.when(fits, "resolved").otherwise("conservative_fallback"), F.when(fits, at).otherwise(box["r1"]), box["c1"], F.when(fits, at).otherwise(box["r2"]), box["c2"], F.lit(True))


def xlookup(returned: Column) -> Column:
    """XLOOKUP: the whole return array; nothing is searched."""
    known = returned.isNotNull()
    return _box(F.when(known, "resolved").otherwise("conservative_fallback"), *(returned[c] for c in ("r1", "c1", "r2", "c2")), known)


def offset(base: Column, rows: Column, cols: Column, height: Column | None = None, width: Column | None = None) -> Column:
    """OFFSET: the base's top left moved, with a given or its own extent; out of the sheet is invalid."""
    known = rows.isNotNull() & cols.isNotNull()
    r1, c1 = base["r1"] + rows, base["c1"] + cols
    r2 = r1 + (height if height is not None else base["r2"] - base["r1"] + 1) - 1
    c2 = c1 + (width if width is not None else base["c2"] - base["c1"] + 1) - 1
    fits = (r1 >= 1) & (c1 >= 1) & (r2 <= MAX_ROW) & (c2 <= MAX_COL)
    status = F.when(~known, "context_dependent").when(~fits, "invalid_context").otherwise("resolved")
    return _box(status, r1, c1, r2, c2, known & fits)


def choose(which: Column, targets: Column) -> Column:
    """CHOOSE: the nth target; all of them where n isn't known."""
    fits = which.between(1, F.size(targets))
    status = F.when(which.isNull(), "conservative_fallback").when(fits, "resolved").otherwise("unresolved")
    picked = F.when(which.isNull(), targets).when(fits, F.array(F.try_element_at(targets, which))).otherwise(F.array().cast("array<string>"))
    return F.struct(status.alias("status"), picked.alias("targets"))


def address(row: Column, col: Column, sheet: Column | None = None) -> Column:
    """ADDRESS: struct of status and the cell's text, with its sheet if given; unresolved where a number isn't known or out of the sheet."""
    at = a1(row.cast("int"), col.cast("int"))
    known = F.coalesce(row.between(1, MAX_ROW) & col.between(1, MAX_COL), F.lit(False))
    where = F.lit("") if sheet is None else F.when(F.coalesce(sheet, F.lit("")) != "", F.concat(quote_sheet(sheet), F.lit("!"))).otherwise("")
    return F.struct(F.when(known, "resolved").otherwise("unresolved").alias("status"), F.when(known, F.concat(where, at)).alias("target"))


def first_resolved(*tries: Column) -> Column:
    """A chain of strategies: the first that has an answer."""
    return F.coalesce(*tries)


def metrics(calls: DataFrame) -> DataFrame:
    """Counts by function and status, with totals (null)."""
    return calls.rollup("function", "status").agg(F.count("*").alias("n"))
