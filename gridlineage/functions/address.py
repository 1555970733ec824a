"""Cell addresses as column expressions: packing, A1 letters, parsing, quoting, rectangle algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROW, MAX_COL, MAX_SHEET = 1_048_576, 16_384, (1 << 20) - 1


def pack(sheet: Column, row: Column, col: Column) -> Column:
    """64-bit cell id: 20 bits of sheet, 24 of row, 20 of column; null out of bounds."""
    fits = sheet.between(1, MAX_SHEET) & row.between(1, (1 << 24) - 1) & col.between(1, (1 << 20) - 1)
    return F.when(fits, F.shiftleft(sheet.cast("long"), 44).bitwiseOR(F.shiftleft(row.cast("long"), 20)).bitwiseOR(col.cast("long")))


def unpack(cell_id: Column) -> tuple[Column, Column, Column]:
    return (
        F.shiftright(cell_id, 44).cast("int"),
        F.shiftright(cell_id, 20).bitwiseAND(F.lit((1 << 24) - 1)).cast("int"),
        cell_id.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"),
    )


def letters(col: Column) -> Column:
    """Column letters of a number from 1 to 16384 (bijective base 26)."""
    c = col.cast("int")
    one, two = c - 1, F.floor((c - 27) / 26)
    last = F.char(65 + one % 26)
    mid = F.when(c > 26, F.char(65 + two.cast("int") % 26)).otherwise("")
    first = F.when(c > 702, F.char(65 + F.floor((c - 703) / 676).cast("int"))).otherwise("")
    return F.when(c.between(1, MAX_COL), F.concat(first, mid, last))


def number(name: Column) -> Column:
    """Column number of letters; null for what isn't a column."""
    up = F.upper(name)
    digits = F.transform(F.split(up, ""), lambda ch: F.ascii(ch) - 64)
    value = F.aggregate(digits, F.lit(0), lambda s, d: s * 26 + d)
    return F.when(up.rlike("^[A-Z]{1,3}$") & (value <= MAX_COL), value)


def a1(row: Column, col: Column) -> Column:
    return F.concat(letters(col), row.cast("string"))


def parse_a1(ref: Column) -> Column:
    """Struct of an A1 cell or range: sheet, r1, c1, r2, c2 (a cell has both corners equal)."""
    cell = r"\$?([A-Za-z]{1,3})\$?(\d{1,7})"
    full = rf"^(?:(?:'((?:[^']|'')*)'|([^'!]+))!)?{cell}(?::{cell})?$"
    part = lambda k: F.regexp_extract(ref, full, k)
    fits = ref.rlike(full)
    sheet = F.when(part(1) != "", F.replace(part(1), F.lit("''"), F.lit("'"))).when(part(2) != "", part(2))
    c1, r1 = number(part(3)), part(4).try_cast("int")
    c2, r2 = F.coalesce(number(part(5)), c1), F.coalesce(part(6).try_cast("int"), r1)
    return F.when(fits, F.struct(sheet.alias("sheet"), F.least(r1, r2).alias("r1"), F.least(c1, c2).alias("c1"), F.greatest(r1, r2).alias("r2"), F.greatest(c1, c2).alias("c2")))


def quote_sheet(name: Column) -> Column:
    """Sheet name as formulas write it: quoted unless it's a plain word."""
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'")))


def whole_extent(ref: Column) -> Column:
    """Whole columns and rows as bounded ranges: $D:$D -> $D$1:$D$1048576, 3:4 -> A3:XFD4."""
    cols, rows = r"^(\$?[A-Za-z]{1,3}):(\$?[A-Za-z]{1,3})$", r"^(\$?)(\d+):(\$?)(\d+)$"
    c = lambda k: F.regexp_extract(ref, cols, k)
    r = lambda k: F.regexp_extract(ref, rows, k)
    mark = lambda x: F.when(x.startswith("$"), "$").otherwise("")
    return (
        F.when(ref.rlike(cols), F.concat(F.upper(c(1)), mark(c(1)), F.lit("1:"), F.upper(c(2)), mark(c(2)), F.lit(str(MAX_ROW))))
        .when(ref.rlike(rows), F.concat(r(1), F.lit("A"), r(1), r(2), F.lit(":"), r(3), F.lit("XFD"), r(3), r(4)))
        .otherwise(ref)
    )


def overlap_cells(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Cells that two rectangles (r1, c1, r2, c2) share."""
    rows = F.least(a["r2"], b["r2"]) - F.greatest(a["r1"], b["r1"]) + 1
    cols = F.least(a["c2"], b["c2"]) - F.greatest(a["c1"], b["c1"]) + 1
    return (F.greatest(rows, F.lit(0)) * F.greatest(cols, F.lit(0))).cast("long")


def range_relation(b: dict[str, Column], n: dict[str, Column]) -> Column:
    """How a named rectangle n covers a binding b: exact, superset, subset, partial or none."""
    same = (b["r1"] == n["r1"]) & (b["c1"] == n["c1"]) & (b["r2"] == n["r2"]) & (b["c2"] == n["c2"])
    over = (n["r1"] <= b["r1"]) & (n["c1"] <= b["c1"]) & (n["r2"] >= b["r2"]) & (n["c2"] >= b["c2"])
    under = (n["r1"] >= b["r1"]) & (n["c1"] >= b["c1"]) & (n["r2"] <= b["r2"]) & (n["c2"] <= b["c2"])
    return F.when(same, "exact").when(over, "superset").when(under, "subset").when(overlap_cells(b, n) > 0, "partial").otherwise("none")
