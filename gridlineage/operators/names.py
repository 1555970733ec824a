"""Names, structured references, three-dimensional ranges and user functions as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve(uses: DataFrame, names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """uses (id, sheet, name), names (name, scope or null, target, is_external): the name of the user's sheet first, then the workbook's; unknown and external ones become UNRESOLVED: markers.

    Names are matched without case, and within the columns `by` (the workbook) where given.
    """
    n = names.select(*by, F.upper("name").alias("u"), "scope", "target", "is_external")
    found = uses.withColumn("u", F.upper("name")).join(n, [*by, "u"], "left").where("scope IS NULL OR lower(scope) = lower(sheet)")
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "id", "sheet", "name").orderBy(F.col("scope").isNull(), "target"))).where("_r = 1")
    known = F.when(F.col("target").isNull() | F.col("is_external"), F.concat(F.lit("UNRESOLVED:"), "name")).otherwise(F.col("target"))
    lost = uses.join(best.select(*by, "id", "sheet", "name"), [*by, "id", "sheet", "name"], "left_anti").withColumn("target", F.concat(F.lit("UNRESOLVED:"), "name"))
    return best.select(*by, "id", "sheet", "name", known.alias("target")).unionByName(lost.select(*by, "id", "sheet", "name", "target"))


def structured(uses: DataFrame, tables: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """uses (id, ref, and row for parts of the formula's own row), tables (name, sheet_id, r1, c1, r2, c2, header_rows, totals_rows, columns): the rectangle of Table[part] or Table[[part],[column]]; parts are #All, #Headers, #Data, #Totals, #This Row; [@column] is this row's.  Tables are matched within the columns `by`."""
    row = F.col("row") if "row" in uses.columns else F.lit(None)
    u = uses.select(*by, "id", "ref", row.cast("int").alias("_row"), F.upper(F.regexp_extract("ref", r"^([^\[]+)\[", 1)).alias("u"), F.regexp_extract_all("ref", F.lit(r"\[?([^\[\],]+)\]"), F.lit(1)).alias("items"))
    d = u.join(tables.withColumn("u", F.upper("name")), [*by, "u"])
    own = F.exists("items", lambda x: x.startswith("@"))
    part = F.when(own, "#This Row").otherwise(F.coalesce(F.get(F.filter("items", lambda x: x.startswith("#")), F.lit(0)), F.lit("#Data")))
    column = F.get(F.transform(F.filter("items", lambda x: ~x.startswith("#") & (x != "@")), lambda x: F.regexp_replace(x, "^@", "")), F.lit(0))
    place = F.array_position(F.transform("columns", F.upper), F.upper(column))
    top, low = F.col("r1") + F.col("header_rows"), F.col("r2") - F.col("totals_rows")
    r1 = F.when(part == "#This Row", F.col("_row")).when(part.isin("#All", "#Headers"), F.col("r1")).when(part == "#Totals", low + 1).otherwise(top)
    r2 = F.when(part == "#This Row", F.col("_row")).when(part.isin("#All", "#Totals"), F.col("r2")).when(part == "#Headers", top - 1).otherwise(low)
    c1 = F.when(column.isNull(), F.col("c1")).otherwise(F.col("c1") + place.cast("int") - 1)
    c2 = F.when(column.isNull(), F.col("c2")).otherwise(c1)
    return d.where(column.isNull() | (place > 0)).select(*by, "id", "ref", "sheet_id", r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"))


def three_d(uses: DataFrame, sheets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """uses (id, first, last): an edge to each sheet from the first to the last in either order, with the other columns of uses; sheets: sheet_id, sheet_name."""
    s = sheets.select(*by, F.upper("sheet_name").alias("n"), "sheet_id")
    a = s.select(*by, F.col("n").alias("fu"), F.col("sheet_id").alias("x"))
    b = s.select(*by, F.col("n").alias("lu"), F.col("sheet_id").alias("y"))
    d = uses.withColumn("fu", F.upper("first")).withColumn("lu", F.upper("last")).join(a, [*by, "fu"]).join(b, [*by, "lu"])
    return d.select(*(c for c in uses.columns if c not in ("first", "last")), F.explode(F.sequence(F.least("x", "y"), F.greatest("x", "y"))).alias("sheet_id"))


def user_functions(formulas: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, name): user functions (name) that a formula (id, f) calls; without case, each once."""
    from gridlineage.functions.text import function_names

    called = formulas.select("id", F.explode(function_names(F.col("f"))).alias("u"))
    return called.join(functions.select(F.upper("name").alias("u"), "name"), "u").select("id", "name").distinct()
