"""Ordered sequences: time axes, steps, alignment; families and table candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlineage.operators.grid import every, islands


def profile(values: DataFrame, by: list[str], order: list[str], value: str = "v") -> DataFrame:
    """(by, n, first, last, monotone, constant_step): strictly growing by over 1e-6; equal steps up to 1e-6 relative; three values at least."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.col(value) - F.lag(value).over(w)
    d = values.withColumn("_d", step).withColumn("_k", F.row_number().over(w))
    d = d.withColumn("_d0", F.max(F.when(F.col("_k") == 2, F.col("_d"))).over(Window.partitionBy(*by)))
    same = F.abs(F.col("_d") - F.col("_d0")) <= F.greatest(F.lit(1e-6), 1e-6 * F.abs("_d0"))
    first = F.min_by(value, "_k").alias("first")
    out = d.groupBy(*by).agg(F.count("*").alias("n"), first, F.max_by(value, "_k").alias("last"), every(F.col("_d").isNull() | (F.col("_d") > 1e-6)).alias("monotone"), every(F.col("_d").isNull() | same).alias("constant_step"))
    return out.where("n >= 3")


def consecutive(values: DataFrame, by: list[str], order: list[str], value: str = "v", least: int = 5) -> DataFrame:
    """(by, n): groups of at least `least` values that are all whole numbers, in order each one more than the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = F.round(F.col(value).try_cast("double")).cast("long")
    d = values.withColumn("_v", F.when(F.abs(F.col(value).try_cast("double") - v) <= 1e-9, v)).withColumn("_before", F.lag("_v").over(w)).withColumn("_k", F.row_number().over(w))
    fits = F.col("_v").isNotNull() & ((F.col("_k") == 1) | (F.col("_v") - F.col("_before") == 1))
    return d.groupBy(*by).agg(F.count("*").alias("n"), every(F.coalesce(fits, F.lit(False))).alias("_ok")).where(F.col("_ok") & (F.col("n") >= least)).drop("_ok")


def month_steps(dates: DataFrame, by: list[str], order: list[str], date: str = "d") -> DataFrame:
    """(by, calendar_month_step): every date is a month after the last, by day of month or by end of month; pairwise or from the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = dates.withColumn("_p", F.lag(date).over(w)).withColumn("_k", F.row_number().over(w) - 1).withColumn("_f", F.first(date).over(w))
    simple = lambda base, n: F.add_months(base, n)
    sticky = lambda base, n: F.when(base == F.last_day(base), F.last_day(F.add_months(base, n))).otherwise(F.add_months(base, n))
    first = F.col("_p").isNull()
    at = F.col(date)
    rules = [first | (at == sticky(F.col("_p"), 1)), first | (at == simple(F.col("_p"), 1)), at == sticky(F.col("_f"), F.col("_k")), at == simple(F.col("_f"), F.col("_k"))]
    got = d.groupBy(*by).agg(F.count("*").alias("n"), *(every(r).alias(f"_r{k}") for k, r in enumerate(rules)))
    return got.where("n >= 3").select(*by, F.expr("_r0 OR _r1 OR _r2 OR _r3").alias("calendar_month_step"))


def axis_score(n: Column, row: Column, col: Column, constant: Column, month: Column) -> Column:
    """Confidence that a sequence is a time axis, at most 1."""
    base = 0.05 + 0.1 * F.least(n / 12, F.lit(1.0)) + 0.1 / (1 + F.least(row, col))
    return F.least(F.lit(1.0), base + F.when(constant, 0.45).otherwise(0.0) + F.when(month, 0.45).otherwise(0.0))


def top_axes(candidates: DataFrame, sheet: str, k: int = 3) -> DataFrame:
    """The k best candidates of each sheet, by confidence, length, row, column, id."""
    w = Window.partitionBy(sheet).orderBy(F.desc("confidence"), F.desc("n"), "row", "col", "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def aligned(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Two intervals line up: they share three places, or all of one; or they are at most one apart, three long and of like length."""
    shared = F.least(a2, b2) - F.greatest(a1, b1) + 1
    la, lb = a2 - a1 + 1, b2 - b1 + 1
    gap = F.greatest(a1, b1) - F.least(a2, b2) - 1
    near = (gap <= 1) & (la >= 3) & (lb >= 3) & (F.least(la, lb) / F.greatest(la, lb) >= 0.8)
    return F.when(shared > 0, (shared >= 3) | (shared == la) | (shared == lb)).otherwise(near)


def time_dependence(aligned_: Column, depends: Column) -> tuple[Column, Column, Column]:
    """(is time dependent, confidence, penalty)."""
    conf = F.when(aligned_ & depends, 0.95).when(depends, 0.7).when(aligned_, 0.5).otherwise(0.0)
    return aligned_ | depends, conf, aligned_ & ~depends


def monotonicity(values: DataFrame, by: list[str], order: list[str], value: str = "v") -> DataFrame:
    """(by, kind): constant, increasing, decreasing or none."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = values.withColumn("_d", F.col(value) - F.lag(value).over(w))
    got = d.groupBy(*by).agg(every(F.col("_d").isNull() | (F.col("_d") == 0)).alias("c"), every(F.col("_d").isNull() | (F.col("_d") >= 0)).alias("i"), every(F.col("_d").isNull() | (F.col("_d") <= 0)).alias("d"))
    return got.select(*by, F.when(F.col("c"), "constant").when(F.col("i"), "increasing").when(F.col("d"), "decreasing").otherwise("none").alias("kind"))


def families(cells: DataFrame, sheet: str, canonical: str, order: list[str], member: str) -> DataFrame:
    """(family_id, sheet, canonical, ordinal, member, representative) of formulas shared by two members or more; ordinals from 0."""
    one = Window.partitionBy(sheet, canonical)
    w = one.orderBy(*order)
    f = cells.where(F.col(canonical).isNotNull()).withColumn("_n", F.count("*").over(one)).where("_n >= 2")
    ident = F.concat(F.lit("ff_"), F.substring(F.sha2(F.concat_ws("|", F.col(sheet).cast("string"), F.col(canonical)), 256), 1, 16))
    return f.select(ident.alias("family_id"), sheet, canonical, (F.row_number().over(w) - 1).alias("ordinal"), member, F.first(member).over(w).alias("representative"))


def table_candidates(vectors: DataFrame) -> DataFrame:
    """Column vectors (sheet, r1, r2, col, class) of equal rows in adjacent columns: (sheet, r1, c1, r2, c2, kind, confidence).

    A segment of two columns and three rows is a grid; a single column is a vector if it's long enough or an input; else nothing.
    """
    runs = islands(vectors.select("sheet", "r1", "r2", "col").distinct(), ["sheet", "r1", "r2"], "col")
    known = vectors.groupBy("sheet", "r1", "r2", "col").agg(F.max(F.col("class").isin("input", "assumption")).alias("io"))
    runs = runs.join(known.withColumnRenamed("col", "first"), ["sheet", "r1", "r2", "first"])
    rows = F.col("r2") - F.col("r1") + 1
    kind = F.when((F.col("n") >= 2) & (rows >= 3), "grid").when((F.col("n") == 1) & ((rows >= 5) | F.col("io")), "vector")
    conf = F.when(kind == "grid", F.when(rows >= 10, 0.9).otherwise(0.8)).otherwise(F.when(F.col("io"), 0.85).otherwise(0.8))
    return runs.select("sheet", "r1", F.col("first").alias("c1"), "r2", F.col("last").alias("c2"), kind.alias("kind"), conf.alias("confidence")).where("kind IS NOT NULL")
