"""Queries of ordered sequences, families and table candidates."""

from pyspark.sql import functions as F

from gridlineage.functions import text
from gridlineage.operators import series
from gridlineage.plans.catalog import query


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER w AS d, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT *, max(CASE WHEN k = 2 THEN d END) OVER (PARTITION BY o_custkey) AS d0 FROM d)
SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, k) AS first, arg_max(o_orderkey, k) AS last, bool_and(d IS NULL OR d > 1e-6) AS monotone, bool_and(d IS NULL OR abs(d - d0) <= greatest(1e-6, 1e-6 * abs(d0))) AS constant_step FROM e GROUP BY o_custkey HAVING count(*) >= 3""")
def sequence_profile(t):
    return series.profile(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


_MONTHS = """SELECT user_id AS s, k, CASE WHEN user_id % 3 = 0 THEN CAST(date_trunc('month', CAST('2020-01-01' AS DATE) + to_months(CAST(user_id % 12 + k AS INT))) AS DATE)
 WHEN user_id % 3 = 1 THEN last_day(CAST('2020-01-01' AS DATE) + to_months(CAST(user_id % 12 + k AS INT))) ELSE CAST(CAST('2020-01-15' AS DATE) + CAST(user_id % 2 * k + k * 30 AS INT) AS DATE) END AS d
 FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(6)) AS k)"""


def _months(t):
    u, k = F.col("user_id"), F.col("k")
    base = F.lit("2020-01-01").cast("date")
    n = (u % 12 + k).cast("int")
    d = F.when(u % 3 == 0, F.trunc(F.add_months(base, n), "month")).when(u % 3 == 1, F.last_day(F.add_months(base, n))).otherwise(F.date_add(F.lit("2020-01-15").cast("date"), (u % 2 * k + k * 30).cast("int")))
    return t.events.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(u.alias("s"), "k", d.alias("d"))


@query("""SELECT DISTINCT user_id AS s, user_id % 3 <> 2 AS calendar_month_step FROM events""")
def calendar_month_step(t):
    return series.month_steps(_months(t), ["s"], ["k"])


_SCORED = """SELECT p_partkey AS id, p_size AS sheet, CAST(p_partkey % 20 + 3 AS BIGINT) AS n, p_partkey % 9 + 1 AS "row", p_partkey % 5 + 1 AS col, p_partkey % 2 = 0 AS c, p_partkey % 3 = 0 AS m FROM part"""
_SCORE = """round(least(1.0, 0.05 + 0.1 * least(n / 12.0, 1.0) + 0.1 / (1 + least("row", col)) + CASE WHEN c THEN 0.45 ELSE 0.0 END + CASE WHEN m THEN 0.45 ELSE 0.0 END), 6)::DOUBLE"""


def _scored(t):
    k = F.col("p_partkey")
    s = t.part.select(k.alias("id"), F.col("p_size").alias("sheet"), (k % 20 + 3).alias("n"), (k % 9 + 1).alias("row"), (k % 5 + 1).alias("col"), (k % 2 == 0).alias("c"), (k % 3 == 0).alias("m"))
    return s.withColumn("confidence", F.round(series.axis_score(*(F.col(x) for x in ("n", "row", "col", "c", "m"))), 6))


@query(f"SELECT id, {_SCORE} AS confidence FROM ({_SCORED})")
def time_axis_score(t):
    return _scored(t).select("id", "confidence")


@query(f"""WITH s AS (SELECT *, {_SCORE} AS confidence FROM ({_SCORED})), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY confidence DESC, n DESC, "row", col, id) AS rank FROM s) SELECT sheet, id, rank FROM r WHERE rank <= 3""")
def time_axis_top3(t):
    return series.top_axes(_scored(t), "sheet").select("sheet", "id", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT user_id, value, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS d FROM events)
SELECT user_id, CASE WHEN bool_and(d IS NULL OR d = 0) THEN 'constant' WHEN bool_and(d IS NULL OR d >= 0) THEN 'increasing' WHEN bool_and(d IS NULL OR d <= 0) THEN 'decreasing' ELSE 'none' END AS kind FROM e GROUP BY user_id""")
def monotonicity(t):
    return series.monotonicity(t.events, ["user_id"], ["ts", "event_id"], "value")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS c, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, CASE WHEN lo = hi THEN 'constant' ELSE 'varied' END AS kind FROM l""")
def constant_groups(t):
    g = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return g.select("l_orderkey", "l_linenumber", F.when(F.col("lo") == F.col("hi"), "constant").otherwise("varied").alias("kind"))


@query("""WITH s AS (SELECT c_custkey, c_custkey % 20 AS a1, c_custkey % 20 + c_custkey % 9 AS a2, c_nationkey AS b1, c_nationkey + c_custkey % 7 AS b2, c_acctbal > 0 AS dep FROM customer),
g AS (SELECT *, least(a2, b2) - greatest(a1, b1) + 1 AS sh, a2 - a1 + 1 AS la, b2 - b1 + 1 AS lb, greatest(a1, b1) - least(a2, b2) - 1 AS gap FROM s),
h AS (SELECT c_custkey, dep, CASE WHEN sh > 0 THEN sh >= 3 OR sh = la OR sh = lb ELSE gap <= 1 AND la >= 3 AND lb >= 3 AND least(la, lb) / greatest(la, lb) >= 0.8 END AS al FROM g)
SELECT c_custkey, al OR dep AS time_dependent, CAST(CASE WHEN al AND dep THEN 0.95 WHEN dep THEN 0.7 WHEN al THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, al AND NOT dep AS penalty FROM h""")
def time_dependence(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    s = t.customer.select("c_custkey", series.aligned(k % 20, k % 20 + k % 9, n, n + k % 7).alias("al"), (F.col("c_acctbal") > 0).alias("dep"))
    dependent, confidence, penalty = series.time_dependence(F.col("al"), F.col("dep"))
    return s.select("c_custkey", dependent.alias("time_dependent"), confidence.alias("confidence"), penalty.alias("penalty"))


@query("""WITH c AS (SELECT p_size, p_type, p_partkey, count(*) OVER (PARTITION BY p_size, p_type) AS n FROM part WHERE p_type IS NOT NULL)
SELECT 'ff_' || substr(sha256(CAST(p_size AS VARCHAR) || '|' || p_type), 1, 16) AS family_id, p_size, p_type, CAST(row_number() OVER w - 1 AS INT) AS ordinal, p_partkey, first_value(p_partkey) OVER w AS representative FROM c WHERE n >= 2 WINDOW w AS (PARTITION BY p_size, p_type ORDER BY p_partkey)""")
def formula_families(t):
    return series.families(t.part, "p_size", "p_type", ["p_partkey"], "p_partkey")


_VECTORS = """SELECT DISTINCT s_nationkey % 5 AS sheet, s_suppkey % 4 * 10 AS r1, s_suppkey % 4 * 10 + s_nationkey % 12 AS r2, s_suppkey % 30 AS col, CASE WHEN s_suppkey % 4 = 1 THEN 'input' ELSE 'calc' END AS class FROM supplier"""


@query(f"""WITH v AS ({_VECTORS}), d AS (SELECT DISTINCT sheet, r1, r2, col FROM v), g AS (SELECT *, col - row_number() OVER (PARTITION BY sheet, r1, r2 ORDER BY col) AS g FROM d),
s AS (SELECT sheet, r1, r2, min(col) AS c1, max(col) AS c2, count(*) AS n, r2 - r1 + 1 AS h FROM g GROUP BY sheet, r1, r2, g), k AS (SELECT sheet, r1, r2, col AS c1, max(class IN ('input', 'assumption')) AS io FROM v GROUP BY 1, 2, 3, 4),
j AS (SELECT *, CASE WHEN n >= 2 AND h >= 3 THEN 'grid' WHEN n = 1 AND (h >= 5 OR io) THEN 'vector' END AS kind FROM s JOIN k USING (sheet, r1, r2, c1))
SELECT sheet, r1, c1, r2, c2, kind, CAST(CASE WHEN kind = 'grid' THEN CASE WHEN h >= 10 THEN 0.9 ELSE 0.8 END WHEN io THEN 0.85 ELSE 0.8 END AS DOUBLE) AS confidence FROM j WHERE kind IS NOT NULL""")
def table_candidates(t):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    v = t.supplier.select((n % 5).alias("sheet"), (k % 4 * 10).alias("r1"), (k % 4 * 10 + n % 12).alias("r2"), (k % 30).alias("col"), F.when(k % 4 == 1, "input").otherwise("calc").alias("class"))
    return series.table_candidates(v)


@query("""WITH i AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linenumber + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber > 5 THEN 4 ELSE 0 END END ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY l_orderkey),
n AS (SELECT l_orderkey, len(v) AS m, list_filter(v, lambda x: x IS NOT NULL) AS k FROM i), d AS (SELECT *, list_transform(range(2, len(k) + 1), lambda j: k[j] - k[j - 1]) AS s FROM n)
SELECT l_orderkey, len(k) >= 5 AND len(k) / m >= 0.7 AND len(list_filter(s, lambda x: x <= 0)) = 0 AND len(list_filter(s, lambda x: x = 1)) >= greatest(3, floor((len(k) - 1) * 0.8)) AS axis FROM d""")
def continuous_time_axis(t):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    header = F.when(F.col("l_partkey") % 11 == 0, "Stress 2").when(n % 2 == 0, F.concat(F.lit("Year "), n + F.when((k % 3 == 0) & (n > 5), 4).otherwise(0))).otherwise((n + F.when((k % 3 == 0) & (n > 5), 4).otherwise(0)).cast("string"))
    rows = t.lineitem.select(k, F.struct(n, "l_partkey", text.time_index(header).alias("i")).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s")).select("l_orderkey", text.is_time_axis(F.transform("s", lambda x: x["i"])).alias("axis"))
