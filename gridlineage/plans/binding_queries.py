"""Queries of binding refinement, names and overlay events."""

from pyspark.sql import functions as F

from gridlineage.operators import grouping, names, overlay
from gridlineage.plans.catalog import query

_CELLS = "SELECT DISTINCT l_partkey % 240 AS r, l_suppkey % 100 AS c FROM lineitem"


@query(f"""WITH c AS ({_CELLS}), x AS (SELECT s_suppkey, s_nationkey AS r1, s_suppkey % 20 AS c1, s_nationkey + s_suppkey % 3 AS r2, s_suppkey % 20 + s_suppkey % 2 AS c2 FROM supplier),
g AS (SELECT r1, c1, r2, c2, min(r) AS a, min(c) AS b, max(r) AS d, max(c) AS e, count(*) AS n, max((r * c) % 11 = 10) AS f FROM (SELECT DISTINCT r1, c1, r2, c2 FROM x) JOIN c ON r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY ALL)
SELECT DISTINCT a AS r1, b AS c1, d AS r2, e AS c2 FROM g WHERE NOT f AND n = (d - a + 1) * (e - b + 1)""")
def constant_ranges(t):
    cells = t.lineitem.select(F.lit(1).alias("sheet_id"), (F.col("l_partkey") % 240).alias("row"), (F.col("l_suppkey") % 100).alias("col")).distinct().withColumn("has_formula", F.expr("(row * col) % 11 = 10"))
    n, s = F.col("s_nationkey"), F.col("s_suppkey")
    rects = t.supplier.select(F.lit(1).alias("sheet_id"), n.cast("long").alias("r1"), (s % 20).alias("c1"), (n + s % 3).alias("r2"), (s % 20 + s % 2).alias("c2"))
    return grouping.constant_ranges(rects, cells).drop("sheet_id")


@query("""WITH i AS (SELECT DISTINCT c_nationkey AS s, c_custkey % 300 AS r1, c_custkey % 300 + c_custkey % 7 AS r2 FROM customer), m AS (SELECT *, max(r2) OVER (PARTITION BY s ORDER BY r1, r2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR r1 > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY r1, r2) AS g FROM m) SELECT s, min(r1) AS r1, max(r2) AS r2 FROM g GROUP BY s, g""")
def row_cover(t):
    k = F.col("c_custkey")
    return grouping.row_cover(t.customer.select(F.col("c_nationkey").alias("s"), (k % 300).alias("r1"), (k % 300 + k % 7).alias("r2")), ["s"])


@query("""WITH b AS (SELECT p_partkey AS id, p_size AS sheet, p_partkey % 7 AS n FROM part), h AS (SELECT id, sheet, n FROM b WHERE n BETWEEN 1 AND 6 AND id % 3 = 0)
SELECT sheet, id, CAST(id * 10 AS BIGINT) AS r1, CAST(2 + k AS BIGINT) AS c1, CAST(id * 10 + 4 AS BIGINT) AS r2, CAST(2 + k AS BIGINT) AS c2 FROM h, (SELECT unnest(range(7)) AS k) WHERE k <= n UNION ALL SELECT sheet, id, id * 10, 2, id * 10 + 4, 2 + n FROM b WHERE NOT (n BETWEEN 1 AND 6 AND id % 3 = 0)""")
def scenario_split(t):
    k = F.col("p_partkey")
    b = t.part.select(k.alias("id"), F.col("p_size").alias("sheet"), (k * 10).alias("r1"), F.lit(2).cast("long").alias("c1"), (k * 10 + 4).alias("r2"), (2 + k % 7).alias("c2"))
    head = b.where("id % 3 = 0").select("sheet", (F.col("r1") - 1).alias("row"), F.explode(F.sequence("c1", "c2")).alias("col")).withColumn("text", F.concat(F.lit("Shock "), "col"))
    return grouping.split_scenarios(b, head)


@query("""SELECT a.p_partkey AS table_id, b.p_partkey AS index_id FROM (SELECT p_partkey, p_size, p_partkey % 4 AS r1, p_partkey % 9 AS c1 FROM part WHERE p_partkey % 5 > 1) a JOIN (SELECT p_partkey, p_size, p_partkey % 4 AS r1, p_partkey % 8 AS c2 FROM part WHERE p_partkey % 5 <= 1) b ON a.p_size = b.p_size AND a.r1 = b.r1 AND a.c1 = b.c2 + 1""")
def index_vector_merge(t):
    k = F.col("p_partkey")
    box = lambda d, c1, c2: d.select(k.alias("id"), F.col("p_size").alias("sheet"), (k % 4).alias("r1"), (k % 4 + 9).alias("r2"), c1.alias("c1"), c2.alias("c2"))
    return grouping.merge_index_vectors(box(t.part.where("p_partkey % 5 <= 1"), k % 8, k % 8), box(t.part.where("p_partkey % 5 > 1"), k % 9, k % 9 + 3))


@query("""SELECT o_orderkey AS anchor_id, o_orderkey + 1000000 AS vector_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F'""")
def anchor_merge(t):
    k = F.col("o_orderkey")
    a = t.orders.where("o_orderkey % 3 = 0").select(F.lit(1).alias("sheet"), k.alias("id"), (k * 10).alias("r1"), F.lit(2).alias("c1"))
    v = t.orders.select(F.lit(1).alias("sheet"), (k + 1000000).alias("id"), (k * 10 + 1).alias("r1"), F.lit(2).alias("c1"), (k * 10 + 8).alias("r2"), F.lit(2).alias("c2"))
    e = t.orders.where("o_orderstatus <> 'F'").select((k + 1000000).alias("src"), k.alias("dst"))
    return grouping.anchor_merge(a, v, e)


@query("""WITH s AS (SELECT DISTINCT o_orderstatus AS sig, o_orderkey // 5 * 5 AS first, o_orderkey // 5 * 5 + 4 AS last FROM orders), g AS (SELECT *, first // 5 - row_number() OVER (PARTITION BY sig ORDER BY first) AS g FROM s) SELECT sig, min(first) AS first, max(last) AS last, count(*) AS parts FROM g GROUP BY sig, g""")
def segment_merge(t):
    first = F.floor(F.col("o_orderkey") / 5) * 5
    return grouping.merge_segments(t.orders.select(F.col("o_orderstatus").alias("sig"), first.alias("first"), (first + 4).alias("last")).distinct(), ["sig"])


@query("""SELECT p_partkey, round(CASE WHEN p_size > 10 THEN 0.4 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0 END + 0.2 * least(p_size / 40.0, 1.0) + CASE WHEN p_partkey % 3 = 0 THEN 0.1 ELSE 0 END + 0.1, 6)::DOUBLE AS score FROM part""")
def init_merge_score(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select("p_partkey", F.round(grouping.init_score(s > 10, k % 2 == 0, s / 40.0, k % 3 == 0, F.lit(True)), 6).alias("score"))


@query("""WITH e AS (SELECT l_orderkey AS f, l_partkey AS rect, l_linenumber AS rows, l_suppkey % 4 + 1 AS cols FROM lineitem) SELECT DISTINCT a.rect FROM e a JOIN e b ON a.f = b.f WHERE a.rows > 1 AND a.cols > 1 AND (b.rows = 1 OR b.cols = 1) AND greatest(b.rows, b.cols) IN (a.rows, a.cols)""")
def keep_matrix(t):
    return grouping.keep_matrix(t.lineitem.select(F.col("l_orderkey").alias("from_cell"), F.col("l_partkey").alias("rect"), F.col("l_linenumber").alias("rows"), (F.col("l_suppkey") % 4 + 1).alias("cols")))


@query("""SELECT o_orderkey AS id, n_name AS sheet, 'name' || o_custkey % 40 AS name, CASE WHEN o_custkey % 40 >= 30 THEN 'UNRESOLVED:name' || o_custkey % 40 WHEN o_custkey % 40 % 3 = 0 AND n_nationkey < 10 THEN 'local' || n_nationkey WHEN o_custkey % 40 % 7 = 1 THEN 'UNRESOLVED:name' || o_custkey % 40 ELSE 'book' || o_custkey % 40 END AS target FROM orders JOIN nation ON n_nationkey = o_orderkey % 25""")
def name_resolution(t):
    k = F.col("o_custkey") % 40
    uses = t.orders.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("o_orderkey") % 25).select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("sheet"), F.concat(F.lit("name"), k).alias("name"))
    i = F.explode(F.sequence(F.lit(0), F.lit(29)))
    book = t.region.where("r_regionkey = 0").select(i.alias("i")).select(F.concat(F.lit("NAME"), "i").alias("name"), F.lit(None).cast("string").alias("scope"), F.concat(F.lit("book"), "i").alias("target"), (F.col("i") % 7 == 1).alias("is_external"))
    local = t.nation.where("n_nationkey < 10").select("*", i.alias("i")).where("i % 3 = 0").select(F.concat(F.lit("name"), "i").alias("name"), F.col("n_name").alias("scope"), F.concat(F.lit("local"), "n_nationkey").alias("target"), F.lit(False).alias("is_external"))
    return names.resolve(uses, book.unionByName(local))


@query("""SELECT s_suppkey AS id, CAST(CASE s_suppkey % 4 WHEN 1 THEN 10 WHEN 2 THEN 10 ELSE 11 END AS INT) AS r1, CAST(CASE s_suppkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 4 END AS INT) AS c1, CAST(CASE s_suppkey % 4 WHEN 1 THEN 30 WHEN 2 THEN 10 ELSE 29 END AS INT) AS r2, CAST(CASE s_suppkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 6 ELSE 4 END AS INT) AS c2 FROM supplier""")
def structured_refs(t):
    k = F.col("s_suppkey") % 4
    uses = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(k == 0, "Tbl[Amount]").when(k == 1, "tbl[#All]").when(k == 2, "Tbl[#Headers]").otherwise("Tbl[[#Data],[rate]]").alias("ref"))
    table = t.region.where("r_regionkey = 0").select(F.lit("Tbl").alias("name"), F.lit(1).alias("sheet_id"), F.lit(10).alias("r1"), F.lit(3).alias("c1"), F.lit(30).alias("r2"), F.lit(6).alias("c2"), F.lit(1).alias("header_rows"), F.lit(1).alias("totals_rows"), F.array(*map(F.lit, ("Id", "Rate", "Amount", "Note"))).alias("columns"))
    return names.structured(uses, table).select("id", "r1", "c1", "r2", "c2")


@query("""SELECT c_custkey AS id, CAST(k AS INT) AS sheet_id FROM customer, (SELECT unnest(range(25)) AS k) WHERE k BETWEEN least(c_nationkey, c_custkey % 25) AND greatest(c_nationkey, c_custkey % 25)""")
def three_d_refs(t):
    n = t.nation.select(F.col("n_nationkey").alias("sheet_id"), F.col("n_name").alias("sheet_name"))
    a = t.nation.select(F.col("n_nationkey").alias("ka"), F.lower("n_name").alias("first"))
    b = t.nation.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("last"))
    uses = t.customer.join(F.broadcast(a), F.col("ka") == F.col("c_nationkey")).join(F.broadcast(b), F.col("kb") == F.col("c_custkey") % 25).select(F.col("c_custkey").alias("id"), "first", "last")
    return names.three_d(uses, n)


@query("""SELECT o_orderkey AS id, 'fn' || o_custkey % 20 AS name FROM orders WHERE o_custkey % 20 < 15 UNION SELECT o_orderkey, 'fn3' FROM orders WHERE o_orderkey % 2 = 0""")
def udf_calls(t):
    f = F.concat(F.lit("=FN"), F.col("o_custkey") % 20, F.lit("(A1)+SUM(B1)"), F.when(F.col("o_orderkey") % 2 == 0, "+Fn3(\"fn4(\")").otherwise(""))
    known = t.region.where("r_regionkey = 0").select(F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i")).select(F.concat(F.lit("fn"), "i").alias("name"))
    return names.user_functions(t.orders.select(F.col("o_orderkey").alias("id"), f.alias("f")), known)


@query("""WITH e AS (SELECT user_id AS overlay, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id FROM events), f AS (SELECT overlay, CASE WHEN overlay % 4 = 0 AND k > 3 THEN k + 1 ELSE k END AS id, CASE WHEN overlay % 5 = 0 AND k = 2 THEN 'x' ELSE 'set_label' END AS action FROM e)
SELECT overlay, id, CASE WHEN overlay % 4 = 0 AND id > 3 THEN 'id' ELSE 'action' END AS fault FROM f WHERE (overlay % 4 = 0 AND id > 3) OR action = 'x'""")
def overlay_validate(t):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    e = t.events.select(F.col("user_id").alias("overlay"), k.alias("k"))
    e = e.select("overlay", F.when((F.col("overlay") % 4 == 0) & (F.col("k") > 3), F.col("k") + 1).otherwise(F.col("k")).alias("id"), F.when((F.col("overlay") % 5 == 0) & (F.col("k") == 2), "x").otherwise("set_label").alias("action"))
    return overlay.gaps(e)


@query("""SELECT user_id AS overlay, event_type AS binding, CAST(arg_max(event_id, event_id) AS VARCHAR) AS label, true AS active FROM events GROUP BY 1, 2""")
def overlay_fold(t):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t.events.select(F.col("user_id").alias("overlay"), k.alias("id"), F.lit("set_label").alias("action"), F.col("event_type").alias("binding"), F.col("event_id").cast("string").alias("value"))
    return overlay.fold(e).select("overlay", "binding", "label", "active")
