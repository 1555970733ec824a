"""Queries that compare two versions: the second is the first with edits by key."""

from pyspark.sql import functions as F

from gridlineage.operators import diff
from gridlineage.plans.catalog import query

_A = "SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey % 50 <> 7"
_B = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 3 THEN o_totalprice + 1 WHEN o_orderkey % 20 = 4 THEN o_totalprice * (1 + 1e-12) ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 9 = 1 THEN 'X' ELSE o_orderstatus END AS s, o_custkey AS c FROM orders WHERE o_orderkey % 50 <> 8"


def _two(t):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    a = t.orders.where("o_orderkey % 50 <> 7").select(k.alias("k"), v.alias("v"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    b = t.orders.where("o_orderkey % 50 <> 8").select(k.alias("k"), F.when(k % 20 == 3, v + 1).when(k % 20 == 4, v * (1 + 1e-12)).otherwise(v).alias("v"), F.when(k % 9 == 1, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.col("o_custkey").alias("c"))
    return a, b


_CELLDIFF = f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM ({_A}) a FULL JOIN ({_B}) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR abs(a.v - b.v) > 1e-9 * greatest(abs(a.v), abs(b.v))"""


def _celldiff(t):
    a, b = _two(t)
    return diff.keyed(a, b, ["k"], "v", F.abs(F.col("_a") - F.col("_b")) <= 1e-9 * F.greatest(F.abs("_a"), F.abs("_b")))


@query(_CELLDIFF)
def diff_cells(t):
    return _celldiff(t).select("k", "change")


@query(f"""SELECT coalesce(a.k, b.k) AS k, a.s AS old, b.s AS new, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM ({_A}) a FULL JOIN ({_B}) b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s""")
def diff_names(t):
    a, b = _two(t)
    return diff.keyed(a, b, ["k"], "s")


@query(f"""WITH a AS (SELECT DISTINCT s, c FROM ({_A})), b AS (SELECT DISTINCT s, c FROM ({_B})) SELECT *, 'REMOVED' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'ADDED' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def diff_edges(t):
    a, b = _two(t)
    return diff.edges(a.select("s", "c"), b.select("s", "c"))


@query(f"SELECT 'CELL_' || change AS type, count(*) AS n FROM ({_CELLDIFF}) GROUP BY ROLLUP (1)")
def diff_summary(t):
    return diff.summary(_celldiff(t).select(F.concat(F.lit("CELL_"), "change").alias("type")))


@query(f"SELECT count(*) AS uncovered FROM orders WHERE false")
def diff_verify(t):
    a, b = _two(t)
    return diff.uncovered(a.select("k"), b.select("k"), _celldiff(t), "k").agg(F.count("*").alias("uncovered"))


@query(f"""SELECT CASE change WHEN 'ADDED' THEN 'CELL_ADDED' WHEN 'CHANGED' THEN 'CELL_CHANGED' ELSE 'CELL_REMOVED' END AS type, CAST(k AS VARCHAR) AS key, CAST(7 AS BIGINT) AS tier FROM ({_CELLDIFF})""")
def diff_order(t):
    c = _celldiff(t).select(F.concat(F.lit("CELL_"), "change").alias("type"), F.col("k").cast("string").alias("key"), F.lit("").alias("details"))
    return diff.in_order(c).select("type", "key", F.col("tier").cast("long").alias("tier"))


_FP = "SELECT p_brand AS sheet, p_type || '|' || p_size % 5 AS fp FROM part WHERE p_partkey % 3 {0} 0"


@query(f"""WITH a AS ({_FP.format('<>')}), b AS (SELECT 'New ' || sheet AS sheet, fp FROM ({_FP.format('<>')}) UNION ALL {_FP.format('=')}), ca AS (SELECT sheet, fp, count(*) AS n FROM a GROUP BY 1, 2), cb AS (SELECT sheet, fp, count(*) AS n FROM b GROUP BY 1, 2),
s AS (SELECT ca.sheet AS x, cb.sheet AS y, sum(least(ca.n, cb.n)) AS s FROM ca JOIN cb USING (fp) GROUP BY 1, 2) SELECT x AS sheet_a, y AS sheet_b, round(s / greatest((SELECT count(*) FROM a WHERE sheet = x), (SELECT count(*) FROM b WHERE sheet = y)), 6)::DOUBLE AS score FROM s""")
def sheet_rename_score(t):
    return _renames(t).withColumn("score", F.round("score", 6))


def _renames(t):
    fp = F.concat("p_type", F.lit("|"), F.col("p_size") % 5).alias("fp")
    a = t.part.where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("sheet"), fp)
    b = a.select(F.concat(F.lit("New "), "sheet").alias("sheet"), "fp").union(t.part.where("p_partkey % 3 = 0").select("p_brand", fp))
    return diff.rename_scores(a, b)


@query("""SELECT DISTINCT p_brand AS sheet_a, 'New ' || p_brand AS sheet_b, CAST(1 AS DOUBLE) AS score FROM part WHERE p_partkey % 3 <> 0""")
def sheet_rename(t):
    return diff.mutual_best(_renames(t)).select("sheet_a", "sheet_b", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT sha256(p_type || p_size || p_brand) AS fp, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1) SELECT k AS k_a, k + 10 AS k_b FROM a WHERE n = 1""")
def binding_match_moved(t):
    a = t.part.select(F.sha2(F.concat("p_type", "p_size", "p_brand"), 256).alias("fp"), F.col("p_partkey").alias("k"))
    return diff.unique_matches(a, a.withColumn("k", F.col("k") + 10), "fp", "k")


@query("""SELECT l_orderkey * 10 + l_linenumber AS cell_a, l_orderkey * 10 + l_linenumber + 2 AS cell_b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 2)""")
def cell_match_offset(t):
    c = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    cell = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    a = c.select(F.col("l_orderkey").alias("binding_a"), cell.alias("cell_a"), F.col("l_linenumber").alias("at"))
    b = c.select(F.col("l_orderkey").alias("binding_b"), cell.alias("cell_b"), F.col("l_linenumber").alias("at"))
    anchors = c.select(F.col("l_orderkey").alias("binding_a"), F.col("l_orderkey").alias("binding_b")).distinct().withColumn("shift", F.lit(2))
    return diff.moved_by_offset(a, anchors, b)


@query("""SELECT p_size AS sheet, kind, count(*) AS n FROM (SELECT p_size, CASE WHEN p_partkey % 10 = 4 THEN 'deleted' ELSE 'matched' END AS kind FROM part) GROUP BY ALL""")
def axis_lcs(t):
    a = t.part.select(F.col("p_size").alias("sheet"), F.col("p_partkey").alias("at"), F.col("p_partkey").cast("string").alias("sig"))
    return diff.axis_edits(a, a.where("at % 10 <> 4")).groupBy("sheet", "kind").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN 'added' WHEN c_custkey % 10 = 2 THEN 'removed' WHEN c_custkey % 10 = 3 THEN 'modified' WHEN c_custkey % 10 = 4 THEN 'moved' ELSE 'unchanged' END AS status FROM customer""")
def binding_map(t):
    k = F.col("c_custkey")
    a = t.customer.where("c_custkey % 10 <> 1").select(k.alias("id"), k.alias("at"), F.col("c_name").alias("fp"))
    b = t.customer.where("c_custkey % 10 <> 2").select(k.alias("id"), F.when(k % 10 == 4, k + 1).otherwise(k).alias("at"), F.when(k % 10 == 3, "x").otherwise(F.col("c_name")).alias("fp"))
    return diff.binding_map(a, b)
