"""Queries of scans, addresses, finalizing, views, edges and grouping."""

from pyspark.sql import functions as F

from gridlineage.functions import address, text
from gridlineage.operators import edges, finalize, grid, grouping, series, views
from gridlineage.plans.catalog import query

PART_GRID = """SELECT p_partkey + 1 AS "row", 1 AS col, p_name AS value FROM part
UNION ALL SELECT p_partkey + 1, 2, p_brand FROM part UNION ALL SELECT p_partkey + 1, 3, p_type FROM part
UNION ALL SELECT p_partkey + 1, 4, CAST(p_size AS VARCHAR) FROM part"""


def part_grid(t):
    p = t.part.select((F.col("p_partkey") + 1).alias("row"), "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    cols = F.array(*(F.struct(F.lit(k).alias("col"), F.col(c).alias("value")) for k, c in enumerate(("p_name", "p_brand", "p_type", "p_size"), 1)))
    return p.select("row", F.inline(cols))


@query(PART_GRID)
def cells_grid(t):
    return part_grid(t)


@query(f'SELECT "row", col, 17592186044416 * 3 + "row" * 1048576 + col AS cell_id FROM ({PART_GRID})')
def cell_id_pack(t):
    return part_grid(t).select("row", "col", address.pack(F.lit(3), F.col("row"), F.col("col")).alias("cell_id"))


@query(f'SELECT 3 AS sheet, CAST("row" AS INT) AS "row", col FROM ({PART_GRID})')
def cell_id_unpack(t):
    s, r, c = address.unpack(address.pack(F.lit(3), F.col("row"), F.col("col")))
    return part_grid(t).select(s.alias("sheet"), r.alias("row"), c.alias("col"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey % 16384 + 1 AS c FROM orders)
SELECT o_orderkey, CAST(c AS INT) AS back,
 (CASE WHEN c > 702 THEN chr(CAST(65 + (c - 703) // 676 AS INT)) ELSE '' END) || (CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INT)) ELSE '' END) || chr(CAST(65 + (c - 1) % 26 AS INT)) || CAST(o_orderkey AS VARCHAR) AS a1 FROM k""")
def a1_address(t):
    c = F.col("o_orderkey") % 16384 + 1
    return t.orders.select("o_orderkey", address.number(address.letters(c)).cast("int").alias("back"), address.a1(F.col("o_orderkey"), c).alias("a1"))


@query("""SELECT o_orderkey, 'Sheet ' || o_orderstatus AS sheet, least(o_orderkey % 1000 + 1, o_custkey + 1) AS r1, greatest(o_orderkey % 1000 + 1, o_custkey + 1) AS r2, 2 AS c1, 28 AS c2 FROM orders""")
def a1_range_parse(t):
    ref = F.concat(F.lit("'Sheet "), "o_orderstatus", F.lit("'!$B$"), (F.col("o_orderkey") % 1000 + 1).cast("string"), F.lit(":AB"), (F.col("o_custkey") + 1).cast("string"))
    p = t.orders.select("o_orderkey", address.parse_a1(ref).alias("p"))
    return p.select("o_orderkey", "p.sheet", F.col("p.r1").cast("long").alias("r1"), F.col("p.r2").cast("long").alias("r2"), "p.c1", "p.c2")


@query("""SELECT n_nationkey, CASE WHEN regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*') THEN n_name ELSE '''' || replace(n_name, '''', '''''') || '''' END AS quoted,
 CASE WHEN n_nationkey % 2 = 0 THEN '$' || chr(65 + n_nationkey) || '$1:' || chr(65 + n_nationkey) || '1048576' ELSE 'A' || (n_nationkey + 1) || ':XFD' || (n_nationkey + 3) END AS extent FROM nation""")
def sheet_quote_and_extent(t):
    k = F.col("n_nationkey")
    letter = F.char(65 + k)
    ref = F.when(k % 2 == 0, F.concat(F.lit("$"), letter, F.lit(":"), letter)).otherwise(F.concat((k + 1).cast("string"), F.lit(":"), (k + 3).cast("string")))
    return t.nation.select("n_nationkey", address.quote_sheet(F.col("n_name")).alias("quoted"), address.whole_extent(ref).alias("extent"))


@query(f"""WITH g AS ({PART_GRID}), s AS (SELECT "row", col, value, CAST(NULL AS VARCHAR) AS formula FROM g UNION ALL SELECT "row", col, NULL, CASE WHEN "row" % 3 = 0 THEN 'F' || col END FROM g)
SELECT "row", col, max(value) AS value, max(formula) AS formula FROM s GROUP BY "row", col""")
def finalize_cells(t):
    g = part_grid(t)
    staged = g.withColumn("formula", F.lit(None).cast("string")).unionByName(g.select("row", "col", F.lit(None).cast("string").alias("value"), F.when(F.col("row") % 3 == 0, F.concat(F.lit("F"), "col")).alias("formula")))
    return finalize.coalesce_cells(staged, ["row", "col"], ["value", "formula"])


@query("""SELECT o_custkey, CAST((count(DISTINCT o_orderstatus) > 1)::INT + (count(DISTINCT o_orderpriority) > 1)::INT AS BIGINT) AS n_conflicts FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def conflict_cells(t):
    return finalize.conflicts(t.orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("""WITH f AS (SELECT l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS formula_r1c1, CASE WHEN l_linenumber > 3 THEN l_orderkey END AS o, l_partkey, l_suppkey, l_linenumber, 'A' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS example FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY formula_r1c1 ORDER BY o NULLS LAST, l_partkey, l_suppkey, l_linenumber, example) AS k FROM f) SELECT formula_r1c1, example FROM r WHERE k = 1""")
def formula_first_occurrence(t):
    f = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("formula_r1c1"),
        F.when(F.col("l_linenumber") > 3, F.col("l_orderkey")).alias("o"), "l_partkey", "l_suppkey", "l_linenumber",
        F.concat(F.lit("A"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey").alias("example"),
    )
    return finalize.first_occurrence(f, "formula_r1c1", ["o", "l_partkey", "l_suppkey", "l_linenumber"], "example")


@query("SELECT sha256(text) AS sha256, any_value(text) AS json, count(*) AS uses FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def blob_dedup(t):
    return finalize.blobs(t.documents, "text")


@query("SELECT DISTINCT l_orderkey AS from_cell, l_partkey AS to_cell FROM lineitem")
def edge_dedup(t):
    return t.lineitem.select(F.col("l_orderkey").alias("from_cell"), F.col("l_partkey").alias("to_cell")).distinct()


@query("SELECT l_orderkey % 500 AS from_cell, l_suppkey AS r1, l_suppkey + l_linenumber AS r2, max(CASE WHEN l_returnflag = 'R' THEN 'resolved_from_cache' END) AS provenance FROM lineitem GROUP BY 1, 2, 3")
def range_edge_dedup(t):
    e = t.lineitem.select((F.col("l_orderkey") % 500).alias("from_cell"), F.col("l_suppkey").alias("r1"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("r2"), F.when(F.col("l_returnflag") == "R", "resolved_from_cache").alias("provenance"))
    return finalize.range_edges(e, ["from_cell", "r1", "r2"])


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS h FROM orders),
b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS hb, count(*) AS n FROM h GROUP BY 1) SELECT sha256(string_agg(hb, '' ORDER BY b)) AS checksum, CAST(sum(n) AS BIGINT) AS n_rows FROM b""")
def logical_checksum(t):
    return finalize.logical_checksum(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


# --- views: nations and regions are sheets, orders are cells, customers bindings ---

def _ir(t):
    o = t.orders
    return views.IR(
        sheets=t.nation.select((F.col("n_nationkey") + 1).alias("sheet_id"), F.col("n_name").alias("sheet_name")),
        cells=o.select(F.col("o_orderkey").alias("cell_id"), (F.col("o_custkey") % 25 + 1).cast("int").alias("sheet_id"), F.col("o_orderkey").cast("int").alias("row"), (F.col("o_custkey") % 100 + 1).cast("int").alias("col"), F.concat(F.lit("c"), "o_orderkey").alias("a1"), F.when(F.col("o_orderstatus") == "F", F.length("o_orderpriority")).cast("long").alias("formula_id"), F.sha2("o_orderpriority", 256).alias("value_sha256")),
        formulas=o.select(F.length("o_orderpriority").cast("long").alias("formula_id"), F.concat(F.lit("R"), F.length("o_orderpriority")).alias("formula_r1c1"), F.concat(F.lit("="), F.length("o_orderpriority")).alias("formula_a1_example")).distinct(),
        blobs=o.select(F.sha2("o_orderpriority", 256).alias("sha256"), F.to_json(F.struct("o_orderpriority")).alias("json")).distinct(),
        bindings=t.customer.select(F.concat(F.lit("b"), "c_custkey").alias("binding_id"), (F.col("c_nationkey") + 1).alias("sheet_id"), F.concat(F.lit("A"), "c_custkey").alias("address_a1"), F.when(F.col("c_acctbal") > 0, "formula").otherwise("constant").alias("binding_type"), F.col("c_mktsegment").alias("label")),
        internal=t.lineitem.select(F.col("l_orderkey").alias("from_cell_id"), (F.col("l_partkey") % 1000).alias("to_cell_id")).distinct(),
        ranges=t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("from_cell_id"), (F.col("l_suppkey") % 25 + 1).cast("int").alias("to_sheet_id"), F.concat(F.lit("A1:A"), "l_partkey").alias("to_range_a1"), F.col("l_partkey").alias("cell_count")).distinct(),
        external=t.lineitem.where("l_linenumber = 2").select(F.col("l_orderkey").alias("from_cell_id"), F.concat(F.lit("DYNAMIC:"), "l_returnflag").alias("external_ref")).distinct(),
        procedures=t.supplier.select(F.concat(F.lit("m"), "s_nationkey").alias("module_id"), F.col("s_name").alias("name"), F.lit("sub").alias("kind"), F.when(F.col("s_acctbal") > 5000, "win64").alias("compile_branch")),
        binding_edges=t.orders.select(F.concat(F.lit("b"), "o_custkey").alias("from_binding_id"), F.when(F.col("o_orderkey") % 7 == 0, "vba::m1::x::sub").otherwise(F.concat(F.lit("b"), F.col("o_orderkey") % 100 + 1)).alias("to_binding_id")).distinct().withColumn("edge_count", F.lit(1).cast("long")).withColumn("kind", F.lit("formula")),
    )


_CELLS = "SELECT o_orderkey AS cell_id, CAST(o_custkey % 25 + 1 AS INT) AS sheet_id, CAST(o_orderkey AS INT) AS \"row\", CAST(o_custkey % 100 + 1 AS INT) AS col, 'c' || o_orderkey AS a1, CASE WHEN o_orderstatus = 'F' THEN length(o_orderpriority) END AS formula_id, o_orderpriority FROM orders"


@query(f"""WITH c AS ({_CELLS}) SELECT cell_id, n_name AS sheet_name, "row", col, a1, CASE WHEN formula_id IS NOT NULL THEN 'R' || formula_id END AS formula_r1c1, CASE WHEN formula_id IS NOT NULL THEN '=' || formula_id END AS formula_a1, '{{"o_orderpriority":"' || o_orderpriority || '"}}' AS value_json FROM c JOIN nation ON n_nationkey + 1 = sheet_id""")
def agent_cells_view(t):
    return views.agent_cells(_ir(t))


@query(f"""WITH c AS ({_CELLS}) SELECT cell_id, n_name AS sheet_name, "row", col, a1, CASE WHEN formula_id IS NOT NULL THEN 'R' || formula_id END AS formula_r1c1, CASE WHEN formula_id IS NOT NULL THEN '=' || formula_id END AS formula_a1 FROM c JOIN nation ON n_nationkey + 1 = sheet_id""")
def agent_cells_light_view(t):
    return views.agent_cells_light(_ir(t))


@query("""SELECT 'b' || c_custkey AS binding_id, n_name AS sheet_name, 'A' || c_custkey AS address_a1, CASE WHEN c_acctbal > 0 THEN 'formula' ELSE 'constant' END AS binding_type, c_mktsegment AS label FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def agent_bindings_view(t):
    return views.agent_bindings(_ir(t))


@query(f"""WITH c AS ({_CELLS}), s AS (SELECT cell_id, n_name AS sheet, a1 FROM c JOIN nation ON n_nationkey + 1 = sheet_id),
i AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 1000 AS t FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS f, l_suppkey % 25 + 1 AS sid, 'A1:A' || l_partkey AS a1, l_partkey AS n FROM lineitem WHERE l_linenumber = 1),
e AS (SELECT DISTINCT l_orderkey AS f, 'DYNAMIC:' || l_returnflag AS x FROM lineitem WHERE l_linenumber = 2)
SELECT 'cell' AS kind, a.sheet AS from_sheet, a.a1 AS from_a1, b.sheet AS to_sheet, b.a1 AS to_a1, CAST(NULL AS BIGINT) AS cell_count, CAST(NULL AS VARCHAR) AS external_ref FROM i JOIN s a ON a.cell_id = f JOIN s b ON b.cell_id = t
UNION ALL SELECT 'range', a.sheet, a.a1, n_name, r.a1, r.n, NULL FROM r JOIN s a ON a.cell_id = f JOIN nation ON n_nationkey + 1 = sid
UNION ALL SELECT 'external', a.sheet, a.a1, NULL, NULL, NULL, x FROM e JOIN s a ON a.cell_id = f""")
def agent_dependencies_view(t):
    return views.agent_dependencies(_ir(t))


@query("""SELECT 'b' || c_custkey AS node_id, 'binding' AS node_type, n_name AS sheet_name, c_mktsegment AS name FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'vba::m' || s_nationkey || '::' || s_name || '::sub' || CASE WHEN s_acctbal > 5000 THEN '::win64' ELSE '' END, 'vba_procedure', NULL, s_name FROM supplier""")
def nodes_view(t):
    return views.nodes(_ir(t))


@query("""WITH e AS (SELECT DISTINCT 'b' || o_custkey AS f, CASE WHEN o_orderkey % 7 = 0 THEN 'vba::m1::x::sub' ELSE 'b' || (o_orderkey % 100 + 1) END AS t FROM orders),
b AS (SELECT 'b' || c_custkey AS id, n_name AS sheet, 'A' || c_custkey AS addr FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT f AS from_binding_id, t AS to_binding_id, coalesce(x.sheet, 'VBA') AS from_sheet, coalesce(x.addr, f) AS from_address, coalesce(y.sheet, 'VBA') AS to_sheet, coalesce(y.addr, t) AS to_address, CAST(1 AS BIGINT) AS edge_count, 'formula' AS kind
FROM e LEFT JOIN b x ON x.id = f LEFT JOIN b y ON y.id = t""")
def agent_binding_dependencies_view(t):
    return views.agent_binding_dependencies(_ir(t))


@query("""SELECT c.n_name AS from_sheet, s.n_name AS to_sheet, count(*) AS n FROM (SELECT l_orderkey, l_suppkey FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c.n_name <> s.n_name GROUP BY 1, 2""")
def cross_sheet_census(t):
    n = t.nation
    src = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("o_orderkey") * 2).alias("node"), F.col("n_name").alias("sheet"))
    dst = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") * 2 + 1).alias("node"), F.col("n_name").alias("sheet"))
    e = t.lineitem.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return edges.cross_sheet(e, src.union(dst))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def dead_sheet(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


_MEMBERS = "SELECT o_orderkey AS cell, o_orderstatus || strftime(o_orderdate, '%Y-%m') AS binding FROM orders"


def _members(t):
    return t.orders.select(F.col("o_orderkey").alias("cell"), F.concat("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM")).alias("binding"))


@query(f"""WITH m AS ({_MEMBERS}), e AS (SELECT l_orderkey AS f, l_partkey AS t FROM lineitem) SELECT DISTINCT a.binding AS from_binding, b.binding AS to_binding, CAST(1 AS BIGINT) AS edge_count FROM e JOIN m a ON a.cell = f JOIN m b ON b.cell = t WHERE a.binding <> b.binding""")
def cell_edges_collapse(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("from_cell"), F.col("l_partkey").alias("to_cell"))
    return edges.collapse_cells(e, _members(t))


@query(f"""WITH m AS ({_MEMBERS}), r AS (SELECT DISTINCT a.binding AS fb, o_orderkey - 20 AS r1, o_orderkey + 20 AS r2, o_orderkey % 4 = 0 AS d FROM orders JOIN m a ON a.cell = o_orderkey)
SELECT fb AS from_binding, binding AS to_binding, count(DISTINCT cell) AS edge_count, CASE WHEN max(d) THEN 'range_dynamic' ELSE 'range_static' END AS kind FROM r JOIN m ON cell BETWEEN r1 AND r2 WHERE fb <> binding GROUP BY 1, 2""")
def range_breadth_union(t):
    k = F.col("o_orderkey")
    rects = t.orders.select(k.alias("from_cell"), F.lit(1).alias("sheet_id"), (k - 20).alias("r1"), F.lit(1).alias("c1"), (k + 20).alias("r2"), F.lit(1).alias("c2"), (k % 4 == 0).alias("is_dynamic"))
    cells = t.orders.select(k.alias("cell"), F.lit(1).alias("sheet_id"), k.alias("row"), F.lit(1).alias("col"))
    return edges.collapse_ranges(rects, cells, _members(t))


_KINDS = """SELECT o_custkey % 200 AS from_binding, o_orderkey % 50 AS to_binding, 'range_static' AS kind, CAST(2 AS BIGINT) AS edge_count FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey % 200, o_orderkey % 50, 'formula', 1 FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey % 200, o_orderkey % 50, 'via_vba_paste', 3 FROM orders WHERE o_orderstatus = 'P'"""


def _kinds(t):
    o = t.orders.select((F.col("o_custkey") % 200).alias("from_binding"), (F.col("o_orderkey") % 50).alias("to_binding"), "o_orderstatus")
    by = F.col("o_orderstatus")
    known = F.when(by == "F", "range_static").when(by == "O", "formula").when(by == "P", "via_vba_paste")
    n = F.when(by == "F", 2).when(by == "O", 1).otherwise(3).cast("long")
    return o.select("from_binding", "to_binding", known.alias("kind"), n.alias("edge_count")).where("kind IS NOT NULL").distinct()


@query(f"""WITH k AS ({_KINDS}), p AS (SELECT *, row_number() OVER (PARTITION BY from_binding, to_binding ORDER BY CASE kind WHEN 'formula' THEN 1 WHEN 'range_static' THEN 2 ELSE 3 END) AS r FROM k) SELECT from_binding, to_binding, kind, edge_count FROM p WHERE r = 1""")
def edge_kind_priority(t):
    return edges.merge_kinds(_kinds(t))


@query(f"""WITH k AS ({_KINDS}) SELECT from_binding, to_binding, CASE WHEN kind = 'formula' AND (from_binding + to_binding) % 3 = 0 THEN 'cell_dynamic' ELSE kind END AS kind, edge_count FROM k""")
def edge_dynamic_upgrade(t):
    k = _kinds(t)
    return edges.upgrade_dynamic(k, k.where("(from_binding + to_binding) % 3 = 0"))


@query("""WITH g AS (SELECT o_orderstatus, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders) SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM g GROUP BY o_orderstatus, g""")
def islands_runs(t):
    return grid.wide_islands(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey")


_TILES = "SELECT DISTINCT l_returnflag || CAST(l_quantity AS INT) AS sig, l_suppkey % 60 AS \"row\", l_partkey % 40 AS col FROM lineitem"


@query(f"""WITH c AS ({_TILES}), a AS (SELECT *, col - row_number() OVER (PARTITION BY sig, "row" ORDER BY col) AS g FROM c), r AS (SELECT sig, "row", min(col) AS c1, max(col) AS c2 FROM a GROUP BY sig, "row", g),
d AS (SELECT *, "row" - row_number() OVER (PARTITION BY sig, c1, c2 ORDER BY "row") AS h FROM r) SELECT sig, min("row") AS r1, c1, max("row") AS r2, c2 FROM d GROUP BY sig, c1, c2, h""")
def rectangles(t):
    c = t.lineitem.select(F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("sig"), (F.col("l_suppkey") % 60).alias("row"), (F.col("l_partkey") % 40).alias("col")).distinct()
    return grid.rectangles(c, ["sig"])


@query("""SELECT r, count(*) AS n, min(k) AS lo, max(k) AS hi FROM (SELECT s_suppkey AS r, s_suppkey * 3 AS r1, s_suppkey * 3 + s_nationkey AS r2 FROM supplier) JOIN (SELECT o_orderkey AS k, o_custkey % 3 AS c FROM orders) ON k BETWEEN r1 AND r2 AND c BETWEEN 0 AND 1 GROUP BY r""")
def range_join(t):
    rects = t.supplier.select(F.lit(1).alias("sheet_id"), F.col("s_suppkey").alias("r"), (F.col("s_suppkey") * 3).alias("r1"), (F.col("s_suppkey") * 3 + F.col("s_nationkey")).alias("r2"), F.lit(0).alias("c1"), F.lit(1).alias("c2"))
    cells = t.orders.select(F.lit(1).alias("sheet_id"), F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 3).alias("col"))
    return grid.in_rectangles(cells, rects).groupBy("r").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"))


_CELLTEXT = "SELECT conv_id AS binding, turn, CASE WHEN turn % 5 = 0 THEN 'n/a' WHEN conv_id % 3 = 0 THEN ' TBC ' WHEN conv_id % 7 = 1 THEN turn || '. Part' ELSE text END AS v FROM conversations"


def _celltext(t):
    v = F.when(F.col("turn") % 5 == 0, "n/a").when(F.col("conv_id") % 3 == 0, " TBC ").when(F.col("conv_id") % 7 == 1, F.concat("turn", F.lit(". Part"))).otherwise(F.col("text"))
    return t.conversations.select(F.col("conv_id").alias("binding"), "turn", v.alias("v"))


@query(f"""WITH c AS ({_CELLTEXT}) SELECT binding, count(*) AS n FROM c GROUP BY binding HAVING bool_and(lower(trim(v)) IN ('-', '–', '—', 'tbc', 'tbd', 'na', 'n/a', 'n.a.', 'n\\a'))""")
def placeholder_filter(t):
    return _celltext(t).groupBy("binding").agg(F.count("*").alias("n"), grid.every(text.is_placeholder(F.col("v"))).alias("ok")).where("ok").drop("ok")


@query(f"""WITH c AS (SELECT conv_id AS id, CASE WHEN turn % 4 = 3 AND conv_id % 5 = 0 THEN ' ' WHEN conv_id % 9 = 2 THEN '' WHEN conv_id % 7 = 1 THEN turn || '. Part' WHEN conv_id % 3 = 0 THEN ' TBC ' ELSE text END AS v, conv_id % 14 <> 1 AS t FROM conversations),
g AS (SELECT id, count(*) AS n, bool_and(coalesce(v, '') = '') AS e, bool_and(t AND lower(trim(v)) IN ('-', '–', '—', 'tbc', 'tbd', 'na', 'n/a', 'n.a.', 'n\\a')) FILTER (WHERE trim(v) <> '') AS p, bool_and(t) FILTER (WHERE trim(v) <> '') AND bool_or(regexp_matches(v, '(?i)^\\s*(\\d+\\.\\s+\\S|[A-Z]\\.\\s+\\S|section\\s+\\S)')) AS h FROM c GROUP BY id)
SELECT * FROM (SELECT id, CASE WHEN e THEN 'empty' WHEN id % 4 > 0 AND p AND n > 1 THEN 'placeholder' WHEN id % 4 > 0 AND h AND n BETWEEN 2 AND 10 THEN 'section_header' END AS reason FROM g) WHERE reason IS NOT NULL""")
def binding_noise(t):
    k, turn = F.col("conv_id"), F.col("turn")
    v = F.when((turn % 4 == 3) & (k % 5 == 0), " ").when(k % 9 == 2, "").when(k % 7 == 1, F.concat("turn", F.lit(". Part"))).when(k % 3 == 0, " TBC ").otherwise(F.col("text"))
    cells = t.conversations.select(k.alias("id"), v.alias("value"), (k % 14 != 1).alias("is_text"), F.lit(False).alias("has_formula"))
    return grouping.noise(cells, t.conversations.where("conv_id % 4 = 0").select(k.alias("id")))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS s FROM lineitem) SELECT l_orderkey, count(*) AS n FROM d GROUP BY l_orderkey HAVING count(*) >= 5 AND bool_and(s IS NULL OR s = 1)""")
def consecutive_int_index(t):
    return series.consecutive(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_linenumber")


@query("""SELECT p_partkey, regexp_matches(p_name || ' ' || p_type, '(?i)%|base|shock|stress|flat|scenario|scen|\\b(up|down)\\b') AS scenario FROM part""")
def scenario_headers(t):
    return t.part.select("p_partkey", text.is_scenario_header(F.concat_ws(" ", "p_name", "p_type")).alias("scenario"))


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o, l_returnflag) AS k FROM c) SELECT l_suppkey, l_returnflag, n FROM r WHERE k = 1""")
def dominant_formula(t):
    return grid.mode_first(t.lineitem, ["l_suppkey"], "l_returnflag", "l_orderkey")


@query("""WITH h AS (SELECT o_custkey % 40 AS line, o_orderkey % 300 AS at, min(o_orderpriority) AS text FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2), b AS (SELECT DISTINCT o_custkey % 40 AS line, o_orderkey % 300 AS at FROM orders WHERE o_orderkey % 3 <> 0)
SELECT b.line, b.at, h.text, CAST(b.at - h.at AS INT) AS distance FROM b JOIN h ON h.line = b.line AND b.at - h.at BETWEEN 1 AND 7 QUALIFY row_number() OVER (PARTITION BY b.line, b.at ORDER BY b.at - h.at) = 1""")
def nearest_header(t):
    o = t.orders.select((F.col("o_custkey") % 40).alias("line"), (F.col("o_orderkey") % 300).alias("at"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 3).alias("k"))
    texts = o.where("k = 0").groupBy("line", "at").agg(F.min("text").alias("text"))
    return grid.nearest(o.where("k <> 0").select("line", "at").distinct(), texts, ["line"], "at")


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey // 4 AS r1, p_size AS c1, p_partkey // 4 + p_size % 9 AS r2, p_size + p_partkey % 3 AS c2 FROM part)
SELECT x.id AS a, y.id AS b, CAST((least(x.r2, y.r2) - greatest(x.r1, y.r1) + 1) * (least(x.c2, y.c2) - greatest(x.c1, y.c1) + 1) AS BIGINT) AS cells FROM b x JOIN b y ON x.id < y.id AND x.r1 <= y.r2 AND y.r1 <= x.r2 AND x.c1 <= y.c2 AND y.c1 <= x.c2""")
def overlap_report(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    r = F.floor(k / 4)
    b = t.part.select(k.alias("id"), F.lit(1).alias("sheet_id"), r.alias("r1"), s.alias("c1"), (r + s % 9).alias("r2"), (s + k % 3).alias("c2"))
    return grid.overlaps(b)
