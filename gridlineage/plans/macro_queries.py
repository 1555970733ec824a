"""Queries of macro references, pivots, offsets and header context."""

from pyspark.sql import functions as F

from gridlineage.functions import formula
from gridlineage.operators import labels, vba
from gridlineage.plans.catalog import query


@query("""SELECT s_suppkey, 'via_offset_static' AS kind, 'Data' AS target, CAST(s_suppkey + 3 AS INT) AS r1, 4 AS c1, CAST(s_suppkey + 3 + s_nationkey AS INT) AS r2, 5 AS c2 FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'via_offset_volatile', 'Data', CAST(s_suppkey + 1 AS INT), 2, CAST(s_suppkey + 1 AS INT), 2 FROM supplier WHERE s_suppkey % 2 = 0""")
def offset_edges(t):
    k = F.col("s_suppkey")
    f = F.concat(F.lit("=SUM(OFFSET(Data!$B"), k + 1, F.lit(","), F.when(k % 2 == 1, "2").otherwise("A1"), F.lit(",2,"), F.col("s_nationkey") + 1, F.lit(",2))"))
    read = formula.udf(lambda x: formula.offsets(x, "S"), formula.EDGE)
    return t.supplier.select("s_suppkey", F.inline(read(f)))


@query("""SELECT s_suppkey, 'GETPIVOTDATA' AS function, '"Sales"|A' || (s_suppkey + 1) AS args FROM supplier""")
def pivot_calls(t):
    f = F.concat(F.lit('=1+GETPIVOTDATA("Sales",A'), F.col("s_suppkey") + 1, F.lit(")"))
    read = formula.udf(formula.pivots, "array<struct<function:string,args:array<string>>>")
    return t.supplier.select("s_suppkey", F.inline(read(f))).select("s_suppkey", "function", F.array_join("args", "|").alias("args"))


@query("""SELECT s_suppkey, '=LET( ,A' || (s_suppkey + 1) || ', *2+LEN("   "))' AS masked FROM supplier""")
def let_masking(t):
    f = F.concat(F.lit("=LET(x,A"), F.col("s_suppkey") + 1, F.lit(',x*2+LEN("abc"))'))
    return t.supplier.select("s_suppkey", formula.udf(formula.masked, "string")(f).alias("masked"))


@query("""SELECT s_suppkey, 'Calc' AS sheet, 'A' || s_suppkey || ':B9' AS address, 'write' AS access, 'exact' AS precision FROM supplier UNION ALL SELECT s_suppkey, NULL, 'C' || (s_suppkey + 1), 'read', 'exact' FROM supplier UNION ALL SELECT s_suppkey, NULL, '', 'read', 'dynamic' FROM supplier""")
def macro_refs(t):
    k = F.col("s_suppkey")
    body = F.concat(F.lit('Sheets("Calc").Range("$A$'), k, F.lit(':B9").Value = Cells('), k + 1, F.lit(', 3).Value \' Range("Z1")\nx = Range(name).Value\nRange("D1").Interior.Color = 3'))
    read = formula.udf(vba.static_refs, "array<struct<sheet:string,address:string,access:string,precision:string>>")
    return t.supplier.select("s_suppkey", F.inline(read(body)))


@query("""SELECT s_suppkey, 'B' || s_suppkey AS target, 'A' || s_nationkey AS source FROM supplier""")
def paste_edges(t):
    body = F.concat(F.lit('Range("B'), "s_suppkey", F.lit('").Value = Sheet1.Range("A'), "s_nationkey", F.lit('").Value\nErrHandler:\nRange("X1").Value = Range("Y1").Value'))
    read = formula.udf(vba.value_pastes, "array<struct<target:string,source:string>>")
    return t.supplier.select("s_suppkey", F.inline(read(body)))


@query("""SELECT 'm' || c_nationkey AS module_a, 'p' || c_custkey AS name_a, CASE WHEN c_custkey % 3 = 1 THEN 'moved' ELSE 'm' || c_nationkey END AS module_b, CASE WHEN c_custkey % 3 = 2 THEN 'q' || c_custkey ELSE 'p' || c_custkey END AS name_b, CAST(c_custkey % 3 + 1 AS INT) AS step FROM customer""")
def macro_match(t):
    k = F.col("c_custkey")
    tokens = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("t"), k * 100 + i))
    a = t.customer.select(F.concat(F.lit("m"), "c_nationkey").alias("module"), F.concat(F.lit("p"), k).alias("name"), F.lit("sub").alias("kind"), tokens.alias("tokens"))
    changed = F.transform(F.sequence(F.lit(3), F.lit(32)), lambda i: F.concat(F.lit("t"), k * 100 + i))
    b = t.customer.select(F.when(k % 3 == 1, "moved").otherwise(F.concat(F.lit("m"), "c_nationkey")).alias("module"), F.concat(F.when(k % 3 == 2, "q").otherwise("p"), k).alias("name"), F.lit("sub").alias("kind"), changed.alias("tokens"))
    return vba.match_procedures(a, b)


@query("""WITH c AS (SELECT p_size AS b, CASE p_partkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'axis' ELSE 'sheet' END AS role, p_brand AS text, p_partkey AS place FROM part), o AS (SELECT b, role, min(place) AS place, text FROM c GROUP BY b, role, text) SELECT b, list(text ORDER BY CASE role WHEN 'primary' THEN 1 WHEN 'axis' THEN 3 ELSE 5 END, place) AS layers FROM o GROUP BY b""")
def header_context(t):
    k = F.col("p_partkey")
    c = t.part.select(F.col("p_size").alias("b"), F.when(k % 3 == 0, "primary").when(k % 3 == 1, "axis").otherwise("sheet").alias("role"), F.col("p_brand").alias("text"), k.alias("place"))
    return labels.header_context(c, "b")


@query("""SELECT l_suppkey AS sheet, greatest(1, min(l_partkey) - 7) AS r1, greatest(1, min(l_linenumber) - 7) AS c1, max(l_partkey) + 7 AS r2, max(l_linenumber) + 7 AS c2 FROM lineitem GROUP BY l_suppkey""")
def evidence_regions(t):
    return labels.regions(t.lineitem.select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col")), "sheet")


@query("""SELECT s_suppkey, list_extract(['form', 'document', 'class', 'class', 'class', 'standard'], CAST(s_suppkey % 6 + 1 AS INT)) AS kind,
list_extract(CASE s_nationkey % 5 WHEN 0 THEN ['legacy_auto::open', 'legacy_auto::open', 'legacy_auto::open', 'legacy_auto::open', 'legacy_auto::open', 'legacy_auto::open'] WHEN 1 THEN ['workbook_or_worksheet::workbook_open', 'workbook::open', 'workbook_or_worksheet::workbook_open', 'workbook_or_worksheet::workbook_open', 'workbook_or_worksheet::workbook_open', 'workbook_or_worksheet::workbook_open']
WHEN 2 THEN ['control:my_button:click', 'control:my_button:click', 'control:my_button:click', 'control:my_button:click', 'control:my_button:click', NULL] WHEN 3 THEN [NULL, 'application::quit', 'application::quit', 'application::quit', 'application::quit', NULL] END, CAST(s_suppkey % 6 + 1 AS INT)) AS event FROM supplier""")
def module_kinds(t):
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    k, n = F.col("s_suppkey") % 6, F.col("s_nationkey") % 5
    source = pick(k, "", "Attribute VB_Base = 0{00020820-0}\nAttribute VB_PredeclaredId = True", "Attribute VB_PredeclaredId = True", "Attribute VB_Exposed = False", "x", None)
    kind = vba.module_kind(pick(k, "Ask.frm", "Sheet1.cls", "A", "B", "C.cls", "Module1"), source)
    e = vba.event_of(pick(n, "Auto_Open", "Workbook_Open", "My_Button_Click", "Application_Quit", "Total"), F.lit("sub"), F.col("kind"))
    return t.supplier.select("s_suppkey", "s_nationkey", kind.alias("kind")).select("s_suppkey", "kind", F.when(e.isNotNull(), F.concat(e["kind"], F.lit(":"), F.coalesce(e["control"], F.lit("")), F.lit(":"), e["event"])).alias("event"))
