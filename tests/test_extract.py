"""Workbooks end to end: reading, grouping, collapsed edges, documents, comparison, streams."""

import pytest
from pyspark.sql import functions as F

from gridlineage import api
from gridlineage.functions.formula import column_letters
from gridlineage.sources import xlsx, xlsx_writer


# The collapsed edges that overlapping windows must give (from, to, cells, kind), and the last rows of C by rule.
WINDOWS = """
B1:B80 A1:A119 119 range_static
C1:C71 A1:A119 90 range_static
C1:C71 B1:B80 80 range_static
C80 B1:B80 1 formula
"""


def window(letter, first, rows, last=10**6):
    return f"SUM({letter}{first}:{letter}{min(first + rows - 1, last)})"


def rolling():
    """Numbers in A, windows of 40 over them in B, windows of 20 over A and of 10 over B, cut at its end, in C."""
    sheet = dict.fromkeys([(r, 1) for r in range(1, 121)], 0)
    for r, _ in list(sheet):
        sheet[r, 1] = r
        if r <= 80:
            sheet[r, 2] = "=" + window("A", r, 40)
            sheet[r, 3] = "=" + window("A", r, 20) + "+" + window("B", r, 10, 80)
    return sheet


@pytest.fixture(scope="module")
def extracted(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    xlsx_writer.write(str(path / "rolling.xlsx"), {"Forecast": rolling()})
    return api.extract(spark, f"file://{path}")


def test_rolling_windows_collapse(extracted):
    name = extracted.bindings.select("binding_id", "address_a1")
    ends = extracted.binding_edges.join(name.toDF("from_binding", "from"), "from_binding").join(name.toDF("to_binding", "to"), "to_binding")
    lines = {f"{r['from']} {r['to']} {r['edge_count']} {r['kind']}" for r in ends.collect()}
    tail = [f"C{r} A1:A119 20 range_static" for r in range(72, 81)] + [f"C{r} B1:B80 {80 - r + 1} range_static" for r in range(72, 80)]
    assert lines == {*WINDOWS.strip().splitlines(), *tail}


def test_names_tables_and_sheet_spans_give_edges(spark, tmp_path):
    data = {(1, 1): "Id", (1, 2): "Rate", (2, 1): 1, (2, 2): 10, (3, 1): 2, (3, 2): 20, (9, 1): 5}
    calc = {(1, 1): "=SUM(Rates)", (2, 1): "=local+1", (3, 1): "=SUM(Tbl[Rate])", (4, 1): "=Nowhere*2", (5, 1): "=SUM(Data:Calc!Z1:Z2)", (6, 1): "=A1+(", (7, 1): "=Tbl[[#All],[Id]]", (8, 1): "=Missing[x]", (9, 1): "=SUM(local)"}
    sheets = {"Data": data, "Mid": {(2, 1): "=Tbl[@Rate]"}, "Calc": calc}
    xlsx_writer.write(str(tmp_path / "a.xlsx"), sheets, names={"Rates": "Data!$B$2:$B$3,Data!$A$9", "local": "Data!$A$1"}, local_names=[("Local", 3, "Data!$A$9")], chart_first=True, tables={"Data": [("Tbl", "A1:B3", ["Id", "Rate"])]})
    x = api.extract(spark, f"file://{tmp_path}")
    at = x.cells.select(F.col("cell").alias("from_cell"), F.concat_ws("!", "sheet_name", "a1").alias("at"))
    got = {}
    for r in x.edges.join(at, "from_cell").collect():
        got.setdefault(r["at"], set()).add((r["kind"], r["target"], r["to_sheet_id"], r["r1"], r["c1"], r["r2"], r["c2"]))
    none = (None, 0, 0, 0, 0)
    assert got == {
        "Calc!A1": {("range", "Data", 1, 2, 2, 3, 2), ("cell", "Data", 1, 9, 1, 9, 1)},
        "Calc!A2": {("cell", "Data", 1, 9, 1, 9, 1)},  # the name of the sheet comes before that of the workbook
        "Calc!A9": {("cell", "Data", 1, 9, 1, 9, 1)},
        "Calc!A3": {("range", "Data", 1, 2, 2, 3, 2)},
        "Calc!A4": {("external", "UNRESOLVED:Nowhere", *none)},
        "Calc!A5": {("range", "Data:Calc", k, 1, 26, 2, 26) for k in (1, 2, 3)},
        "Calc!A6": {("unparsed", "UNPARSED", *none)},
        "Calc!A7": {("range", "Data", 1, 1, 1, 3, 1)},
        "Calc!A8": {("external", "UNRESOLVED:Missing[x]", *none)},
        "Mid!A2": {("cell", "Data", 1, 2, 2, 2, 2)},
    }


def test_corpora_of_two_workbooks_are_matched_by_place(spark, tmp_path):
    for version, v in (("one", 1), ("two", 2)):
        for book in ("a", "sub/b"):
            path = tmp_path / version / f"{book}.xlsx"
            path.parent.mkdir(parents=True, exist_ok=True)
            xlsx_writer.write(str(path), {"Same": {(1, 1): v if book == "a" else 7, (2, 1): "=A1*2" if v == 1 or book == "a" else "=SUM(A1:A1)+B9"}})
    one, two = (api.extract(spark, f"file://{tmp_path}/{v}") for v in ("one", "two"))
    assert {r["workbook"] for r in one.sheets.collect()} == {"a.xlsx", "sub/b.xlsx"}
    assert api.diff(one, one).count() == 0
    got = {(r["workbook"], r["type"], r["key"]) for r in api.diff(one, two).collect()}
    assert {("a.xlsx", "CELL_CHANGED", "Same!A1"), ("sub/b.xlsx", "CELL_CHANGED", "Same!A2")} == {g for g in got if g[1].startswith("CELL")}


def test_documents_and_self_diff(spark, extracted, tmp_path):
    d = api.document(extracted)
    assert d.count() == extracted.bindings.count() and api.markdown(d).count() == 1
    assert api.diff(extracted, extracted).count() == 0
    extracted.write(str(tmp_path / "x"))
    api.register_views(api.Extract.load(spark, str(tmp_path / "x")))
    assert spark.sql("SELECT count(*) FROM agent_binding_dependencies WHERE to_address = 'B1:B80'").first()[0] == 10


def test_changes_between_versions(spark, extracted, tmp_path):
    cells = rolling()
    cells[(5, 1)] = 99
    cells[(3, 2)] = "=SUM(A3:A50)"
    del cells[(120, 1)]
    (tmp_path / "b").mkdir()
    xlsx_writer.write(str(tmp_path / "b" / "rolling.xlsx"), {"Forecast": cells, "New": {(1, 1): "x"}})
    got = {(r["type"], r["key"]) for r in api.diff(extracted, api.extract(spark, f"file://{tmp_path}/b")).collect()}
    assert {("CELL_CHANGED", "Forecast!A5"), ("CELL_CHANGED", "Forecast!B3"), ("CELL_REMOVED", "Forecast!A120"), ("CELL_ADDED", "New!A1"), ("SHEET_ADDED", "New")} <= got
    assert not any(k == "Forecast!A6" for _, k in got)


def test_source_parts(spark, tmp_path):
    sheets = {"Data": {(1, 1): "Name & <x>", (2, 1): 1.5, (2, 2): True, (3, 1): "='My Calc'!B2*2"}, "My Calc": {(2, 2): 7}}
    xlsx_writer.write(str(tmp_path / "a.xlsx"), sheets, names={"Rate": "'My Calc'!$B$2,Data!$A$1", "Dyn": "OFFSET(Data!$A$1,1,0)"}, values={("Data", 3, 1): 14}, validations={"Data": [("A1:A9", '"Yes, No"')]})
    xlsx.register(spark)
    for cells in (xlsx.read(spark, f"file://{tmp_path}"), spark.read.format("xlsx").option("part", "cells").load(str(tmp_path))):
        got = {(r["sheet_id"], r["a1"], r["formula_a1"], r["value"], r["data_type"]) for r in cells.collect()}
        assert got == {(1, "A1", None, "Name & <x>", "inlineStr"), (1, "A2", None, "1.5", "n"), (1, "B2", None, "1", "b"), (1, "A3", "='My Calc'!B2*2", "14", "n"), (2, "B2", None, "7", "n")}
    names = {r["name"]: (r["destinations"], r["is_dynamic"]) for r in xlsx.read(spark, f"file://{tmp_path}", "names").collect()}
    assert names["Rate"] == (["'My Calc'!$B$2", "Data!$A$1"], False) and names["Dyn"][1]
    assert xlsx.read(spark, f"file://{tmp_path}", "validations").first()["choices"] == ["Yes", "No"]
    assert [r["sheet_name"] for r in xlsx.read(spark, f"file://{tmp_path}", "sheets").orderBy("sheet_id").collect()] == ["Data", "My Calc"]


def test_serial_dates(spark):
    got = spark.range(1).select(xlsx.serial_date(F.lit(45292.5)).alias("d"), xlsx.serial_date(F.lit(0), True).alias("e")).first()
    assert str(got["d"]) == "2024-01-01" and str(got["e"]) == "1904-01-01"


def test_arriving_workbooks(spark, tmp_path):
    from gridlineage.streaming import versions

    (tmp_path / "in").mkdir()
    xlsx_writer.write(str(tmp_path / "in" / "a.xlsx"), {"S": {(1, k): k for k in range(1, 4)}})
    seen = []
    versions.run_each(versions.arriving(spark, str(tmp_path / "in")), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r["a1"] for r in seen) == [f"{column_letters(k)}1" for k in range(1, 4)]


def test_stream_changes(spark, tmp_path):
    from gridlineage.streaming import versions

    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", "2024-01-01 00:00:00", "1"), ("a", "2024-01-01 00:10:00", "1"), ("a", "2024-01-01 00:20:00", "2"), ("b", "2024-01-01 00:00:00", "x")]
    spark.createDataFrame(rows, "key string, at string, v string").selectExpr("key", "cast(at AS timestamp) AS at", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp, v string").parquet(str(tmp_path / "in"))
    seen = []
    versions.run_each(versions.changes(stream), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r["key"], r["old"] or "", r["new"]) for r in seen) == [("a", "", "1"), ("a", "1", "2"), ("b", "", "x")]
