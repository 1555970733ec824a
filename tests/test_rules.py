"""Text and label rules on small cases whose results are known."""

import pytest
from pyspark.sql import functions as F

from gridlineage import api
from gridlineage.functions import text
from gridlineage.operators import grouping, labels, vba
from gridlineage.sources import xlsx_writer


@pytest.mark.parametrize(
    ("formula", "key"),
    [
        ("=sum( A1:B$2 )  *  Calc!c3", "=SUM( CELLRANGE ) * CELL"),
        ("=SUM(Table1[[#Headers],[Col]],[@Price],'My Sheet'!D:D,$5:$10)", "=SUM(CELLRANGE,CELLRANGE,COLRANGE,ROWRANGE)"),
        ('=IF(A1="say ""A2""",1,"(")', "=IF(CELL=STR,1,STR)"),
        ("=LOG10(A1)", "=CELL(CELL)"),
        ("=A1+B2", None),
        ("MAX('a:b'!A1,\n 2)", "MAX(CELL, 2)"),
        ('="(" & A1', None),
        ("", None),
        (None, None),
    ],
)
def test_family_key(spark, formula, key):
    assert spark.range(1).select(text.canonical_a1(F.lit(formula).cast("string"))).first()[0] == key


def test_arithmetic_of_two_operands(spark):
    cases = {"=A1-1": True, "=-A1": False, "=SUM(-A1,+B1)": False, "=1E-5": False, '="a-b"&A1': False, "='Q-1'!A1": False, "=T[a-b]": False, "=SUM(A1)^2": True, "=x.rate*2": True, "=50%/A1": True, "=A1 - B1": True, "=E1-1E+2": True}
    rows = spark.createDataFrame(list(cases.items()), "f string, want boolean")
    assert rows.where(labels.has_arithmetic(F.col("f")) != F.col("want")).collect() == []


def test_nulls_in_label_rules(spark):
    none = F.lit(None)
    scores = labels.class_scores(none.cast("string"), none.cast("string"), F.lit(False), F.lit(False), F.lit(0), F.lit(0), none.cast("array<struct<number:double,text:string>>"))
    got = spark.range(1).select(*(v.alias(k) for k, v in scores.items())).first()
    assert [round(x, 6) for x in got] == [0.1, 0.1, 0.0, 0.5]
    assert spark.range(1).select(labels.generated_label(F.lit("=A1+B1"), F.array(F.struct(none.cast("string").alias("label"), F.lit(0.9).alias("score"))))).first()[0] is None
    assert spark.range(1).select(labels.sheet_type(none.cast("string"))).first()[0] == "unknown"


def test_time_indices(spark):
    cases = [("2024", 2024), ("3.0", 3), ("3.5", None), ("Year 7 of 9", 7), ("12345 x", None), ("Stress 5", None), ("5%", None), ("", None), (None, None), ("-2", -2)]
    rows = spark.createDataFrame(cases, "t string, want long")
    assert rows.where(~text.time_index(F.col("t")).eqNullSafe(F.col("want"))).collect() == []
    axes = [([1, 2, 3, 4, 5], True), ([1, 2, 3, 4], False), ([1, 2, 3, 4, 6], True), ([1, 2, 4, 6, 8], False), ([1, 2, 3, None, 4, 5], True), ([1, 2, 3, 4, 5, None, None, None], False), ([5, 4, 3, 2, 1], False), ([], False), (None, False)]
    rows = spark.createDataFrame(axes, "i array<long>, want boolean")
    assert rows.where(text.is_time_axis(F.col("i")) != F.col("want")).collect() == []


def test_chunks_of_a_question(spark):
    rows = [(1, "Calc_Rate", ["rate", "x"], ["rate"], 400, "p1"), (2, "Other", ["rate"], [], 400, "p2"), (3, "Third", [], ["rate"], 4000, "p3"), (4, "None", [], None, 1, "p4")]
    chunks = spark.createDataFrame(rows, "id long, name string, identifiers array<string>, comments array<string>, chars long, procedure string").withColumn("g", F.lit(1))
    ranks = lambda q, **k: [(r["id"], round(r["score"], 6)) for r in vba.retrieve(chunks, q, ["g"], "id", **k).orderBy("rank").collect()]
    assert ranks("the rate") == [(1, 1.0), (2, 0.333333), (3, 0.166667)]
    assert ranks("rate", budget=100) == [(1, 1.0)] and ranks("rate", budget=200) == [(1, 1.0), (2, 0.666667)] and ranks("rate", budget=1) == [(1, 1.0)]
    assert ranks("of a") == []


def test_bindings_that_are_no_variables(spark):
    cells = spark.createDataFrame(
        [(1, None, True, False), (1, "", True, False), (2, "-", True, False), (2, " TBC", True, False), (3, "-", True, False), (4, "1. Inputs", True, False), (4, "Rate", True, False), (5, "1. Inputs", True, False), (5, "7", False, False), (6, "-", True, False), (6, "n/a", True, False), (7, " ", True, False), (7, None, True, False), (8, None, True, True)],
        "id long, value string, is_text boolean, has_formula boolean",
    )
    got = {r["id"]: r["reason"] for r in grouping.noise(cells, spark.createDataFrame([(6,), (6,)], "id long")).collect()}
    assert got == {1: "empty", 2: "placeholder", 4: "section_header"}
    assert grouping.noise(cells.limit(0), cells.select("id").limit(0)).count() == 0


def test_extract_leaves_out_placeholders_and_headers_that_nothing_reads(spark, tmp_path):
    sheet = {(1, 1): "1. Inputs", (2, 1): "Rates", (1, 3): "-", (2, 3): "TBC", (1, 5): "n/a", (2, 5): "-", (1, 7): "=E1&E2", (5, 1): "Mortality rate", (5, 2): 0.2, (5, 4): "=B5*2"}
    xlsx_writer.write(str(tmp_path / "a.xlsx"), {"Assumptions": sheet})
    x = api.extract(spark, f"file://{tmp_path}")
    kept = {r["binding_id"]: r["address_a1"] for r in x.bindings.collect()}
    assert set(kept.values()) == {"E1:E2", "G1", "A5:B5", "D5"}
    assert {r["binding"] for r in x.members.collect()} == set(kept)
    d = {r["address_a1"]: r for r in api.document(x).collect()}
    assert d["D5"]["reconciliation"]["required"] and d["D5"]["reconciliation"]["rationale"] in ("Contains mathematical calculations", "Key model output requiring verification")
    assert next(r for a, r in d.items() if a.endswith("B5"))["class"] == "Assumption"
