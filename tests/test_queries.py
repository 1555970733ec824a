"""Every query against its SQL on the smallest tables; the engine without its optional parts."""

import math
import os

import duckdb
import pytest

from gridlineage.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    sql = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(got.columns)
    cols = sorted(got.columns)
    left = sorted("|".join(plain(r[c]) for c in cols) for r in got.collect())
    right = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in sql.fetchall())
    assert left == right


@pytest.mark.parametrize("name", ["formula_edges", "formula_r1c1", "shared_formula_shift"])
def test_formulas_of_rows_beyond_a_workbook(spark, tmp_path, name):
    folder = str(tmp_path)
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, k // 10 AS o_custkey FROM (SELECT unnest(range(1048560, 1048590)) AS k UNION ALL SELECT unnest(range(9000000, 9000012)) UNION ALL SELECT unnest(range(54000000, 54000012)))")
    con.execute(f"COPY orders TO '{folder}/orders.parquet'")
    sql = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    got = catalog.queries()[name](spark, folder).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sql.fetchall()))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_needs_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(catalog.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "gridlineage.llm" not in text.read()
