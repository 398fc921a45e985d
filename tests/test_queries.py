"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sedimenta.plans import queries as Q

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
        return "-"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    a, b = Q.QUERIES[name](spark, DIR).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(a) == sorted(b)
    rows = [sorted(tuple(plain(v) for v in r) for r in x[sorted(x)].itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]


def test_hexdump_covers_the_whole_text(spark, tmp_path):
    texts = {1: "é漢🙂 " * 40, 2: "x" * 64, 3: "y" * 65, 4: "", 5: None, 6: "a\nb" * 5_000}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in Q.QUERIES["q_hexdump"](spark, str(tmp_path)).select("doc_id", "at", "hex").collect())
    assert got == sorted((i, at, b[at : at + 16].hex().upper()) for i, t in texts.items() for b in [(t or "").encode()] for at in range(0, len(b), 16))


def test_hex_covers_the_whole_text(spark, tmp_path):
    texts = {1: "é漢🙂 " * 40, 2: "x" * 32, 3: "y" * 33, 4: "", 5: None}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.hex, r.same) for r in Q.QUERIES["q_hex_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if t is None else (t.encode().hex().upper(), True) for i, t in texts.items()}


def test_filetime_of_large_keys(spark, tmp_path):
    keys = [None, -1, 0, 1, 149_999, 900_719, 922_337, 922_338, 8_999_999, 9_000_000, 600_000_000, 922_337_206]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = Q.QUERIES["q_filetime"](spark, str(tmp_path))
    assert got.schema["seconds"].dataType.simpleString() == "bigint"
    assert sorted(tuple(map(str, r)) for r in got.select("o_orderkey", "seconds").collect()) == sorted(tuple(map(str, r)) for r in c.execute(Q.ORACLE_SQL["q_filetime"]).fetchall())


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double"


def trimmed(spark, at, rows):
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return sorted(map(str, map(tuple, Q.QUERIES["q_fragment_trim"](spark, str(at)).collect())))


def test_fragment_trim_does_not_depend_on_the_order_of_the_input(spark, tmp_path):
    rows = [(1, 4, 1, 29.0), (1, 5, 1, 34.0), (1, 5, 2, 42.0), (1, 5, 2, 12.0), (1, 6, 1, 36.0)]
    want = sorted(map(str, [(1, 4, 1, 29), (1, 5, 1, 34), (1, 5, 2, 12), (1, 5, 2, 5)]))
    assert trimmed(spark, tmp_path / "a", rows) == want
    assert trimmed(spark, tmp_path / "b", rows[::-1]) == want


def test_fragment_trim_of_halves_and_nulls(spark, tmp_path):
    rows = [(1, 1, 1, 2.5), (1, 2, 1, 3.5), (1, 3, 1, 0.5), (2, None, 1, 70.0), (2, 1, None, 30.0), (2, 1, 5, 40.0), (3, 1, 1, None), (3, 2, 1, 90.0), (3, 3, 1, 1.0), (None, 1, 1, 50.0), (None, 2, 1, 50.0)]
    got = trimmed(spark, tmp_path, rows)
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(map(str, c.execute(Q.ORACLE_SQL["q_fragment_trim"]).fetchall()))
