"""Small tables for the tests of the training-data operators."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, shard int, slot long, h long, n long, row long, `key` string, _t string, _size long, _at long"
ROWS = [
    (1, "Alpha beta", "a"),
    (1, "Alpha beta", "a"),
    (2, None, None),
    (None, "x y z", "a"),
    (3, "", "b"),
    (4, "word " * 60_000, "b"),
    (5, "Alpha BETA", "a"),
    (None, None, None),
    ((1 << 60) + 1, "a large id 12", "a"),
]


def awkward(spark, rows=ROWS):
    """Nulls, empty and long texts, repeated rows, large ids, and columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, 3, 4, 5, 6, 7, "k", "z", 8, 9) for i, t, s in rows], SCHEMA)


def oracle(sql, sf=SF, **tables):
    """Rows of DuckDB SQL over the test tables; others by path."""
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        path = tables.get(name, f"{sf}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def same(df, sql, sf=SF, **tables):
    """Whether Spark's rows and the SQL's are the same."""
    names, expected = oracle(sql, sf, **tables)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    close = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(close, got), key=repr) == sorted(map(close, expected), key=repr)
