"""Compares a query with its SQL in DuckDB, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if x is None or isinstance(x, float) and x != x:
        return "-"
    return f"{x:.5f}" if isinstance(x, float) else str(list(map(_value, x))) if isinstance(x, list | tuple) else str(x)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    return [tuple(names), *sorted(tuple(_value(r[n]) for n in names) for r in table.to_pylist())]


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    expected = rows(connection(sf_dir).sql(sql).to_arrow_table())
    found = rows(query(spark, sf_dir).toArrow())
    assert found[0] == expected[0]
    assert len(found) == len(expected)
    assert found == expected
