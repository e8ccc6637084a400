"""Queries without SQL over whole tables, against brute force."""

import pyarrow.parquet as pq

from palimpsest.plans.queries import QUERIES
from tests.oracle import SF


def test_greedy_match_covers_every_customer(spark):
    read = lambda t, *columns: pq.read_table(f"{SF}/{t}.parquet", columns=list(columns)).to_pylist()
    customer = {r["o_orderkey"]: r["o_custkey"] for r in read("orders", "o_orderkey", "o_custkey")}
    cells = {}
    for r in read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity"):
        if r["l_orderkey"] in customer:
            key = (customer[r["l_orderkey"]], r["l_partkey"], r["l_suppkey"])
            cells[key] = max(cells.get(key, 0.0), float(r["l_quantity"]) / 50)
    expected, left, right = set(), set(), set()
    for (case, p, g), score in sorted(cells.items(), key=lambda x: (-x[1], x[0])):
        if (case, p) not in left and (case, g) not in right:
            left.add((case, p))
            right.add((case, g))
            expected.add((case, p, g, score))
    found = [tuple(r) for r in QUERIES["greedy_match"](spark, SF).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert len(expected) < len(cells)
    assert {x[0] for x in found} == {x[0] for x in cells}
