"""Product codes against brute force, and what the pruning leaves out."""

import hashlib
import math
import random

import numpy as np
import pytest

from palimpsest.llm import product_codes
from palimpsest.llm.queries import QUERIES
from tests.oracle import SF


def brute(rows, parts, entries, rounds, scale=4096):
    """rows: (id, vector). Codes and error by id, and the codebooks, with Python's integers."""
    kept = sorted((i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    cuts = {i: [v[k * w : (k + 1) * w] for k in range(parts)] for i, v in kept}
    books = [[cuts[i][k] for i, _ in kept[:entries]] for k in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (square(x, book[e]), e))
    for _ in range(rounds):
        for k, book in enumerate(books):
            members = {}
            for i, _ in kept:
                members.setdefault(near(cuts[i][k], book), []).append(cuts[i][k])
            books[k] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else old for e, old in enumerate(book)]
    codes = {i: [near(cuts[i][k], books[k]) for k in range(parts)] for i, _ in kept}
    return codes, {i: sum(square(cuts[i][k], books[k][codes[i][k]]) for k in range(parts)) for i, _ in kept}, books


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 3]) for _ in range(12)], rng.choice([None, 1, 2])) for i in rng.sample(range(1000), 150)]
    rows += [(2000 + k, list(rows[k % 3][1]), 1) for k in range(40)]  # equal vectors, one of them hot
    rows += [(3000, None, 1), (3001, [1.0] * 11 + [None], 1), (3002, [float("nan")] * 12, 1), (3003, [float("inf")] * 12, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    given = product_codes.vectors(df)
    books = product_codes.fit(given, parts=4, entries=5, rounds=3)
    codes, error, expected = brute([(i, v) for i, v, _ in rows], 4, 5, 3)
    assert [b.tolist() for b in books.entries] == expected
    assert books.sha256() == hashlib.sha256(",".join(str(c) for b in expected for e in b for c in e).encode()).hexdigest()
    found = product_codes.with_group_error(product_codes.encode(given, books)).collect()
    label = {i: x for i, _, x in rows}
    assert {r.vec_id for r in found} == codes.keys()
    for r in found:
        assert (r.codes, r.error) == (codes[r.vec_id], error[r.vec_id])
        assert r.label_error == sum(e for i, e in error.items() if label[i] == r.label)


def test_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label string, codes string, own string, packed string, id string"
    more = ["c", "o", "p", "i"]
    rows = [(5, [1.0, 2.0, 3.0], "a", *more), (5, [1.0, 2.0, 3.0], "a", *more), (7, [1.0], None, *more), (None, [0.5, 0.5, 0.5], None, *more), (8, [], "a", *more), (9, [3e38, -3e38, 0.0], "b", *more)]
    given = product_codes.vectors(spark.createDataFrame(rows, schema))
    found = product_codes.with_group_error(product_codes.encode(given, product_codes.fit(given, rounds=2))).collect()
    assert len(found) == 6 and all((r.own, r.packed, r.id) == ("o", "p", "i") for r in found)
    by_id = {r.vec_id: r for r in found}
    assert by_id[7].codes is None and by_id[7].error is None and by_id[8].codes is None and len(by_id[5].codes) == len(by_id[None].codes) == 8
    empty = product_codes.vectors(spark.createDataFrame([], schema))
    assert product_codes.fit(empty) is None and product_codes.encode(empty, None).count() == 0


@pytest.mark.parametrize("spread", [1, 300])
def test_annulus_finds_the_nearest_and_evaluates_fewer(spread):
    rng = np.random.default_rng(2)
    entries = rng.integers(-900, 900, (16, 4)) * np.linspace(1, spread, 16, dtype=np.int64)[:, None]
    entries[7] = entries[3]  # a tie goes to the lower number
    near = entries[rng.integers(0, 16, 500)] + rng.integers(-100, 100, (500, 4))
    book, x = product_codes.Book(entries), np.r_[near, rng.integers(-900 * spread, 900 * spread, (50, 4)), entries]
    number, distance = book.nearest(x)
    every = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert book.evaluated < every.size * (0.4 if spread > 1 else 0.9)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    codes, error, books = brute(rows, 8, 16, 6)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = QUERIES["op12_product_codes"](spark, SF).collect()
    assert {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in found} == {i: ("".join(f"{c:02x}" for c in codes[i]), error[i], digest) for i in codes}
