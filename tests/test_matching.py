"""Greedy matching in rounds against going through the pairs in order."""

import random

import pytest

from palimpsest.operators import evaluate


def in_order(rows):
    left, right, kept = set(), set(), []
    for case, p, g, s in sorted(rows, key=lambda r: (r[0] or "", -r[3], r[1], r[2])):
        if (case, p) not in left and (case, g) not in right:
            left.add((case, p))
            right.add((case, g))
            kept.append((case, p, g, s))
    return sorted(kept, key=str)


@pytest.mark.parametrize("most", [500_000, 60])
def test_rounds_equal_the_order(spark, most):
    rng = random.Random(1)
    rows = [(f"c{rng.choice([0, 0, 0, 1, 2, 3])}", rng.randrange(30), rng.randrange(25), rng.randrange(12) / 10) for _ in range(900)]
    rows += [("chain", k // 2 + k % 2, k // 2, 1 + k / 1000) for k in range(70)]  # each pair waits for the next one
    rows += [("hot", 7, k, 0.5) for k in range(200)] + [(None, 1, 1, 0.9), (None, 1, 2, 0.9)]
    best = {}
    for case, p, g, s in rows:
        best[case, p, g] = max(s, best.get((case, p, g), 0.0))
    rows = [(*k, s) for k, s in best.items()]
    scores = spark.createDataFrame(rows, "case_name string, pred_ord int, gt_ord int, score double").repartition(5)
    found = [tuple(r) for r in evaluate.greedy_match(scores, 0.3, most).collect()]
    assert sorted(found, key=str) == in_order([r for r in rows if r[3] >= 0.3 and r[0] is not None])


def test_nothing_to_match(spark):
    assert evaluate.greedy_match(spark.createDataFrame([("a", 1, 1, 0.01)], "case_name string, pred_ord int, gt_ord int, score double")).count() == 0
