"""The vector index: recall and the exact mode against all rows, hot cells, odd vectors, an index kept and read again."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.operators import retrieval, vector_index
from palimpsest.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _rows(rng, n, d, near):
    return [(i, [float(x) for x in near[i % len(near)] + 0.4 * rng.normal(size=d)]) for i in range(n)]


def test_recall_over_a_whole_table(spark):
    x = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding AS vec")
    truth = retrieval.nearest(x.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), x.withColumnRenamed("vec_id", "item_id"), 5)
    found = vector_index.recall(QUERIES["vector_index_topk"](spark, SF), truth).first()
    assert found.queries == 25 and found.recall >= 0.9


@pytest.mark.parametrize("small", [False, True])
def test_exact_mode_equals_all_rows(spark, monkeypatch, small):
    """Also with blocks and chunks of a few rows, a third of all rows in one cell, and many equal vectors."""
    if small:
        monkeypatch.setattr(vector_index, "BLOCK", 40)
        monkeypatch.setattr(vector_index, "CHUNK", 7)
        monkeypatch.setattr(vector_index, "MOST_BROADCAST", 10)
    rng = np.random.default_rng(1)
    rows = _rows(rng, 400, 8, rng.normal(size=(12, 8)))
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    items = spark.createDataFrame(rows, "item_id bigint, vec array<double>").repartition(5)
    queries = items.where("item_id % 9 = 0").withColumnRenamed("item_id", "query_id")
    index = vector_index.build(items, cells=10, parts=4, entries=16)
    order = lambda df: sorted((r.query_id, r.distance, r.item_id) for r in df.collect())
    truth = retrieval.nearest(queries, items, 4)
    assert order(vector_index.search(index, queries, 4, probes=1, exact=True)) == order(truth)
    found = vector_index.search(index, queries, 4, probes=3, candidates=40)
    assert vector_index.recall(found, truth).first().recall >= 0.9
    assert vector_index.recall(vector_index.search(index, queries, 4, probes=10, candidates=600), truth).first().recall == 1.0


def test_kept_index_and_odd_vectors(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"i{k}", [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [("null", None), ("hole", [1.0, None, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 5), ("zero", [0.0] * 5), ("empty", [])]
    items = spark.createDataFrame(rows, "item_id string, vec array<float>")
    path = f"file://{tmp_path}/index"
    vector_index.build(items, path)
    index = vector_index.load(spark, path)
    assert index.entries.count() == 61
    queries = items.withColumnRenamed("item_id", "query_id")
    found = vector_index.search(index, queries, 3, exact=True).collect()
    assert {r.query_id for r in found} == {f"i{k}" for k in range(60)} | {"zero"} and all(r.query_id != r.item_id for r in found)
    assert all(r.distance == 1.0 for r in found if r.query_id == "zero")
    unit = {k: np.array(v, dtype=np.float32).astype(float) for k, v in rows[:60]}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()} | {"zero": np.zeros(5)}
    for r in found:
        nearest = sorted((round(1 - float(unit[r.query_id] @ v), 6), k) for k, v in unit.items() if k != r.query_id)[r["rank"] - 1]
        assert abs(nearest[0] - r.distance) <= 2e-6
    empty = vector_index.build(items.limit(0), f"file://{tmp_path}/empty")
    assert vector_index.search(empty, queries).count() == 0 and vector_index.load(spark, f"file://{tmp_path}/empty").model is None


@pytest.mark.parametrize("by", [None, "label"])
def test_nearest_holds_few_distances_at_a_time(by):
    """A block of items and a chunk of queries of full size: 640 MB of distances if they are all held."""
    rng = np.random.default_rng(3)
    vec = pa.array(list(rng.normal(size=(20_000, 8)).astype(np.float32)), pa.list_(pa.float32()))
    items = pa.table({"item_id": np.arange(20_000), "vec": vec, "label": pa.array([None if i % 5 == 0 else i % 3 for i in range(20_000)], pa.int32())})
    queries = items.slice(0, 4_000).rename_columns(["query_id", "vec", "label"])
    tracemalloc.start()
    found = retrieval.met(items, queries, 3, by)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert found.num_rows == 3 * (4_000 - 800 if by else 4_000)
    x = retrieval.unit(np.stack(vec.to_numpy(zero_copy_only=False)).astype(np.float64))
    label = items.column("label").to_pylist()
    for q in (1, 999, 3_999):
        own = [i for i in range(20_000) if i != q and (not by or label[i] is not None and label[i] == label[q])] if not by or label[q] is not None else []
        expected = sorted((round(1 - float(x[q] @ x[i]), 6), i) for i in own)[:3]
        assert [(r["distance"], r["item_id"]) for r in found.to_pylist() if r["query_id"] == q] == expected


def test_nearest_with_undefined_distances(spark):
    """A vector that isn't a number is nobody's neighbour, and the others keep theirs, though they are fewer than n."""
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [float("nan"), 1.0]), (3, [0.0, 1.0])], "item_id bigint, vec array<float>")
    found = retrieval.nearest(items.withColumnRenamed("item_id", "query_id"), items, 3).collect()
    assert sorted((r.query_id, r.item_id) for r in found) == [(0, 1), (0, 3), (1, 0), (1, 3), (3, 0), (3, 1)]
