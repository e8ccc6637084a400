"""Embeddings, vector store and evidence retrieval."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids

DOCUMENT_INSTRUCTION = "Represent this legal clause for retrieval"


class Embedder(Protocol):
    name: str

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic stand-in for a model server: signed hashed words, normalised."""

    def __init__(self, size: int = 64) -> None:
        self.size, self.name = size, f"hashing-{size}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                out[i, h % self.size] += 1 if h >> 63 else -1
        return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)).tolist()


def retried(embedder: Embedder, tries: int = 3, wait: float = 1.0) -> Callable[[list[str]], list[list[float]]]:
    def call(texts: list[str]) -> list[list[float]]:
        for n in range(tries):
            try:
                found = embedder(texts)
                if len(found) != len(texts):
                    raise ValueError("the embedder returned another number of vectors")
                return found
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(wait * 2**n)
        return []

    return call


def embed(rows: DataFrame, embedder: Embedder, text: str = "content", batch: int = 50, instruction: str = DOCUMENT_INSTRUCTION, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with vec, and what is new for the cache (cache_key, model, vec). Equal texts are embedded once, cached ones not at all."""
    keyed = rows.withColumn("_text", F.concat(F.lit(f"{instruction}: "), F.coalesce(text, F.lit("")))).withColumn("cache_key", ids.cache_key(F.lit(embedder.name), F.col("_text")))
    wanted = keyed.select("cache_key", "_text").dropDuplicates(["cache_key"])
    if cache is not None:
        wanted = wanted.join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(embedder)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"cache_key": part["cache_key"], "model": embedder.name, "vec": call(part["_text"].tolist())})

    fresh = wanted.mapInPandas(run, "cache_key string, model string, vec array<float>")
    known = fresh if cache is None else fresh.unionByName(cache.select("cache_key", "model", "vec"))
    return keyed.join(known.select("cache_key", "vec"), "cache_key", "left").drop("_text"), fresh


def store(rows: DataFrame, path: str, collection: str) -> None:
    """One partition a collection; embeddings and metadata as typed columns."""
    rows.withColumn("collection", F.lit(collection)).write.mode("append").partitionBy("collection").parquet(path)


def stale_collections(collections: DataFrame, keep: int = 5) -> DataFrame:
    """All but the newest `keep`, by the number at the end of the name."""
    rank = F.row_number().over(Window.orderBy(F.regexp_extract("collection", r"(\d+)$", 1).cast("bigint").desc()))
    return collections.select("collection").distinct().withColumn("n", rank).where(F.col("n") > keep).drop("n")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length, in double."""
    if column.null_count:
        raise ValueError("a vector is null")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-9)


def least(distance: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's n least distances, then by order, the rank of a column's id."""
    most = min(n, distance.shape[1])
    # all that are as near as the n-th, then by id
    bound = np.partition(distance, most - 1, axis=1)[:, most - 1 : most]
    row, column = np.nonzero(distance <= bound)
    by = np.lexsort((order[column], distance[row, column], row))
    row, column = row[by], column[by]
    few = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[few], column[few]


#: Distances that a task holds at a time, whatever the sizes of its block and chunk.
CELLS = 1 << 21


def _nearest_of(items: pa.Table, queries: pa.Table, n: int) -> pa.Table:
    ids, asked = items.column("item_id").combine_chunks(), queries.column("query_id").combine_chunks()
    points, q = (unit(matrix(t.column("vec").combine_chunks())) for t in (items, queries))
    order, found = pc.rank(ids).to_numpy(), []
    step = max(1, CELLS // len(ids))
    for at in range(0, len(q), step):
        distance = q[at : at + step] @ points.T
        np.round(np.subtract(1, distance, out=distance), 6, out=distance)
        own = pc.index_in(asked.slice(at, step), value_set=ids).fill_null(-1).to_numpy()
        distance[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
        distance[np.isnan(distance)] = np.inf
        row, column = least(distance, order, n)
        value = distance[row, column]
        real = value < np.inf
        found.append((row[real] + at, column[real], value[real]))
    row, column, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": asked.take(pa.array(row)), "item_id": ids.take(pa.array(column)), "distance": value})


def met(items: pa.Table, queries: pa.Table, n: int, by: str | None = None) -> pa.Table:
    """Of a block of items (item_id, vec) and a chunk of queries (query_id, vec): each query's n nearest. With by, only those that share it are compared."""
    kinds = {"query_id": queries.schema.field("query_id").type, "item_id": items.schema.field("item_id").type, "distance": pa.float64()}
    out = [pa.schema(list(kinds.items())).empty_table()]
    both = [(items, queries)]
    if by:
        shared = pc.unique(queries.column(by)).drop_null().to_pylist()
        own = lambda t, v: t.filter(pc.equal(t.column(by), pa.scalar(v, t.schema.field(by).type)))
        both = ((own(items, v), own(queries, v)) for v in shared)
    out += [_nearest_of(x, y, n) for x, y in both if x.num_rows and y.num_rows]
    return pa.concat_tables(out)


def nearest(queries: DataFrame, items: DataFrame, n: int = 5, by: str | None = None, block: int = 20_000, chunk: int = 8_000) -> DataFrame:
    """Exact search by cosine distance. queries: query_id, vec; items: item_id, vec; by: a column that both must share. An item isn't
    its own neighbour. Blocks of items meet chunks of queries in matrix products of CELLS distances each; a block keeps its own n best for a query before the shuffle."""
    columns = [by] if by else []
    blocks, chunks = (max(1, -(-df.count() // size)) for df, size in ((items, block), (queries, chunk)))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = items.select("item_id", "vec", *columns, deal("item_id", blocks).alias("b")).withColumn("q", each(chunks))
    y = queries.select("query_id", "vec", *columns, deal("query_id", chunks).alias("q")).withColumn("b", each(blocks))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return met(left, right, n, by)

    found = x.groupBy("b", "q").cogroup(y.groupBy("b", "q")).applyInArrow(one, "query_id bigint, item_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("similarity", F.round(1 - F.col("distance"), 6))


def hit_metrics(ranks: DataFrame) -> DataFrame:
    """ranks: query_id, rank of the first hit (null without one). hit@1, hit@3 and mean reciprocal rank."""
    within = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6)
    return ranks.agg(F.count(F.lit(1)).alias("queries"), within(1).alias("hit_at_1"), within(3).alias("hit_at_3"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def sanitized(values: pd.Series) -> pd.Series:
    """Open metadata maps (Python objects) to what a store takes: no nulls; lists of one type."""
    import json

    def of_list(items: list) -> list | None:
        kept = [x for x in items if isinstance(x, str | int | float | bool)]
        if not kept:
            return None
        if all(isinstance(x, bool) for x in kept):
            return kept
        if all(isinstance(x, int | float) and not isinstance(x, bool) for x in kept):
            return [float(x) for x in kept] if any(isinstance(x, float) for x in kept) else kept
        return [str(x) for x in kept]

    def of(value: dict) -> dict:
        out = {}
        for k, v in value.items():
            v = of_list(v) if isinstance(v, list) else json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else v
            if v is not None:
                out[k] = v if isinstance(v, str | int | float | bool | list) else str(v)
        return out

    return values.map(of)


def open_collection(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """A stored collection; the newest if none is named."""
    rows = spark.read.parquet(path)
    if collection is None:
        newest = rows.select("collection").distinct().select(F.max_by("collection", F.regexp_extract("collection", r"(\d+)$", 1).cast("bigint"))).first()[0]
        collection = newest
    return rows.where(F.col("collection") == collection)
