"""An inverted-file index over embeddings: cells by k-means, product-quantised codes, exact re-ranking, and an exact search by bounds on cells.

Vectors are compared by cosine distance, as `retrieval.nearest` does; inside, unit vectors by squared Euclidean distance, which orders alike.

Building: centroids and the codebooks of what is left after them (the residual, in `parts` parts of `entries` each) are fitted on about `sample` rows, those with the smallest hash
of item_id, by rounds of k-means that leave sums by entry; every row is then indexed: its cell, its code, and its vector beside them. Sums are of scaled integers, so an
index doesn't depend on the order of rows.

How many cells a query asks is measured when the index is built: for some rows the nearest ones are searched in all cells, and the number is what finds the share RECALL of them.

Searching: a query meets the codes of its `probes` nearest cells; the `candidates` nearest by code are compared exactly. A cell with many items is dealt into blocks, and its
queries into chunks, so a cell that holds a third of all rows is many tasks. In exact mode the approximate answer bounds the distance of the n-th neighbour, and every cell
that could hold a nearer item, by its centroid's distance and its radius, is compared exactly.

Cases: items without a vector, or with a null or non-finite component, are not indexed. A zero vector has distance 1 to all. An item isn't its own neighbour (by id). Equal distances go to the
smaller id. An empty table gives an index without cells, whose answers are empty.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.tables import cut
from palimpsest.operators.align import cosine
from palimpsest.operators.retrieval import CELLS, least, matrix, unit

SAMPLE, ROUNDS, PARTS, ENTRIES, MOST_CELLS = 100_000, 6, 16, 256, 65_536
BLOCK, CHUNK, CANDIDATES = 20_000, 4_000, 150
#: The probes of an index are those that find this share of PROBED rows' NEIGHBOURS nearest ones.
RECALL, PROBED, NEIGHBOURS = 0.97, 200, 5
#: Candidates whose ids are broadcast; more of them meet the vectors in a shuffled join.
MOST_BROADCAST = 500_000
SCALE = float(1 << 20)


def _usable() -> Column:
    return F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Of each row the nearest entry, the first among equals."""
    step = max(1, (1 << 22) // max(1, len(entries)))
    squares = (entries * entries).sum(axis=1)
    return np.concatenate([(squares - 2 * (x[at : at + step] @ entries.T)).argmin(axis=1) for at in range(0, len(x), step)] or [np.zeros(0, dtype=np.int64)])


@dataclass
class Model:
    """cells: centroids; books: for each part of the residual its entries; bounds: where parts begin, and the dimension; probes: cells that a query asks."""

    bounds: list[int]
    cells: np.ndarray
    books: list[np.ndarray] = field(default_factory=list)
    probes: int = 0

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        return cell, x - self.cells[cell]

    def codes(self, residual: np.ndarray) -> np.ndarray:
        parts = zip(self.books, self.bounds[:-1], self.bounds[1:], strict=True)
        return np.stack([_nearest(residual[:, a:b], book) for book, a, b in parts], axis=1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.cells[cell] + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)


@dataclass
class VectorIndex:
    """entries: cell, deal (spreads a cell's items), item_id, code, vec. cells: cell, items, radius."""

    model: Model | None
    entries: DataFrame
    cells: DataFrame


def _fitted(rows: DataFrame, given: Model | None, books: list[np.ndarray], bounds: list[int], rounds: int) -> list[np.ndarray]:
    """k-means of each part at once. rows: vec; given: the model whose residuals are meant, or none for the vectors themselves."""
    wide, most = max(np.diff(bounds)) + 1, max(map(len, books))
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(books), most, wide), dtype=np.int64)
            for batch in batches:
                x = unit(matrix(batch.column("vec")))
                if len(x):
                    x = given.residuals(x)[1] if given else x
                    for k, book in enumerate(books):
                        part = x[:, bounds[k] : bounds[k + 1]]
                        entry = _nearest(part, book)
                        np.add.at(total[k, :, : part.shape[1]], entry, np.rint(part * SCALE).astype(np.int64))
                        total[k, :, -1] += np.bincount(entry, minlength=most)
            slots = np.flatnonzero(np.repeat(total[:, :, -1:] > 0, wide, axis=2))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.reshape(-1)[slots])], names=["slot", "value"])

        found = rows.mapInArrow(sums, "slot bigint, value bigint").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(len(books) * most * wide)
        total[found.column("slot").to_numpy()] = found.column("value").to_numpy()
        total = total.reshape(len(books), most, wide)
        moved = []
        for k, book in enumerate(books):
            counts = total[k, : len(book), -1:]
            mean = total[k, : len(book), : book.shape[1]] / (np.maximum(counts, 1) * SCALE)
            moved.append(np.where(counts > 0, mean, book))
        books = moved
    return books


def build(items: DataFrame, path: str | None = None, cells: int | None = None, parts: int = PARTS, entries: int = ENTRIES, sample: int = SAMPLE, rounds: int = ROUNDS) -> VectorIndex:
    """items: item_id, vec. path: where the index is kept, for `load`; without one it is written as a passing table. cells: the square root of the rows if not given."""
    spark = items.sparkSession
    rows = items.where(_usable()).select("item_id", "vec")
    n = rows.count()
    keep = lambda df, name: _kept(df, f"{path}/{name}" if path else None)
    kind = items.schema["item_id"].dataType.simpleString()
    vec_kind = items.schema["vec"].dataType.simpleString()
    if not n:
        empty = [spark.createDataFrame([], s) for s in (f"cell int, deal bigint, item_id {kind}, code binary, vec {vec_kind}", "cell int, items bigint, radius double")]
        return _saved(spark, VectorIndex(None, keep(empty[0], "entries"), keep(empty[1], "cells")), path)
    share = F.lit(min(1.0, sample / n) * float(1 << 30))
    drawn = cut(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) <= share).select("item_id", "vec"))
    cells = max(1, min(MOST_CELLS, cells or math.isqrt(n)))
    begin = drawn.orderBy(F.xxhash64("item_id", F.lit("start")), "item_id").limit(max(cells, entries)).select("vec").toArrow().column("vec").combine_chunks()
    begin = unit(matrix(begin))
    d = begin.shape[1]
    bounds = [k * d // min(parts, d) for k in range(min(parts, d) + 1)]
    model = Model(bounds, _fitted(drawn.select("vec"), None, [begin[:cells].copy()], [0, d], rounds)[0])
    left = model.residuals(begin[:entries])[1]
    model.books = [left[:, a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    model.books = _fitted(drawn.select("vec"), model, model.books, bounds, rounds)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = unit(matrix(batch.column("vec")))
            if not len(x):
                continue
            cell, residual = model.residuals(x)
            codes = model.codes(residual)
            deal = np.arange(at, at + len(x))
            at += len(x)
            far = np.sqrt((residual * residual).sum(axis=1))
            columns = [pa.array(cell.astype(np.int32)), pa.array(deal), batch.column("item_id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vec"), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "deal", "item_id", "code", "vec", "far"])

    made = rows.mapInArrow(indexed, f"cell int, deal bigint, item_id {kind}, code binary, vec {vec_kind}, far double")
    # files by cell: a search reads the row groups of the cells it asks for
    written = keep(made.repartitionByRange("cell", "deal").sortWithinPartitions("cell"), "entries")
    held = keep(written.groupBy("cell").agg(F.count(F.lit(1)).alias("items"), F.max("far").alias("radius")), "cells")
    index = VectorIndex(model, written.drop("far"), held)
    model.probes = _probes(index, cut(drawn.orderBy(F.xxhash64("item_id", F.lit("probe")), "item_id").limit(PROBED)))
    return _saved(spark, index, path)


def _probes(index: VectorIndex, rows: DataFrame) -> int:
    """The least number of cells in which the share RECALL of the rows' nearest ones lies."""
    queries = rows.select(F.col("item_id").alias("query_id"), "vec")
    truth = _first(_met(_asked(queries.withColumn("within", F.lit(4.0)), index, None), index, NEIGHBOURS, True), NEIGHBOURS)
    cells = index.entries.select("item_id", "cell").join(F.broadcast(truth.select("query_id", "item_id")), "item_id")
    # at most PROBED x NEIGHBOURS rows
    found = cells.join(F.broadcast(queries), "query_id").select("cell", "vec").toArrow()
    if not found.num_rows:
        return len(index.model.cells)
    centroids, own = index.model.cells, found.column("cell").to_numpy()
    square = (centroids * centroids).sum(axis=1) - 2 * unit(matrix(found.column("vec").combine_chunks())) @ centroids.T
    nearer = (square < square[np.arange(len(own)), own][:, None]).sum(axis=1)
    return int(np.quantile(nearer, RECALL, method="higher")) + 1


def _kept(df: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        return cut(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _saved(spark: SparkSession, index: VectorIndex, path: str | None) -> VectorIndex:
    if path is not None:
        m = index.model
        row = [(pickle.dumps(None if m is None else (m.bounds, m.cells, m.books, m.probes)),)]
        spark.createDataFrame(row, "model binary").coalesce(1).write.parquet(f"{path}/model")
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that build has kept at path, which must be one's own: its model is a pickle."""
    model = pickle.loads(spark.read.parquet(f"{path}/model").first().model)
    return VectorIndex(model and Model(*model), spark.read.parquet(f"{path}/entries").drop("far"), spark.read.parquet(f"{path}/cells"))


def _asked(queries: DataFrame, index: VectorIndex, probes: int | None) -> DataFrame:
    """For each query its nearest cells, or with `within` all that may hold something as near: query_id, vec, cell."""
    model = index.model
    within = "within" in queries.columns
    # cells x dimension numbers, with a bound by parameter
    radius = np.full(len(model.cells), -np.inf)
    for r in index.cells.select("cell", "radius").collect():
        radius[r.cell] = r.radius
    most = probes or model.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = unit(matrix(batch.column("vec")))
                square = np.maximum(1 + (model.cells * model.cells).sum(axis=1) - 2 * x @ model.cells.T, 0)
                square[:, radius < 0] = np.inf
                if within:
                    # |q - x|^2 = 2 * distance; a little more, as distances are rounded
                    reach = np.sqrt(2 * np.maximum(batch.column("within").to_numpy(), 0) + 1e-5)
                    row, cell = np.nonzero(np.sqrt(square) - radius <= reach[:, None])
                else:
                    n = min(most, int((radius >= 0).sum()))
                    cell = np.argpartition(square, n - 1, axis=1)[:, :n].reshape(-1)
                    row = np.repeat(np.arange(len(x)), n)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("vec").take(take), pa.array(cell.astype(np.int32))], names=["query_id", "vec", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.mapInArrow(run, f"query_id {kinds['query_id']}, vec {kinds['vec']}, cell int")


def _met(asked: DataFrame, index: VectorIndex, n: int, exact: bool) -> DataFrame:
    """The n nearest items of each query in each block of a cell: query_id, item_id, distance; by code, or exactly."""
    model = index.model
    asked = cut(asked)
    chunks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    plan = index.cells.join(chunks, "cell").select("cell", "chunks", F.ceil(F.col("items") / BLOCK).cast("int").alias("blocks"))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    plan = F.broadcast(plan)  # a row for each cell
    what = "vec" if exact else "code"
    x = index.entries.select("cell", "deal", "item_id", what).join(plan, "cell").withColumn("b", deal("deal", "blocks")).withColumn("q", each("chunks"))
    y = asked.join(plan, "cell").withColumn("q", deal("query_id", "chunks")).withColumn("b", each("blocks"))

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        queries, items = right.column("query_id").combine_chunks(), left.column("item_id").combine_chunks()
        if not len(queries) or not len(items):
            return pa.table({"query_id": queries.slice(0, 0), "item_id": items.slice(0, 0), "distance": pa.array([], pa.float64())})
        q = unit(matrix(right.column("vec").combine_chunks()))
        if exact:
            points = unit(matrix(left.column("vec").combine_chunks()))
        else:
            raw = np.frombuffer(b"".join(left.column("code").to_pylist()), dtype=np.uint8)
            points = model.decoded(key[0].as_py(), raw.reshape(len(items), -1))
        half = 0 if exact else ((points * points).sum(axis=1) - 1) / 2
        order = pc.rank(items).to_numpy()
        rows, columns, values = [], [], []
        step = max(1, CELLS // len(items))
        for at in range(0, len(q), step):
            distance = 1 - q[at : at + step] @ points.T + half
            distance = np.round(distance, 6) if exact else distance
            own = pc.index_in(queries.slice(at, step).cast(items.type), value_set=items).fill_null(-1).to_numpy()
            distance[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
            most = min(n, len(items))
            if exact:
                row, column = least(distance, order, n)
            else:
                column = np.argpartition(distance, most - 1, axis=1)[:, :most].reshape(-1)
                row = np.repeat(np.arange(len(distance)), most)
            value = distance[row, column]
            real = value < np.inf
            rows.append(row[real] + at)
            columns.append(column[real])
            values.append(value[real])
        take = lambda a, i: a.take(pa.array(np.concatenate(i)))
        return pa.table({"query_id": take(queries, rows), "item_id": take(items, columns), "distance": np.concatenate(values)})

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, item_id {index.entries.schema['item_id'].dataType.simpleString()}, distance double"
    return x.groupBy("cell", "b", "q").cogroup(y.select("query_id", "vec", "cell", "b", "q").groupBy("cell", "b", "q")).applyInArrow(one, kinds)


def _first(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def search(index: VectorIndex, queries: DataFrame, n: int = 5, probes: int | None = None, candidates: int = CANDIDATES, exact: bool = False) -> DataFrame:
    """queries: query_id, vec (usable ones are answered). query_id, item_id, distance and rank of the n nearest items.

    probes: how many cells a query asks, those of the index if not given. exact: the answer is that of all rows."""
    queries = queries.where(_usable()).select("query_id", "vec")
    if index.model is None:
        item = index.entries.schema["item_id"].dataType.simpleString()
        return queries.select("query_id", F.lit(None).cast(item).alias("item_id"), F.lit(None).cast("double").alias("distance"), F.lit(1).alias("rank")).limit(0)
    near = cut(_first(_met(_asked(queries, index, probes), index, max(n, candidates), False), max(n, candidates)).select("query_id", "item_id"))
    ids = near.select("item_id").distinct()
    ids = F.broadcast(ids) if near.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids
    vectors = index.entries.select("item_id", F.col("vec").alias("other")).join(ids, "item_id", "left_semi")
    compared = near.join(vectors, "item_id").join(queries, "query_id").select("query_id", "item_id", F.round(1 - cosine(F.col("vec"), F.col("other")), 6).alias("distance"))
    found = _first(compared, n)
    if exact:
        # with fewer than n answers nothing is known, so all cells are asked
        known = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), F.max("distance").alias("far"))
        bounded = queries.join(known, "query_id", "left").select("query_id", "vec", F.when(F.col("k") >= n, F.col("far")).otherwise(F.lit(4.0)).alias("within"))
        found = _first(_met(_asked(cut(bounded), index, None), index, n, True), n)
    return found.select("query_id", "item_id", "distance", "rank")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Both: query_id, item_id, distance. queries, and the share of true neighbours that were found; one as near as the farthest true one counts, whichever of equals it is."""
    far = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.max("distance").alias("far"))
    hits = found.join(far, "query_id").where(F.col("distance") <= F.col("far")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    both = far.join(hits, "query_id", "left")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum(F.least(F.coalesce("hits", F.lit(0)), "wanted")) / F.sum("wanted"), 6).alias("recall"))
