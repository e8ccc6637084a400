"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors become integers, floor(scale * x), and are cut into parts; each part position has a codebook of a few entries, fitted by rounds of
assigning every part to its nearest entry and moving each entry to its parts' mean. All of it is integer arithmetic, so results don't depend on the order of rows or tasks.

The nearest entry by annular pruning: entries are sorted by norm. The one whose norm is nearest to the part's, found by binary search, gives the best distance so far,
d. By the triangle inequality nothing nearer, or as near, lies outside the annulus of norms from |x| - d to |x| + d, both included; two more binary
searches give that interval, and its entries alone are evaluated, exactly. Norms are floating point, so the annulus is widened by their error.

Vectors are written once as packed integers. A round is a pass over them that leaves sums and counts by entry from each task; Spark adds those up, and only codebooks
(entries x dimension numbers) come to the driver and go with the next pass.

Cases: rows whose vector is null or holds null or non-finite components are dropped. The dimension is that of the smallest id's vector; vectors of another
length stay with null codes and error, and learn nothing. Lengths that parts don't divide are cut as evenly as can be. Scaled components stop at +-2^23, so distances fit 64 bits.
Rows with equal ids are rows each, in order of their vectors where ids decide the start; null ids never start an entry, and with too few ids there are fewer entries. Ties go to the lower entry.
An empty table gives an empty result. Other columns pass through; those with the results' names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from palimpsest.llm.shared import Carried, cut, quoted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
MOST = 1 << 23
#: Numbers that one step of numpy holds: rows x entries x width of a part.
STEP = 1 << 21
#: Groups whose sums are broadcast; with more of them, sums and rows meet in a shuffled join.
MOST_GROUPS = 100_000


class Book:
    """One part position's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.evaluated = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the nearest entry's number, the lowest among equals, and its squared distance."""
        step = max(1, STEP // max(1, self.entries.size))
        found = [self._nearest(x[at : at + step]) for at in range(0, len(x), step)]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, norm = len(self.norms), np.sqrt((x * x).sum(axis=1).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norms, norm), n - 1)
        below = np.maximum(above - 1, 0)
        start = np.where(np.abs(self.norms[below] - norm) < np.abs(self.norms[above] - norm), below, above)
        reach = np.sqrt(((x - self.entries[start]) ** 2).sum(axis=1).astype(np.float64))
        reach += 1e-9 * (norm + reach) + 1e-6
        low, high = np.searchsorted(self.norms, norm - reach), np.searchsorted(self.norms, norm + reach, side="right")
        counts = high - low
        starts = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(x)), counts)
        entry = np.arange(len(row)) - np.repeat(starts - low, counts)
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        self.evaluated += len(row)
        best = np.minimum.reduceat(distance, starts)
        number = np.where(distance == best[row], self.order[entry], n)
        return np.minimum.reduceat(number, starts), best


@dataclass
class Codebooks:
    """entries[part] is an array of entries x width; bounds are where parts begin, and the dimension."""

    bounds: list[int]
    entries: list[np.ndarray]

    @property
    def dimension(self) -> int:
        return self.bounds[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(c) for e in self.entries for c in e.reshape(-1).tolist()).encode()).hexdigest()

    def parts(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, Book]]:
        for k, entries in enumerate(self.entries):
            yield x[:, self.bounds[k] : self.bounds[k + 1]], Book(entries)


def _packed(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            raw = np.clip(values, -MOST, MOST).astype("<i4").tobytes()
            ends = np.r_[0, np.cumsum([4 * len(v) for v in vectors])].astype(np.int64)
            packed = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("id"), packed], names=["own", "id", "packed"])

    return run


def _unpacked(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the dimension, and their vectors."""
    lists = column.to_pylist()
    has = np.array([len(v) == 4 * dimension for v in lists], dtype=bool)
    joined = np.frombuffer(b"".join([v for v, h in zip(lists, has, strict=True) if h]), dtype="<i4")
    return np.flatnonzero(has), joined.astype(np.int64).reshape(int(has.sum()), dimension)


def _sums(books: Codebooks):
    """Of each task: for each entry its parts' sums by component and, at the part's width, their count."""
    wide = max(np.diff(books.bounds)) + 1
    most = max(map(len, books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books.entries), most, wide), dtype=np.int64)
        for batch in batches:
            _, x = _unpacked(batch.column("packed"), books.dimension)
            for k, (part, book) in enumerate(books.parts(x)):
                entry, _ = book.nearest(part)
                np.add.at(sums[k, :, : part.shape[1]], entry, part)
                sums[k, :, -1] += np.bincount(entry, minlength=most)
        slots = np.flatnonzero(np.repeat(sums[:, :, -1:] > 0, wide, axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums.reshape(-1)[slots])], names=["slot", "value"])

    return run


@dataclass
class Vectors:
    """A caller's rows with their vectors as packed integers, written once."""

    work: Carried
    rows: DataFrame


def vectors(rows: DataFrame, vector: str = "embedding", order: str = "vec_id", scale: float = SCALE) -> Vectors:
    v = F.col(quoted(vector))
    usable = rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    work = Carried(usable, [vector, "codes", "error"], id=F.col(quoted(order)), vector=v)
    return Vectors(work, cut(work.rows.mapInArrow(_packed(scale), work.schema("id", packed=BinaryType()))))


def fit(given: Vectors, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """None where there is no vector to start from. Entries start as the vectors with the smallest ids."""
    ordered = given.rows.where("id IS NOT NULL").orderBy("id", "packed")
    first = ordered.select("packed").first()
    if first is None:
        return None
    size = len(first.packed)
    begin = np.stack([np.frombuffer(r.packed, dtype="<i4").astype(np.int64) for r in ordered.where(F.octet_length("packed") == size).select("packed").limit(entries).collect()])
    bounds = [k * begin.shape[1] // parts for k in range(parts + 1)]
    books = Codebooks(bounds, [begin[:, a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    wide = int(max(np.diff(bounds))) + 1
    for _ in range(rounds):
        found = given.rows.select("packed").mapInArrow(_sums(books), "slot bigint, value bigint").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        sums = np.zeros(parts * len(begin) * wide, dtype=np.int64)
        sums[found.column("slot").to_numpy()] = found.column("value").to_numpy()
        sums = sums.reshape(parts, len(begin), wide)
        for k, own in enumerate(books.entries):
            used = sums[k, :, -1] > 0
            own[used] = sums[k, used, : own.shape[1]] // sums[k, used, -1:]
    return books


def encode(given: Vectors, books: Codebooks | None) -> DataFrame:
    """The caller's other columns, codes (an entry's number for each part) and error (squared distances summed over parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            has, x = _unpacked(batch.column("packed"), books.dimension) if books else (np.zeros(0, dtype=np.int64), None)
            codes, error = np.zeros((len(has), len(books.entries) if books else 0), dtype=np.int32), np.zeros(len(has), dtype=np.int64)
            for k, (part, book) in enumerate(books.parts(x) if books else ()):
                codes[:, k], distance = book.nearest(part)
                error += distance
            place = np.full(n, -1, dtype=np.int64)
            place[has] = np.arange(len(has))
            take = pa.array(place, mask=place < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), lists.take(take), pa.array(error).take(take)], names=["own", "codes", "error"])

    made = given.work.schema(codes=ArrayType(IntegerType()), error=LongType())
    return given.work.back(given.rows.select("own", "packed").mapInArrow(run, made), "codes", "error")


def with_group_error(coded: DataFrame, label: str = "label", name: str = "label_error") -> DataFrame:
    """coded and the error summed over the rows of an equal label, nulls together; null where that passes 64 bits. Sums are made before
    rows meet them, so a label of any size is one row a task there; where labels are many, AQE splits the one that is hot."""
    sums = cut(coded.groupBy(F.col(quoted(label)).alias("_label")).agg(F.try_sum("error").alias("_sum")))
    side = F.broadcast(sums) if sums.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else sums
    joined = coded.join(side, F.col(quoted(label)).eqNullSafe(F.col("_label")), "left")
    return joined.select(*[F.col(quoted(c)) for c in coded.columns], F.col("_sum").alias(name))


def _oracle() -> str:
    steps = [f"""
kept AS (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
wide AS (SELECT max(len(v)) // {PARTS} AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, k AS part, j AS pos, v[k * w + j + 1] AS c FROM kept, wide, range({PARTS}) AS p(k), range(w) AS q(j)),
book0 AS MATERIALIZED (SELECT part, entry, pos, c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
distance{n} AS (SELECT vec_id, part, entry, sum((p.c - b.c) * (p.c - b.c)) AS d FROM parts p JOIN book{n} b USING (part, pos) GROUP BY ALL),
near{n} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM distance{n} GROUP BY ALL)""")
        if n < ROUNDS:
            steps.append(f"""
mean{n} AS (SELECT part, entry, pos, sum(c) AS s, count(*) AS n FROM parts JOIN near{n} USING (vec_id, part) GROUP BY ALL),
book{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN b.c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM book{n} b LEFT JOIN mean{n} USING (part, entry, pos))""")
    return f"""
WITH {",".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


#: Ids are taken as unique here.
ORACLE_SQL = _oracle()
