"""Best-two-fit packing of tokenised documents into sequences of `capacity` tokens.

Packing asks for lengths only. Documents are tokenised where they lie; longer ones are cut into full pieces and a rest. The lengths'
histogram has `capacity` rows at most, whatever the corpus, and the packer works on it: it fills a bin greedily with the longest pieces that
fit, then replaces the bin's smallest piece with two unpacked ones if they fill the gap more tightly, and repeats that pattern as often as
the counts allow, which is what packing bin by bin would do. A piece then finds its sequence from its length and its rank among
equals: ranks come from counts per task and length, so equal lengths, of many copies say, are never sorted or gathered.

Cases: a null text is empty and has the end token alone. Repeated rows are packed each. Ids play no part. An empty table gives an
empty result. Other columns pass through; columns with the result's names are replaced.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from palimpsest.llm.bpe import WordMemory
from palimpsest.llm.shared import Carried, cut, quoted
from palimpsest.llm.wordhash import pieces as parted

CAPACITY, END = 2048, 0

class WordEncoder(WordMemory):
    """Ids of white-space separated words by a word-end BPE vocabulary of the library tokenizers, as little-endian 32-bit bytes.

    No token crosses white space there, so words are encoded apart and remembered, up to `most` of them. How a word is split is read
    from the file; a file of another make, and words that are not simple, are left to the library.
    """

    def __init__(self, path: str, most: int = 450_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            super().__init__(self.simple_pattern(json.load(file)), most)

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        ids, stops, tokenize = [], [0], self.model.tokenize
        for p in parts:
            ids += [t.id for t in tokenize(p)]
            stops.append(4 * len(ids))
        raw = np.array(ids, dtype="<u4").tobytes()
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def _learn(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = END.to_bytes(4, "little")
        for batch in parted(batches, "text"):
            encoded, at = encoder.by_word([t or "" for t in batch.column("text").to_pylist()]), 0
            while at < len(encoded):
                rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "rank")}
                ids_of = []
                while at < len(encoded) and len(rows["row"]) < 2000:
                    ids = encoded[at] + end
                    n = len(ids) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        part = ids[4 * start : 4 * (start + length)]
                        for k, v in zip(rows, (at, piece, start, length, zlib.crc32(part), int(seen[length])), strict=True):
                            rows[k].append(v)
                        seen[length] += 1
                        if with_ids:
                            ids_of.append(np.frombuffer(part, dtype="<i4"))
                    at += 1
                take = pa.array(rows.pop("row"), pa.int64())
                columns = {"own": batch.column("own").take(take), "piece": pa.array(rows["piece"], pa.int32())} | {k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32", "rank")}
                columns["task"] = pa.array(np.full(len(take), task, dtype=np.int32))
                if with_ids:
                    columns["ids"] = pa.array(ids_of, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how often, [(length, how many), ...]) that use up the counts of lengths from 1 to capacity."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    out = []
    while left.any():
        spare, gap, bin_ = left.copy(), capacity, {}
        while gap:
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            n = int(min(spare[longest], gap // longest))
            bin_[longest] = n
            spare[longest] -= n
            gap -= n * longest
        smallest = min(bin_)
        wide = gap + smallest
        if gap and len(bin_) + max(bin_.values()) > 2 and wide >= 2:
            # the longest spare length up to each x, and the best partner of each
            upto = np.maximum.accumulate(np.where(spare > 0, lengths, 0))[: wide + 1]
            first = np.flatnonzero(spare[:wide])
            second = upto[wide - first]
            alone = (second == first) & (spare[first] < 2)
            second = np.where(alone, upto[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > smallest:
                i = int(total.argmax())
                bin_[smallest] -= 1
                for x in (int(first[i]), int(second[i])):
                    bin_[x] = bin_.get(x, 0) + 1
        bin_ = {k: n for k, n in bin_.items() if n}
        times = min(int(left[k]) // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
        out.append((times, sorted(bin_.items(), reverse=True)))
    return out


def _places(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int):
    """Of each piece, its sequence and offset: the segment of ranks that it falls into says which."""
    used, sequence, rows = np.zeros(capacity + 1, dtype=np.int64), 0, []
    for times, parts in patterns:
        offset = 0
        for length, n in parts:
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    big = np.int64(1) << np.int64(44)  # more than the pieces of any length
    keys = table[:, 0] * big + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * big + rank, side="right") - 1
            into = rank - table[at, 1]
            columns = [*batch.columns, pa.array(table[at, 3] + into // table[at, 2]), pa.array(table[at, 4] + into % table[at, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: docs' other columns, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the ids.
    path: a vocabulary file of the library tokenizers, at the same place on all executors."""
    made = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    work = Carried(docs, [text, "ids", *made], text=F.col(quoted(text)))
    long, types = LongType(), {"ids": ArrayType(IntegerType())} if with_ids else {}
    schema = work.schema(piece=IntegerType(), start=long, length=long, ids_crc32=long, rank=long, task=IntegerType(), **types)
    pieces = cut(work.rows.mapInArrow(_pieces(path, capacity, with_ids), schema))
    by_task = cut(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    run = _places(best_two_fit(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    ranked = pieces.join(base, ["length", "task"]).select("own", *[n for n in made[:-2]], (F.col("rank") + F.col("before")).alias("rank"))
    placed = StructType([*ranked.schema.fields, StructField("sequence_id", long), StructField("offset", long)])
    return work.back(ranked.mapInArrow(run, placed), *made)
