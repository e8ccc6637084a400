"""Substring dedup: words that windows found elsewhere cover, by winnowed phrases and look-ups of windows.

It stands in for a relative Lempel-Ziv parse, which is not built here: no greedy longest factors against reference blocks are made. All that is asked is which windows of
`window` words start anywhere else too, in any document; a word that such a window covers goes. Equal windows have equal seeds, so this answers it for all documents at once, in plain joins.
A window's seed is its k-word gram with the smallest hash (the last on ties), which follows from its words alone.

1. Each document is cut into phrases: the runs of windows with one seed (about 2 of 29 words start one).
2. A phrase found elsewhere word for word: all its windows are duplicates. Inside a long repeat both copies fall into the same phrases, so these cover it but for its two ends.
3. At its ends: windows of phrases that are not found as a whole, but whose seed also lies elsewhere, are looked up one by one.
   One place of each repeated phrase lists its windows too, where such a seed asks for them, so no match is missed.

Hashes of phrases and windows have 128 bits. Hot phrases only make rows of plain joins, which AQE can split; nothing but the spans of
one document is gathered.

Cases: null and empty texts have no words and lose none. Very long texts are taken whole. Texts under `window` words lose none. Equal rows count as each other's
copies. Other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from palimpsest.llm.shared import Carried, cut, row_key
from palimpsest.llm.wordhash import BASE, BASE_2, Spans, Words, finish, pieces

WINDOW, SEED = 35, 8


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Of each window of width values, the place of the smallest; the last on ties. By doubling."""
    value, place, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = value[:-step], value[step:]
        take = right <= left
        value, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        span += step
    return place


def _hashers(words: Words) -> tuple[np.ndarray, Spans, Spans]:
    h = words.hashes()
    return h, Spans(h, BASE), Spans(finish(h ^ np.uint64(BASE_2)), BASE_2)


def _phrases(window: int, seed: int):
    schema = pa.schema([("row", pa.binary()), ("s", pa.int32()), ("n", pa.int32()), ("seed", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            h, one, two = _hashers(words)
            if len(h) < window:
                continue
            at = np.arange(len(h) - window + 1)
            grams = one.hash(np.arange(len(h) - seed + 1), np.arange(seed, len(h) + 1))
            place = _last_minimum(grams, window - seed + 1)
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            at = at[at + window <= words.first[1:][doc[at]]]
            if not len(at):
                continue
            place = place[at]
            begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            s, n = at[begins], np.diff(np.r_[begins, len(at)])
            ends = s + n + window - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(doc[s])).cast(pa.binary()), pa.array((s - words.first[doc[s]]).astype(np.int32)), pa.array(n.astype(np.int32)), _signed(grams[place[begins]]), _signed(one.hash(s, ends)), _signed(two.hash(s, ends))],
                schema=schema,
            )

    return run, "row binary, s int, n int, seed bigint, p1 bigint, p2 bigint"


def _windows(window: int):
    """Of each document, the windows that its spans ask for."""
    schema = pa.schema([("row", pa.binary()), ("s", pa.int32()), ("open", pa.bool_()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            _, one, two = _hashers(words)
            doc, start, n, opened = _spans(batch.column("spans"), words)
            each = np.repeat(np.arange(len(start)), n)
            at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            step = 1 << 18
            for i in range(0, len(at), step):
                a, e = at[i : i + step], each[i : i + step]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(doc[e])).cast(pa.binary()), pa.array((a - words.first[doc[e]]).astype(np.int32)), pa.array(opened[e]), _signed(one.hash(a, a + window)), _signed(two.hash(a, a + window))], schema=schema
                )

    return run, "row binary, s int, open boolean, w1 bigint, w2 bigint"


def _spans(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word (counted through the batch), number of windows and flag of each element of the arrays."""
    sizes = np.diff(column.offsets.to_numpy()) if not column.null_count else np.array([len(x.as_py() or ()) for x in column])
    doc = np.repeat(np.arange(len(column)), sizes)
    flat = column.flatten()
    s, n = flat.field("s").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
    opened = flat.field("open").to_numpy(zero_copy_only=False) if flat.type.get_field_index("open") >= 0 else np.zeros(len(s), dtype=bool)
    return doc, words.first[doc] + s.astype(np.int64), n.astype(np.int64), opened.astype(bool)


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs: columns row (distinct documents have distinct ones) and text. Runs of windows that also start elsewhere: row, s (first
    word of the first window), n (windows). Runs may meet but don't share windows."""
    run, schema = _phrases(window, seed)
    phrases = cut(docs.select("row", "text").mapInArrow(run, schema))
    place = F.xxhash64("row", "s")
    found = cut(phrases.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("lister")).where(F.col("copies") > 1).drop("copies"))
    marked = phrases.join(found, ["p1", "p2"], "left").select("row", "s", "n", "seed", F.col("lister").isNull().alias("open"), (F.col("lister") == place).alias("lists"))
    # 64-bit places of one phrase can only be equal for equal rows, which then list the same windows
    settled = F.col("lists").isNotNull() & ~F.col("open")
    marked = cut(marked)
    active = marked.where(F.col("open") | F.col("lists"))
    seeds = active.groupBy("seed").agg(F.count(F.lit(1)).alias("places"), F.max(F.col("open")).alias("asked")).where((F.col("places") > 1) & F.col("asked")).select("seed")
    asked = cut(active.join(cut(seeds), "seed", "left_semi").select("row", "s", "n", "open"))
    spans = asked.groupBy("row").agg(F.collect_set(F.struct("s", "n", "open")).alias("spans"))
    run, schema = _windows(window)
    windows = cut(docs.select("row", "text").join(spans, "row").select("row", "text", "spans").mapInArrow(run, schema))
    twice = cut(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > 1).select("w1", "w2"))
    single = windows.where("open").join(twice, ["w1", "w2"], "left_semi").select("row", "s", F.lit(1).alias("n"))
    return marked.where(settled).select("row", "s", "n").unionByName(single)


def _kept(window: int, passages: bool):
    """What is left of each text. The digest is that of the kept words joined by one space; with passages, also the text without the
    removed words (untouched where nothing goes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            doc, start, n, _ = _spans(batch.column("spans"), words)
            change = np.zeros(len(words.start) + 1, dtype=np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + n + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.first[:-1]) * (words.counts > 0)
            raw = words.raw.tobytes()
            digests, texts = [], []
            for d in range(len(words.counts)):
                low, high = int(words.offsets[d]), int(words.offsets[d + 1])
                if not removed[d]:
                    kept = raw[low:high].split()
                    texts.append(batch.column("text")[d].as_py() if passages else None)
                else:
                    stay = words.first[d] + np.flatnonzero(~gone[words.first[d] : words.first[d + 1]])
                    kept = [raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]
                    texts.append(_without(raw, low, high, words, d, gone) if passages else None)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            names = ["n_words", "n_removed", "kept_sha256", "kept"]
            n = len(names) if passages else len(names) - 1
            yield pa.RecordBatch.from_arrays([batch.column("own"), *columns[:n]], names=["own", *names[:n]])

    return run


def _without(raw: bytes, low: int, high: int, words: Words, d: int, gone: np.ndarray) -> str:
    """The text without the removed words and the white space after each."""
    out, at = [], low
    first, last = int(words.first[d]), int(words.first[d + 1])
    flags = gone[first:last]
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(raw[at : int(words.start[first + a])])
        at = int(words.start[first + b]) if first + b < last else high
    out.append(raw[at:high])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, passages: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, with passages, the text without its repeated passages (else no text)."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    spans = repeated_spans(keyed, window, seed).groupBy("row").agg(F.collect_set(F.struct("s", "n")).alias("spans"))
    none = F.array().cast("array<struct<s:int,n:int>>")
    made = {"n_words": LongType(), "n_removed": LongType(), "kept_sha256": StringType()}
    work = Carried(docs, made if passages else [*made, "text"], {"text": "kept"} if passages else {}, row=row_key(F.col("doc_id"), F.col("text")), text=F.col("text"))
    rows = work.rows.join(spans, "row", "left").select("own", "text", F.coalesce("spans", none).alias("spans"))
    kept = {"kept": StringType()} if passages else {}
    return work.back(rows.mapInArrow(_kept(window, passages), work.schema(**made, **kept)), *made)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, s, array_to_string(w[s:s+34], ' ') AS t FROM g),
r AS (SELECT t FROM h GROUP BY t HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, s + unnest(range(0, 35)) AS i FROM h SEMI JOIN r USING (t)),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(len(gone), 0) AS n_removed,
             coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '') AS kept
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
