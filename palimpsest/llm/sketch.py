"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every hash of a text's word shingles below a fixed fraction of the hash space, whatever the text's length, so sketches can be
merged, and the containment of a short text in a very long one can be estimated from what both kept.

A fingerprint is text: the sorted 48-bit hashes below the fraction in base64, after a digest of all the text's shingles and a colon. The
digest takes no part in estimates but one: texts of equal shingles are alike to 1, also where the fraction holds none of their hashes.

Cases: a null or empty text, or one without words, has no shingles; two such are alike to 1, one such and another to 0. Different texts of
which neither has a hash below the fraction (both have a few shingles only) are alike to 0: nothing in common is known. A text of fewer words than a shingle
has one: all its words. An empty table gives an empty result. Other columns pass through; columns with the result's names are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from palimpsest.llm.shared import Carried, let, quoted
from palimpsest.llm.wordhash import Words, pieces

SHINGLE, FRACTION, BITS = 5, 1 / 4, 48


class Sketch(NamedTuple):
    """digest: of all shingles; empty after a merge. hashes: sorted, those below the fraction."""

    digest: str
    hashes: np.ndarray


def sketches(texts: pa.Array, shingle: int = SHINGLE, fraction: float = FRACTION) -> list[Sketch]:
    words = Words(texts)
    hashes, doc = words.grams(words.hashes(), shingle)
    hashes = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    hashes, doc = hashes[new], doc[new]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    bound = int(fraction * (1 << BITS))
    return [Sketch(xxhash.xxh64_hexdigest(hashes[a:b].tobytes()), hashes[a : a + int(np.searchsorted(hashes[a:b], bound))]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(sketch: Sketch) -> str:
    raw = sketch.hashes.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return f"{sketch.digest}:{base64.b64encode(raw.tobytes()).decode()}"


def decode(fingerprint: str) -> Sketch:
    digest, _, rest = fingerprint.partition(":")
    raw = np.frombuffer(base64.b64decode(rest), dtype=np.uint8).reshape(-1, BITS // 8)
    return Sketch(digest, np.hstack([np.zeros((len(raw), 8 - BITS // 8), dtype=np.uint8), raw]).copy().view(">i8").reshape(-1).astype(np.int64))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    return a if a.digest and a.digest == b.digest else Sketch("", np.union1d(a.hashes, b.hashes))


def compare(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimates of the Jaccard similarity, and of the share of a's shingles that b has."""
    if a.digest and a.digest == b.digest:
        return 1.0, 1.0
    common = len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))
    total = len(a.hashes) + len(b.hashes) - common
    return common / total if total else 0.0, common / len(a.hashes) if len(a.hashes) else 0.0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array([encode(s) for s in sketches(batch.column("text"))], pa.string())], names=["own", "fingerprint"])


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, but for the text, with fingerprint."""
    work = Carried(docs, [text, "fingerprint"], text=F.col(quoted(text)))
    return work.back(work.rows.mapInArrow(_fingerprints, work.schema(fingerprint=StringType())), "fingerprint")


MADE = {"n_chars": LongType(), "edited_sha256": StringType(), "fingerprint": StringType(), "edited_fingerprint": StringType(), "near_edited": DoubleType(), "near_next": DoubleType(), "contained_edited": DoubleType()}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; a bucket's last rows are only there to be the next of the one before. Pairs are measured a few MB at a time."""
    before: tuple | None = None
    pairs: list[tuple[pa.Array, str, str]] = []
    size = 0

    def measured() -> pa.RecordBatch:
        own, texts, following = zip(*pairs, strict=True)
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        mine, after, nexts = (sketches(pa.array(x, pa.large_string())) for x in (texts, edited, following))
        near = [(*compare(a, b), compare(a, c)[0]) for a, b, c in zip(mine, after, nexts, strict=True)]
        digests = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()), pa.array(map(encode, mine), pa.string()), pa.array(map(encode, after), pa.string())]
        columns += [pa.array([n[i] for n in near], pa.float64()) for i in (0, 2, 1)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(own), *columns], names=["own", *MADE])

    for batch in batches:
        own = batch.column("own")
        for i, (bucket, borrowed, text) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("bucket", "borrowed", "text")), strict=True)):
            if before and before[0] == bucket and not before[1]:
                pairs.append((before[2], before[3], text or ""))
                size += len(before[3])
                if size > 2_000_000:
                    yield measured()
                    pairs, size = [], 0
            before = (bucket, borrowed, own.slice(i, 1), text or "")
    if pairs:
        yield measured()


def _upto(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most value, by binary search: the plan and a row's work grow with their logarithm, but for the literal."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    listed = F.lit(np.array(bounds, dtype=np.int64))
    further = lambda n, s: F.when(n + s <= len(bounds), F.when(F.get(listed, n + s - 1) <= value, n + s).otherwise(n)).otherwise(n)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """docs, but for the text, with the sketches of each text and of its edited text (the second half replaced by the beginning of the next
    document), and how alike it is to both.

    Documents are in descending order of doc_id (an integer), nulls last, rows of one id in order of a hash of the text, then of the text; the first follows the
    last. They are dealt into buckets by quantiles of the id; an id, or null, that fills several buckets by itself is split by the hash.
    Each bucket is sorted on its own and borrows the first document of the next one.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_edges = 8 * tasks
    found, rows, nulls = docs.agg(F.percentile_approx("doc_id", [i / n_edges for i in range(1, n_edges)], 10 * n_edges), F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    work = Carried(docs, [*MADE, "text"], id=F.col("doc_id").cast("bigint"), text=F.col("text"), hash=F.xxhash64("text"))
    if not rows:
        return work.back(work.rows.mapInArrow(_edited, work.schema(**MADE)), *MADE)
    listed = [int(x) for x in found or []]
    # ids up to the first edge are the last range, those from the last one on range 0; nulls follow all ids. A hot id repeats among the edges: it is a range of its own
    often = {x: n for x, n in Counter(listed).items() if n > 1}
    edges = sorted({*listed, *[x + 1 for x in often]})
    at_edge = {x: i for i, x in enumerate(edges)}
    below = _upto(F.col("id"), edges)
    place = F.when(F.col("id").isNull(), F.lit(len(edges) + 1)).otherwise(len(edges) - below)
    width = [1] * (len(edges) + 2)
    for x, n in often.items():
        width[len(edges) - at_edge[x] - 1] = n
    width[-1] = max(1, round(nulls * n_edges / rows))
    # parts of a range follow the hash's order
    part = let(F.get(F.lit(np.array(width, dtype=np.int64)), F.col("place")), lambda w: F.when(w > 1, F.floor((F.shiftright("hash", 32) + (1 << 31)) * w / float(1 << 32))).otherwise(F.lit(0)))
    ranged = work.rows.withColumn("place", place.cast("int"))
    ranged = ranged.withColumn("bucket", F.struct(F.col("place"), part.cast("int").alias("part")))
    firsts: list[Row] = ranged.groupBy("bucket").agg(F.min_by(F.struct("id", "hash"), F.struct(F.bitwise_not("id"), "hash")).alias("first")).collect()
    firsts = sorted(firsts, key=lambda r: tuple(r.bucket))
    number = {tuple(r.bucket): i for i, r in enumerate(firsts)}
    starts, total = [0] * len(width), 0
    for i, w in enumerate(width):
        starts[i], total = total, total + w
    numbers = [-1] * total
    for (at, p), i in number.items():
        numbers[starts[at] + p] = i
    as_array = lambda values: F.lit(np.array(values, dtype=np.int64))
    bucket = F.get(as_array(numbers), (F.get(as_array(starts), F.col("bucket.place")) + F.col("bucket.part")).cast("int")).cast("int")
    dealt = ranged.withColumn("bucket", bucket)
    # the first row of a bucket is lent to the bucket before it
    first = F.get(as_array([r.first.id or 0 for r in firsts]), F.col("bucket")), F.get(as_array([r.first.hash for r in firsts]), F.col("bucket"))
    lends = (F.coalesce("id", F.lit(0)) == first[0]) & (F.col("hash") == first[1])
    own = F.struct(F.col("bucket"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(firsts))).alias("bucket"), F.lit(True).alias("borrowed"))
    spread = dealt.select("own", "text", "id", "hash", F.explode(F.when(lends, F.array(own, lent)).otherwise(F.array(own))).alias("to")).select("own", "text", "id", "hash", "to.bucket", "to.borrowed")
    order = ["bucket", "borrowed", F.col("id").desc_nulls_last(), "hash", F.col("text").asc_nulls_first()]
    made = spread.repartition(tasks, "bucket").sortWithinPartitions(*order).mapInArrow(_edited, work.schema(**MADE))
    return work.back(made, *MADE)
