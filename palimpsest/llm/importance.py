"""Quality classifier by importance resampling.

Two generative models of hashed word 1- and 2-grams, one of the target text (documents labelled good) and one of the raw text (all
documents), give each document the log ratio of its likelihoods. Adding Gumbel noise and keeping the k largest is sampling k documents
without replacement in proportion to that ratio. k is given, or as a share of the documents; else it is the number of documents which the raw
model doesn't explain better by more than `margin` nats, so that a corpus of target-like documents stays whole.

The raw model counts every document. The target model may use a sample of the labelled rows: the `most_target` with the smallest hash
of doc_id (a fixed bound, so their ids can be broadcast). Models have `buckets` entries; the target
model has the raw one as its prior, worth prior * sqrt(buckets * n) features, n being the target's own. A bucket's count is off by the square root of itself, which costs a text that the target
is like, but that isn't in it, about buckets / (2 n (1 + p)^2) nats a feature where the prior is worth p times the target: with the root that is the same for samples of any size, so a few dozen
texts don't favour their own words, and still tell. The k-th largest value is found exactly by
histograms of fixed size, so nothing is sorted as a whole. Noise follows from doc_id and text; equal rows have equal noise and go or
stay together, as do exact ties at the border, which all stay.

Cases: a null or empty text, also where a whole batch has no other, has no features and log ratio 0. Without labelled good documents, or
documents, the ratio is 0 and all stay. Null ids are never labelled. Other columns pass through; columns with the result's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from palimpsest.llm.shared import Carried, cut
from palimpsest.llm.wordhash import Words, pieces

BUCKETS, MOST_TARGET, PRIOR, MARGIN = 10_000, 5000, 20.0, 3.0


def _features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each 1-gram and 2-gram."""
    h = words.hashes()
    one = np.repeat(np.arange(len(words.counts)), words.counts)
    two, doc = words.grams(h, 2)
    return np.r_[(h % np.uint64(buckets)), (two % np.uint64(buckets))].astype(np.int64), np.r_[one, doc]


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in pieces(batches, "text"):
            feature, doc = _features(Words(batch.column("text")), buckets)
            raw += np.bincount(feature, minlength=buckets)
            good = batch.column("good").to_numpy(zero_copy_only=False)
            target += np.bincount(feature[good[doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_target: int = MOST_TARGET, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket. labels: doc_id and quality (1: good)."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_target)
    rows = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("_good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))
    found = rows.mapInArrow(_counts(buckets), "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.zeros(buckets)
    for r in found:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    raw /= raw.sum()
    if not target.any():
        return np.zeros(buckets)
    target += prior * math.sqrt(buckets * target.sum()) * raw
    return np.log(target / target.sum()) - np.log(raw)


def _ratios(weights: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            feature, doc = _features(words, len(weights))
            # without any feature, bincount gives integers whatever the weights are
            ratio = np.bincount(doc, weights=weights[feature], minlength=len(words.counts)).astype(np.float64)
            columns = [*[batch.column(n) for n in names], pa.array(words.counts.astype(np.int64)), pa.array(ratio)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "log_ratio"])

    return run


def score(docs: DataFrame, weights: np.ndarray, keep_text: bool = True) -> DataFrame:
    """docs with n_words, log_ratio and key, the ratio with its noise."""
    noise = F.pmod(F.xxhash64("doc_id", "text", F.lit("gumbel")), F.lit((1 << 52) - 1))
    noise = -F.log(-F.log((noise + 0.5) / F.lit(float(1 << 52))))
    made = ["n_words", "log_ratio", "key", "kept"]
    work = Carried(docs, made if keep_text else [*made, "text"], {"text": "text"} if keep_text else {}, text=F.col("text"), noise=noise)
    names = ["own", "text", "noise"] if keep_text else ["own", "noise"]
    rows = work.rows.mapInArrow(_ratios(weights, names), work.schema(*names[1:], n_words=LongType(), log_ratio=DoubleType()))
    return work.back(rows, "n_words", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("key"))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """Exact: each pass counts `bins` ranges and goes on with the one that holds the k-th. Where fewer than `bins` numbers lie between the
    ends, each of them is counted."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / bins
        inside = rows.where(F.col(column).between(low, high))
        narrow = width <= 2 * math.ulp(max(abs(low), abs(high)))
        at = F.col(column) if narrow else F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.low):
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, keep_text: bool = True, buckets: int = BUCKETS, most_target: int = MOST_TARGET, prior: float = PRIOR, margin: float = MARGIN
) -> DataFrame:
    """docs with n_words, log_ratio, key and kept. k documents are kept, or that share of all."""
    scored = cut(score(docs, fit(docs, labels, buckets, most_target, prior), keep_text))
    if k is None:
        k = scored.where(F.col("log_ratio") >= -margin).count() if share is None else round(share * scored.count())
    bound = kth_largest(scored, "key", k)
    return scored.withColumn("kept", F.lit(False) if bound is None else F.col("key") >= F.lit(bound))
