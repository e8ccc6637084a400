"""Toxicity by a convolutional text classifier in numpy.

Lower-cased words, and their beginnings of a few lengths, are hashed into embeddings, and a word is the sum of its own; filters of several
widths slide over the words; each filter's maximum over the whole text feeds a logistic output. Scoring whole texts of any length is a
look-up, one matrix product and a maximum.

Training is Adam on all labelled rows, which lie in shards of about `most_bytes` of text: counts of the texts that have a bucket are summed over all shards, and in each of a few rounds every shard goes
through its own rows from the model all share; the changes are averaged, those of an embedding over the texts that touched it. The driver gets the model only. Labels, language, source and id are no inputs
of a score (id and text deal rows to shards). A calibration part of the rows (a quarter by hash; if it has none of a label, all of that label's) fixes the scale on which 0.7 separates best, and the threshold of each language
that has enough toxic rows; both come from counts of all its rows by logit, in steps of 1/1024.

Cases: a null text, and one without words, scores as an ordinary clean text at most. Without any toxic or any clean labelled row all scores are 0. Very long texts are scored whole, in one pass over their words.
Equal texts have equal scores; repeated rows are learnt from and scored each. An empty table gives an empty result. Other columns pass through; columns with the result's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from palimpsest.llm.shared import Carried, cut
from palimpsest.llm.wordhash import BASE_2, Spans, Words, pieces

BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 6
MOST_BYTES, ROUNDS, EPOCHS, BATCH, RATE, LEAST_TEXTS = 8 << 20, 4, 2, 64, 0.02, 4
#: A logit is counted in steps of this, up to 128 either way.
STEP, MOST_LOGIT = 1 / 1024, 128.0
#: So many labels, of some 20 bytes, are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 5_000_000
THRESHOLD = 0.7


#: A word's embeddings: the whole word, and its beginnings of so many bytes.
BEGINNINGS = (4, 5, 6, 7)
PARTS = 1 + len(BEGINNINGS)


def _buckets(texts: pa.Array) -> tuple[np.ndarray, Words]:
    """A row of PARTS buckets for each word."""
    words = Words(texts, lower=True, marks_part=True)
    spans = Spans(words.raw.astype(np.uint64) + np.uint64(1), BASE_2)
    parts = [words.hashes(), *[spans.hash(words.start, np.minimum(words.end, words.start + n)) for n in BEGINNINGS]]
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in parts], axis=1), words


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    intercept: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    #: The logit of a text without words.
    blank: float = 0.0

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = self.embedding[ids[:, 0]]
        for k in range(1, PARTS):
            out += self.embedding[ids[:, k]]
        return out

    def responses(self, vectors: np.ndarray, w: int) -> np.ndarray:
        """Of each window of w words."""
        m = len(vectors) - w + 1
        if m <= 0:
            return np.zeros((0, FILTERS), dtype=np.float32)
        out = vectors[:m] @ self.filters[w][:SIZE]
        for j in range(1, w):
            out += vectors[j : j + m] @ self.filters[w][j * SIZE : (j + 1) * SIZE]
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: where each text begins in ids, and the end."""
        n, vectors = len(first) - 1, self.vectors(ids)
        pooled = np.zeros((n, FILTERS * len(WIDTHS)), dtype=np.float32)
        ends = np.repeat(first[1:], np.diff(first))
        for i, w in enumerate(WIDTHS):
            response = self.responses(vectors, w)
            whole = np.flatnonzero(np.arange(len(response)) + w <= ends[: len(response)])
            counts = np.maximum(np.diff(first) - w + 1, 0)
            full = np.flatnonzero(counts)
            if len(full):
                starts = np.cumsum(counts[full]) - counts[full]
                best = np.maximum.reduceat(response[whole], starts, axis=0) + self.bias[w]
                pooled[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum(best, 0)
        return pooled @ self.out + self.intercept

    def scores(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))


def start(within: list[np.ndarray], sizes: list[int], seed: int = 7) -> tuple[Model, np.ndarray]:
    """within: of clean and of toxic texts, how many have each bucket; sizes: how many there are. The model before its training, and which buckets are learnt."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
        {w: rng.normal(0, 0.3, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    # buckets of too few texts say nothing: they respond with zero and aren't learnt
    seen = within[0] + within[1] >= LEAST_TEXTS
    # the first component begins with the smoothed log odds of the texts that have the word; from there, maxima fall on telling words
    odds = [np.log((n + 5) / (size + 50)) for n, size in zip(within, sizes, strict=True)]
    model.embedding[:, 0] = 0.2 * (odds[1] - odds[0])
    model.embedding[~seen] = 0
    for k in model.filters.values():
        k[::SIZE] = np.abs(k[::SIZE]) + 0.2
    return model, seen


def _texts_with(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the texts have each bucket."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(np.unique(text[:, None] * BUCKETS + ids) % BUCKETS, minlength=BUCKETS)


def _dense(model: Model) -> np.ndarray:
    return np.concatenate([x.reshape(-1) for x in (*model.filters.values(), *model.bias.values(), model.out, np.array([model.intercept]))]).astype(np.float32)


def _with_dense(model: Model, embedding: np.ndarray, dense: np.ndarray) -> Model:
    shapes = [*[(w * SIZE, FILTERS) for w in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (FILTERS * len(WIDTHS),), (1,)]
    parts = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(dense, np.cumsum([math.prod(s) for s in shapes])[:-1]), shapes, strict=True)]
    n = len(WIDTHS)
    return Model(embedding, dict(zip(WIDTHS, parts[:n], strict=True)), dict(zip(WIDTHS, parts[n : 2 * n], strict=True)), parts[-2], float(parts[-1][0]))


def learn(model: Model, seen: np.ndarray, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, rate: float = RATE) -> tuple[Model, np.ndarray]:
    """Adam on the logistic loss, from model, which stays as it is. Only the window that gives a filter its maximum has a gradient. Also how many texts each bucket was touched by."""
    model = _with_dense(model, model.embedding.copy(), _dense(model))
    values = [model.embedding, *model.filters.values(), *model.bias.values(), model.out, np.array([model.intercept], dtype=np.float32)]
    one, two, step, touches = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0, np.zeros(BUCKETS, dtype=np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = first[rows + 1] - first[rows]
            begin = np.r_[0, np.cumsum(sizes)]
            own = ids[np.repeat(first[rows] - begin[:-1], sizes) + np.arange(begin[-1])]
            vectors, ends = model.vectors(own), np.repeat(begin[1:], sizes)
            pooled, windows = np.zeros((len(rows), len(model.out)), dtype=np.float32), {}
            for i, w in enumerate(WIDTHS):
                response, full = model.responses(vectors, w), np.flatnonzero(sizes >= w)
                if not len(full):
                    continue
                whole = np.flatnonzero(np.arange(len(response)) + w <= ends[: len(response)])
                counts = sizes[full] - w + 1
                response = response[whole]
                best = np.maximum.reduceat(response, np.cumsum(counts) - counts, axis=0)
                text = np.repeat(np.arange(len(full)), counts)
                # of each filter and text the first window with the maximum
                f, place = np.nonzero((response == best[text]).T)
                place = place[np.unique(f * len(full) + text[place], return_index=True)[1]].reshape(FILTERS, len(full))
                pooled[full, i * FILTERS : (i + 1) * FILTERS] = best + model.bias[w]
                windows[w] = full, whole[place][:, :, None] + np.arange(w)
            active = pooled > 0
            pooled = np.where(active, pooled, 0)
            error = (1 / (1 + np.exp(-(pooled @ model.out + values[-1][0]))) - labels[rows]).astype(np.float32)
            grads = [np.zeros_like(v) for v in values[1:]]
            grads[-2] += error @ pooled
            grads[-1] += error.sum()
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            for i, w in enumerate(WIDTHS):
                if w not in windows:
                    continue
                full, words = windows[w]
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                g = (error[full, None] * model.out[part] * active[full, part]).T.astype(np.float32)
                x = vectors[words].reshape(FILTERS, len(full), w * SIZE)
                grads[i] += np.einsum("fk,fkd->df", g, x)
                grads[len(WIDTHS) + i] += g.sum(axis=1)
                back = (g[:, :, None] * model.filters[w].T[:, None, :]).reshape(-1, SIZE)
                touched.append((own[words].reshape(-1), np.repeat(back, PARTS, axis=0)))
            step += 1
            hit = np.concatenate([t[0] for t in touched]) if touched else np.zeros(0, dtype=ids.dtype)
            unique, inverse = np.unique(hit, return_inverse=True)
            sparse = np.zeros((len(unique), SIZE), dtype=np.float32)
            if len(hit):
                back = np.concatenate([t[1] for t in touched])
                for k in range(SIZE):
                    sparse[:, k] = np.bincount(inverse, back[:, k], len(unique))
                sparse[~seen[unique]] = 0
                touches[unique] += np.bincount(inverse, minlength=len(unique))
            now = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, (v, a, b) in enumerate(zip(values, one, two, strict=True)):
                where, g = (unique, sparse / len(rows)) if k == 0 else (slice(None), grads[k - 1] / len(rows))
                a[where] = 0.9 * a[where] + 0.1 * g
                b[where] = 0.999 * b[where] + 0.001 * g * g
                v[where] -= now * a[where] / (np.sqrt(b[where]) + 1e-7)
    model.intercept = float(values[-1][0])
    return model, touches


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Of a few texts, in memory."""
    ids, first = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    within = [sum((_texts_with(t, np.array([0, len(t)])) for t, x in zip(texts, labels, strict=True) if x == y), np.zeros(BUCKETS, dtype=np.int64)) for y in (0, 1)]
    model, seen = start(within, [int((labels == y).sum()) for y in (0, 1)], seed)
    for n in range(ROUNDS):
        model, _ = learn(model, seen, ids, first, labels, np.random.default_rng([seed, n]), rate=RATE / (1 + n))
    return model


_SHARD = "shard bigint, first binary, ids binary, toxic binary, fold binary, lang array<string>"


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    """One row of a shard's texts as buckets, in an order that doesn't depend on how rows came in."""
    rows = rows.sort_by([("key", "ascending"), ("toxic", "ascending")])
    found, sizes = [], []
    for batch in pieces(iter(rows.to_batches()), "text"):
        ids, words = _buckets(batch.column("text"))
        found.append(ids.astype(np.uint16).tobytes())
        sizes.append(words.counts)
    first = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)
    small = {c: rows.column(c).to_numpy().astype(np.int8).tobytes() for c in ("toxic", "fold")}
    return pa.table({"shard": [key[0].as_py()], "first": [first.tobytes()], "ids": [b"".join(found)], "toxic": [small["toxic"]], "fold": [small["fold"]], "lang": [rows.column("lang").to_pylist()]}, schema=pa.schema([
        ("shard", pa.int64()), ("first", pa.binary()), ("ids", pa.binary()), ("toxic", pa.binary()), ("fold", pa.binary()), ("lang", pa.list_(pa.string()))]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Number, first, ids, toxic, fold and lang of each shard."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = [batch.column(c)[n] for c in ("shard", "first", "ids", "toxic", "fold")]
            first, ids, toxic, fold = (np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(row[1:], (np.int64, np.uint16, np.int8, np.int8), strict=True))
            yield row[0].as_py(), first, ids.reshape(-1, PARTS).astype(np.int32), toxic, fold, batch.column("lang")[n].as_py()


def _only(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)
    return ids[np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)], np.r_[0, np.cumsum(sizes[rows])]


#: Rows of a block of embeddings that travels by itself.
BLOCK = 1 << 10


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """rows: shard, part, x (floats). Of each part the sum over all shards, in their order; of the size of a model."""

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        rows, out = rows.sort_by("shard"), 0.0
        for x in rows.column("x"):
            out = out + np.frombuffer(x.as_buffer(), dtype=np.float32).astype(np.float64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([out.tobytes()], pa.binary())})

    return {r.part: np.frombuffer(r.x, dtype=np.float64) for r in rows.groupBy("part").applyInArrow(total, "part int, x binary").collect()}


def _parts(shard: int, parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([shard] * len(parts), pa.int64()), pa.array(list(parts), pa.int32()), pa.array([np.ascontiguousarray(x, dtype=np.float32).tobytes() for x in parts.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "x"])


_SENT = "shard bigint, part int, x binary"


def _cuts(logits: DataFrame) -> DataFrame:
    """logits: name, toxic, logit. Of each name the middle of the gap between logits that gives the best F1, and how many rows are toxic and clean."""
    bins = logits.groupBy("name", F.floor(F.greatest(F.lit(-MOST_LOGIT), F.least(F.lit(MOST_LOGIT), "logit")) / STEP).alias("bin"))
    bins = bins.agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"), F.min("logit").alias("low"), F.max("logit").alias("high"))
    down = Window.partitionBy("name").orderBy(F.desc("bin"))
    upto, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("name")
    rows = bins.select("name", "bin", "low", F.sum("hits").over(upto).alias("found"), F.sum("n").over(upto).alias("n"), F.sum("hits").over(whole).alias("toxic"), F.sum("n").over(whole).alias("all"), F.lead("high").over(down).alias("next"))
    rows = rows.withColumn("f1", 2 * F.col("found") / (F.col("n") + F.greatest("toxic", F.lit(1))))
    best = rows.groupBy("name").agg(F.max(F.struct("f1", "bin", "low", "next", "toxic", "all")).alias("b"))
    return best.select("name", ((F.col("b.low") + F.coalesce("b.next", F.col("b.low") - 2)) / 2).alias("cut"), F.col("b.toxic").alias("toxic"), (F.col("b.all") - F.col("b.toxic")).alias("clean"))


def train(docs: DataFrame, labels: DataFrame, most_bytes: int = MOST_BYTES, seed: int = 7) -> Model | None:
    """docs: doc_id, text, lang; labels: doc_id, toxic. None if a label is missing. most_bytes: text of a shard, about."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    # so that the texts of all documents aren't shuffled to meet the labels of some
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    rows = docs.select("doc_id", text.alias("text"), lang.alias("lang")).join(known, "doc_id")
    key = F.xxhash64("doc_id", "text")
    rows = rows.select(key.alias("key"), "text", "lang", "toxic", (F.pmod(key, F.lit(4)) == 0).cast("int").alias("fold"))
    sizes = {(r.toxic, r.fold): r for r in rows.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    counts = {y: [sizes[y, k].n if (y, k) in sizes else 0 for k in (0, 1)] for y in (0, 1)}
    if not all(map(sum, counts.values())):
        return None
    n_shards = max(1, min(sum(map(sum, counts.values())), -(-sum(r.size for r in sizes.values()) // most_bytes)))
    shards = cut(rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard")).applyInArrow(_shard, _SHARD), large_rows=True)

    def own(toxic: np.ndarray, fold: np.ndarray, part: int) -> np.ndarray:
        """The rows to learn from (part 0) or to calibrate by (1): those of that fold; of a label without any, all."""
        return np.flatnonzero((fold == part) | np.isin(toxic, [y for y in (0, 1) if not counts[y][part]]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, first, ids, toxic, fold, _ in _read(batches):
            rows = own(toxic, fold, 0)
            yield _parts(shard, {y: _texts_with(*_only(ids, first, rows[toxic[rows] == y])) for y in (0, 1)})

    within = _summed(shards.mapInArrow(count, _SENT))
    model, seen = start([within[y].astype(np.int64) for y in (0, 1)], [counts[y][0] or counts[y][1] for y in (0, 1)], seed)
    for n in range(ROUNDS):
        model = _round(shards, model, seen, own, n, seed)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, first, ids, toxic, fold, lang in _read(batches):
            rows = own(toxic, fold, 1)
            if len(rows):
                part, starts = _only(ids, first, rows)
                found = model.logits(part, starts) if starts[-1] else np.full(len(rows), model.intercept)
                columns = [pa.array([lang[r] for r in rows], pa.string()), pa.array(toxic[rows].astype(np.int32)), pa.array(np.asarray(found, dtype=np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "toxic", "logit"])

    check = cut(shards.mapInArrow(logits, "lang string, toxic int, logit double"))
    middle = _cuts(check.select(F.lit("").alias("name"), "toxic", "logit")).first().cut
    of = check.agg(F.avg(F.abs(F.col("logit") - middle)).alias("spread"), F.percentile_approx(F.when(F.col("toxic") == 0, F.col("logit")), 0.5, 100_000).alias("clean")).first()
    a = 4 / max(of.spread, 1e-6)
    model.blank = min(model.intercept, of.clean)
    model.scale = (a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * middle))
    for r in _cuts(check.select(F.col("lang").alias("name"), "toxic", "logit")).where("toxic >= 20 AND clean >= 20").orderBy("name").collect():
        model.thresholds[r.name] = float(model.scores(np.array([r.cut]))[0])
    return model


def _round(shards: DataFrame, model: Model, seen: np.ndarray, own, n: int, seed: int) -> Model:
    """The model after every shard has gone through its rows once more."""
    last = BUCKETS // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, first, ids, toxic, fold, _ in _read(batches):
            rows = own(toxic, fold, 0)
            if not len(rows):
                continue
            found, touches = learn(model, seen, *_only(ids, first, rows), toxic[rows].astype(np.float32), np.random.default_rng([seed, n, shard]), rate=RATE / (1 + n))
            changes = np.concatenate([(found.embedding - model.embedding) * touches[:, None], touches[:, None]], axis=1)
            parts = {k: changes[k * BLOCK : (k + 1) * BLOCK].reshape(-1) for k in range(last)}
            yield _parts(shard, parts | {last: np.r_[(_dense(found) - _dense(model)) * len(rows), len(rows)]})

    sums = _summed(shards.mapInArrow(run, _SENT))
    changes = np.concatenate([sums[k] for k in range(last)]).reshape(BUCKETS, SIZE + 1)
    embedding = model.embedding + changes[:, :SIZE] / np.maximum(changes[:, SIZE:], 1)
    return _with_dense(model, embedding.astype(np.float32), _dense(model) + sums[last][:-1] / sums[last][-1])


def score(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """docs with score, predicted (score >= 0.7) and flagged (score >= the language's threshold)."""
    made = ["score", "predicted", "flagged"]
    work = Carried(docs, made if keep_text else [*made, "text"], {"text": "text"} if keep_text else {}, text=F.col("text"), lang=F.col("lang"))
    names = ["own", *["text"] * keep_text, "lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, words = _buckets(batch.column("text"))
            if model is None:
                found = np.zeros(len(words.counts))
            else:
                found = model.scores(np.where(words.counts > 0, model.logits(ids, words.first), model.blank)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found)], names=[*names, "score"])

    out = work.rows.mapInArrow(run, work.schema(*names[1:], score=DoubleType()))
    bound = F.lit(THRESHOLD)
    for name, t in (model.thresholds if model else {}).items():
        bound = F.when(F.col("lang") == name, F.lit(t)).otherwise(bound)
    return work.back(out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= bound).alias("flagged"))
