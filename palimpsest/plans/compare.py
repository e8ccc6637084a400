"""Plans of several operators: two versions of documents to changes, statistics and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.tables import batches_of, cut, small
from palimpsest.operators import align, changes, chunks, report, retrieval
from palimpsest.rules import Settings


#: A version shares 80 % of the distinct shingles of five words. Two such sets share none of the bands with probability (1 - 0.8**4)**32 = 5e-8.
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 32, 4

_FACTORS = np.random.default_rng(20240301).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(docs: DataFrame) -> DataFrame:
    """doc_id and the hashes of the text's distinct shingles; a text of fewer words has one shingle, all its words, and one without words none."""
    words = docs.select("doc_id", F.array_remove(F.split(F.lower("text"), r"\s+"), "").alias("w")).where("doc_id IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1)))
    return words.select("doc_id", F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, SHINGLE))))).alias("grams"))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each set, its size, and a hash for each band of ROWS minima."""
    weights = _FACTORS[:ROWS, 0][None, :]
    for batch in batches:
        grams = batch.column("grams")
        flat, ends = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
        digests, keys = [], np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            x = flat[a:b]
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            mixed = x[None, :] * _FACTORS
            minima = (mixed ^ (mixed >> np.uint64(32))).min(axis=1).reshape(BANDS, ROWS)
            key = ((minima ^ (minima >> np.uint64(29))) * weights).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)
            keys[n] = (key ^ (key >> np.uint64(31))) * _FACTORS[-1, 0]
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * batch.num_rows + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).reshape(-1)))
        columns = [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(np.diff(ends).astype(np.int64)), bands]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set", "size", "bands"])


def near_copies(docs: DataFrame) -> DataFrame:
    """Each document (doc_b) that is a near copy of an earlier one (doc_a). docs: doc_id (unique) and text.

    Documents with one set of shingles are one class, named by its first document. Classes that share a band are candidates: first each with the
    first class of its bands; only those that found no near copy so are tried with all earlier classes of their bands. Whole sets decide. So a
    large group of near copies costs its size; what grows faster is only a large group that shares bands but is not alike."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    grams = _shingles(docs)
    rows = cut(grams.mapInArrow(_sketches, f"doc_id {id_type}, set binary, size bigint, bands array<bigint>"))
    classes = cut(rows.groupBy("set").agg(F.min("doc_id").alias("v"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = cut(classes.select("v", "size", F.explode("bands").alias("key")))
    hubs = banded.groupBy("key").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = cut(banded.join(hubs, "key"))
    near = cut(members.select("v").distinct())
    sets = cut(_shingles(docs.join(small(near).select(F.col("v").alias("doc_id")), "doc_id", "left_semi")).select(F.col("doc_id").alias("v"), "grams"))
    sizes = classes.select("v", "size")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("v").alias("b"), F.col("grams").alias("y")), "b")
        both = one.join(sets.select(F.col("v").alias("a"), F.col("grams").alias("x")), "a")
        common = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
        return cut(common.where(100 * F.col("common") >= PERCENT * (F.col("m") + F.col("n") - F.col("common"))).select("a", "b"))

    # sets of too different sizes can't be near copies
    fits = 100 * F.least("size", "size_a") >= PERCENT * F.greatest("size", "size_a")
    first = members.where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b"), "size").distinct()
    found = confirmed(cut(first.join(sizes.select(F.col("v").alias("a"), F.col("size").alias("size_a")), "a").where(fits).select("a", "b")))
    left = members.where("v <> hub").join(found.select(F.col("b").alias("v")), "v", "left_anti").select("key", F.col("v").alias("b"), "size")
    every = members.where("v <> hub").select("key", F.col("v").alias("a"), F.col("size").alias("size_a"))
    found = found.union(confirmed(cut(left.join(every, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct())))
    partner = found.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("a"))
    named = classes.select("set", "v").join(partner, "v", "left").select("set", F.coalesce("a", "v").alias("doc_a"))
    return cut(rows.select(F.col("doc_id").alias("doc_b"), "set").join(named, "set").where("doc_a <> doc_b").select("doc_a", "doc_b"))


def version_pairs(docs: DataFrame) -> DataFrame:
    """Each document with the first earlier document found that is its near copy, as versions a and b."""
    links = near_copies(docs)
    side = lambda s: docs.select(F.col("doc_id").alias(f"doc_{s}"), F.col("text").alias(f"text_{s}"))
    # texts that no pair has needn't be shuffled
    first = small(cut(links.select("doc_a").distinct()))
    both = side("b").join(small(links), "doc_b").join(side("a").join(first, "doc_a", "left_semi"), "doc_a")
    return both.select(F.concat_ws("-", "doc_a", "doc_b").alias("pair_id"), "doc_a", "doc_b", "text_a", "text_b")


def compare_lines(pairs: DataFrame) -> DataFrame:
    """Lines of both versions aligned on their plain form; a row for each run of lines with its match type."""
    lined = pairs.select("pair_id", T.lines(F.col("text_a")).alias("x"), T.lines(F.col("text_b")).alias("y"))
    keyed = lined.select("pair_id", F.transform("x", T.plain).alias("a"), F.transform("y", T.plain).alias("b"))
    codes = align.line_opcodes(keyed)
    kinds = {"equal": "UNCHANGED", "replace": "REPLACED", "delete": "DELETED", "insert": "ADDED"}
    kind = F.lit(None).cast("string")
    for tag, name in kinds.items():
        kind = F.when(F.col("tag") == tag, F.lit(name)).otherwise(kind)
    return codes.withColumn("match_type", kind)


def line_statistics(runs: DataFrame) -> DataFrame:
    of = lambda k: F.sum(F.when(F.col("match_type") == k, F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))).otherwise(0)).alias(k.lower())
    return runs.groupBy("pair_id").agg(of("UNCHANGED"), of("REPLACED"), of("DELETED"), of("ADDED"))


def _chunked(paragraphs: DataFrame, settings: Settings) -> DataFrame:
    # chunks know their document; a pair names one document of either side
    pair_of = paragraphs.select("pair_id", "doc_id").distinct()
    made = chunks.with_ids(chunks.sub_chunks(chunks.sectionize(paragraphs.drop("pair_id")), settings.max_chunk)).join(pair_of, "doc_id")
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("raw_index", "sub_index")) - 1
    return cut(made.withColumns({"i": place, "key": T.anchor_form(F.col("content")), "clause": T.anchor_form(F.coalesce("breadcrumb", "title"))}))


def prepare(a: DataFrame, b: DataFrame, embedder: retrieval.Embedder | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """a, b: paragraphs with pair_id. What no threshold changes: the chunks of either side, with vectors where a gap asks for them, and the runs between anchors.

    What several later steps read is written once, so no step's plan repeats those before it. Only chunks between anchors are embedded."""
    embedder = embedder or retrieval.HashingEmbedder()
    made = {name: _chunked(paragraphs, settings) for name, paragraphs in (("a", a), ("b", b))}
    runs = cut(align.runs(made["a"], made["b"]))
    asked = align.in_gaps(runs)
    sides = {"runs": runs}
    for name, rows in made.items():
        own = asked.where(F.col("side") == name).select("pair_id", "i")
        vectors = retrieval.embed(rows.join(own, ["pair_id", "i"], "left_semi").select("pair_id", "i", "content"), embedder, batch=settings.embed_batch)[0]
        sides[name] = cut(rows.join(vectors.select("pair_id", "i", "vec"), ["pair_id", "i"], "left"))
    return sides


def compare_versions(a: DataFrame, b: DataFrame, embedder: retrieval.Embedder | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """a, b: paragraphs with pair_id. Chunks, pairs, clauses, results, statistics and reports of all pairs."""
    return compare_prepared(prepare(a, b, embedder, settings), settings)


def compare_prepared(prepared: dict[str, DataFrame], settings: Settings = Settings()) -> dict[str, DataFrame]:
    """What compare_versions returns, from what prepare has made; settings may differ in thresholds."""
    x, y, runs = prepared["a"], prepared["b"], prepared["runs"]
    aligned = cut(align.align(x, y, settings, runs))
    side = lambda df, i, s: df.select("pair_id", F.col("i").alias(i), F.col("content").alias(f"text_{s}"), F.col("breadcrumb").alias(f"clause_{s}"), chunks.source_ref(F.col("doc_label")).alias(f"source_{s}"))
    rows = aligned.join(side(x, "i", "a"), ["pair_id", "i"], "left").join(side(y, "j", "b"), ["pair_id", "j"], "left")
    rows = cut(rows.withColumn("ratio", T.text_ratio(F.col("text_a"), F.col("text_b"))))
    rows = align.classify(rows, settings)
    rows = rows.withColumns({"ord": F.col("pair_ord") * 2 + F.col("part"), "clause_id": F.when(F.col("match_type") == "ADDED", F.col("clause_b")).otherwise(F.coalesce("clause_a", "clause_b"))})
    clauses = cut(changes.collapse(rows.select("pair_id", "ord", "match_type", "clause_id", "text_a", "text_b", "similarity", "near_threshold", "source_a", "source_b")))
    results = cut(changes.clause_results(clauses, cut(changes.change_records(clauses))))
    stats = cut(changes.statistics(clauses, results))
    return {"chunks_a": x, "chunks_b": y, "clauses": clauses, "results": results, "statistics": stats, "report": report.report(results, stats)}
