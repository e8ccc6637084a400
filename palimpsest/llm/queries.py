"""Queries of the training-data operators, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bloom_cascade, bpe, importance, line_templates, minhash, nbest, packing, phrases, product_codes, quality_rules, sketch, substring_dedup, toxicity
from palimpsest.llm.shared import cut, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=False)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep_text=False)


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    part = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(3))
    model = toxicity.train(docs, labels.where(part(F.col("doc_id")) != 1))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", F.coalesce(part(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "flagged")


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = product_codes.vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = product_codes.fit(given)
    rows = product_codes.with_group_error(cut(product_codes.encode(given, books)))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path, keep_ids=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_nbest": op3_nbest,
    "op4_importance": op4_importance,
    "op5_bloom_cascade": op5_bloom_cascade,
    "op6_toxicity": op6_toxicity,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_sketch": op8_sketch,
    "op9_minhash": op9_minhash,
    "op10_line_templates": op10_line_templates,
    "op11_phrases": op11_phrases,
    "op12_product_codes": op12_product_codes,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op5_bloom_cascade": bloom_cascade.ORACLE_SQL,
    "op9_minhash": minhash.ORACLE_SQL,
    "op10_line_templates": line_templates.ORACLE_SQL,
    "op11_phrases": phrases.ORACLE_SQL,
    "op12_product_codes": product_codes.ORACLE_SQL,
}
