"""A training corpus from raw documents: quality classifier, line dedup, near-dedup, substring dedup, packing.

Each stage takes the documents its predecessor kept. The first four return the columns of documents: rejected documents and near
copies go, and recurring lines and repeated passages go from the texts (n_chars follows). The last returns where each piece of a document
lies in which sequence. Between stages, documents are written as Parquet in the folder the executors share and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.tables import scratch
from palimpsest.llm import families, importance, line_templates, minhash, packing, substring_dedup
from palimpsest.llm.queries import vocabulary
from palimpsest.llm.shared import Carried, cut, quoted, row_key, small, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of a batch that goes to Python: texts are long, and a batch lies in memory several times on its way.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """For the session, as a stage's result is computed after the stage has returned."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _through(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that stage leaves, with docs' columns; n_chars, where docs have it, is the length of what the text is now. The stage
    sees doc_id and text only, so no other column's name can meet one that it makes."""
    _small_batches(docs.sparkSession)
    work = Carried(docs, [], {"doc_id": "doc_id", "text": "text"}, doc_id=F.col("doc_id"), text=F.col("text"))
    rows = work.back(stage(work.rows))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[quoted(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _through(docs, lambda rows: importance.resample(rows, table(spark, sf_dir, "labels")).where("kept"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies count as one document here, as exact copies do: what only they share is content, not boilerplate, and the next stage keeps one of them."""
    with scratch(spark) as keep:
        named = cut(families.near_families(_keyed(docs)).distinct())
        several = named.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        together = keep(named.join(several, "component_id").select("row", F.xxhash64(F.lit("family"), "component_id").alias("family")))
    return _through(docs, lambda rows: line_templates.drop_recurring_lines(rows, families=together))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    with scratch(spark) as keep:
        gone = keep(minhash.near_duplicates(_keyed(docs)).where(~F.col("kept")).select("row").distinct())
    return _through(docs, lambda rows: rows.withColumn("row", row_key(F.col("doc_id"), F.col("text"))).join(small(gone), "row", "left_anti"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _through(docs, substring_dedup.remove_repeats)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("substring_dedup", passages),
    ("best_fit_packing", pack),
]

#: Resampling, components of estimated candidates and tokenisation have no SQL; tests check the stages' rows and columns, and each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
