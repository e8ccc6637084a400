"""Annotated cases, each a folder of two versions and their annotated changes, from files to metrics in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.tables import cut
from palimpsest.operators import evaluate
from palimpsest.operators.retrieval import Embedder
from palimpsest.plans import compare
from palimpsest.rules import PRESETS, Settings
from palimpsest.sources import paragraphs

#: Names of a case's files.
VERSION_FILES, TRUTH_FILE = "*_v[12].docx", "ground_truth.json"


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """case_name, side, path, length, content of the versions of all cases under path that have both versions and annotations. Of several files of one side, the first by name counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", VERSION_FILES).load(path)
    folder = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)
    side = F.when(F.col("path").rlike(r"_v1\.[^./]+$"), F.lit("a")).otherwise(F.lit("b"))
    named = files.select(folder(F.col("path")).alias("case_name"), side.alias("side"), "path", "length")
    # names and sizes are chosen among before any content is read
    chosen = named.groupBy("case_name").agg(F.min(F.when(F.col("side") == "a", F.col("path"))).alias("a"), F.min(F.when(F.col("side") == "b", F.col("path"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    truth = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", TRUTH_FILE).load(path).select(folder(F.col("path")).alias("case_name")).distinct()
    pairs = chosen.join(truth, "case_name", "left_semi").select("case_name", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("a", "b"))).alias("side", "path"))
    return pairs.join(files.select("path", "length", "content"), "path").select("case_name", "side", "path", "length", "content")


def case_paragraphs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of case_files, the paragraphs of the first and of the second versions, with pair_id: what compare_versions takes."""

    def of(side: str, label: str) -> DataFrame:
        own = files.where(F.col("side") == side)
        # a document is known by its case, as cases may have files of one name
        own = own.select(F.concat_ws("/", F.lit(""), F.concat_ws("__", "case_name", F.regexp_extract("path", r"[^/]+$", 0))).alias("path"), "content")
        rows = paragraphs.docx_paragraphs(own, label)
        return rows.withColumn("pair_id", F.substring_index("doc_id", "__", 1))

    return of("a", "doc_A"), of("b", "doc_B")


def predicted_changes(results: DataFrame) -> DataFrame:
    """Clause results as what evaluate.pair_scores takes: a row a record, numbered within its case."""
    rows = results.select("pair_id", "ord", "clause_id", F.posexplode("records").alias("n", "r"))
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("ord", "n")) - 1
    fields = ("change_kind", "impact_level", "semantic_effect", "old", "new", "tags", "meta_tags")
    return rows.select(F.col("pair_id").alias("case_name"), number.alias("pred_ord"), "clause_id", F.lit("").alias("summary"), *[F.col(f"r.{c}").alias(c) for c in fields])


def _truth(spark: SparkSession, path: str) -> DataFrame:
    """The annotations of all cases: the files are told by their name, wherever they lie under path."""
    return paragraphs.ground_truth(spark, f"{path.rstrip('/')}/*/{TRUTH_FILE}")


def evaluate_cases(spark: SparkSession, path: str, settings: Settings = Settings(), embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """From a folder of cases: matches, metrics by case and over all, macro averages, and the guards of the reports."""
    truth = cut(_truth(spark, path))
    a, b = case_paragraphs(cut(case_files(spark, path)))
    found = compare.compare_versions(a, b, embedder, settings)
    predicted = cut(predicted_changes(found["results"]))
    matches = cut(evaluate.greedy_match(evaluate.pair_scores(predicted, truth)))
    metrics = cut(evaluate.case_metrics(matches, predicted, truth))
    return {"predicted": predicted, "matches": matches, "metrics": metrics, "macro": evaluate.macro(metrics), "guards": _guards(found["results"], predicted, truth, "own")}


def _guards(results: DataFrame, predicted: DataFrame, truth: DataFrame, preset: str) -> DataFrame:
    counts = predicted.groupBy("case_name").agg(F.count(F.lit(1)).alias("atomic_changes"))
    reports = evaluate.pseudo_report(results).select(F.col("pair_id").alias("case_name"), "report").join(counts, "case_name").withColumn("preset", F.lit(preset))
    return evaluate.guards(reports, truth)


def sweep_cases(spark: SparkSession, path: str, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """All cases under each preset of thresholds: guards by case and preset, and what evaluate.sweep makes of them. Files are read and parsed once; chunks, anchors and vectors don't depend on a preset."""
    truth = cut(_truth(spark, path))
    a, b = case_paragraphs(cut(case_files(spark, path)))
    prepared = compare.prepare(a, b, embedder)
    guards = None
    for name, settings in PRESETS.items():
        results = compare.compare_prepared(prepared, settings)["results"]
        own = cut(_guards(results, cut(predicted_changes(results)), truth, name))
        guards = own if guards is None else guards.unionByName(own)
    return guards, evaluate.sweep(guards)


def evaluation_markdown(metrics: DataFrame) -> DataFrame:
    """Metrics by case (a null case_name is all together) as lines of a Markdown table, in order: value."""
    share = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    cells = [F.coalesce("case_name", F.lit("Micro")), *[F.col(c).cast("string") for c in ("tp", "fp", "fn")], *[share(c) for c in ("precision", "recall", "f1")]]
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    rows = metrics.select(F.when(F.col("case_name").isNull(), 3).otherwise(2).alias("part"), F.coalesce("case_name", F.lit("")).alias("name"), line(cells).alias("value"))
    head = ["Case", "TP", "FP", "FN", "Precision", "Recall", "F1"]
    fixed = metrics.sparkSession.createDataFrame([(0, "", f"| {' | '.join(head)} |"), (1, "", "|---|" + "---:|" * 6)], "part int, name string, value string")
    return fixed.unionByName(rows).orderBy("part", "name").select("value")


def level_histograms(chunks: DataFrame) -> DataFrame:
    """How many chunks of each document lie under each part and each chapter, and how many are sub-chunks: doc_label, level (top, mid, sub), name, chunks."""
    named = lambda level, c: F.struct(F.lit(level).alias("level"), T.text(c).alias("name"))
    levels = F.array(named("top", F.col("top_level")), named("mid", F.col("mid_level")), F.when(F.col("sub_index") > 0, named("sub", F.lit(""))))
    rows = chunks.select("doc_label", F.explode(F.array_compact(levels)).alias("l"))
    return rows.groupBy("doc_label", "l.level", "l.name").agg(F.count(F.lit(1)).alias("chunks"))
