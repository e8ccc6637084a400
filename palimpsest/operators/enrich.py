"""What a language model may add to a comparison, and what of it is believed.

A model is a callable from a system and a user prompt to a text; it is optional. Calls are made where rows lie, `at_once` tasks at a time,
are tried twice, and leave null behind when they fail, so a comparison never depends on them. results: clause results (pair_id, ord, clause_id,
clause_change_kind, text_a, text_b, records) with summary (see report.summary_line).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as T
from palimpsest.operators import report

Model = Callable[[str, str], str]

CLAUSE_SYSTEM = "Summarise what changed in one clause of a contract. Use the given evidence only. Answer with JSON: clause_id, comparison_summary, important_changes, review_points."
SEMANTIC_SYSTEM = "Say whether one change of wording changes the meaning of a contract. Answer with JSON: semantic_effect (SUBSTANTIVE or LEXICAL_EQUIVALENT), factual_summary."
EXECUTIVE_SYSTEM = "Summarise a comparison of two contracts. Name no numbers. Answer with JSON: overview, key_points, review_alerts."
JUDGE_SYSTEM = "Say how well a report matches the annotated changes. Answer with JSON: score (0 to 10), notes."

CLAUSE_ANSWER = "clause_id string, comparison_summary string, important_changes array<string>, review_points array<string>"
SEMANTIC_ANSWER = "semantic_effect string, factual_summary string"
EXECUTIVE_ANSWER = "overview string, key_points array<string>, review_alerts array<string>"


def ask(rows: DataFrame, keys: list[str], model: Model, system: str, prompt: Column, at_once: int = 4, tries: int = 2, wait: float = 1.0) -> DataFrame:
    """keys and raw, the model's answer to each row's prompt; null where it fails."""
    asked = rows.select(*keys, prompt.alias("prompt"))

    def answered(text: str) -> str | None:
        for n in range(tries):
            try:
                return model(system, text)
            except Exception:  # the model is another service: whatever it raises, the row goes without it
                time.sleep(wait * 2**n if n + 1 < tries else 0)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keys].assign(raw=[answered(p) for p in pdf["prompt"]])

    schema = ", ".join([*[f"`{k}` {asked.schema[k].dataType.simpleString()}" for k in keys], "raw string"])
    return asked.repartition(at_once).mapInPandas(run, schema)


def semantic_candidates(results: DataFrame) -> DataFrame:
    """Substantive records that need a review: pair_id, ord, clause_id, rec_ord, record."""
    rows = results.select("pair_id", "ord", "clause_id", F.posexplode("records").alias("rec_ord", "record"))
    return rows.where("record.impact_level = 'substantive' AND record.review_status = 'REVIEW_NEEDED'")


def worth_asking(results: DataFrame) -> DataFrame:
    """Clauses that were added, deleted or replaced, or have a substantive record; what changed in form only is left to the rules."""
    substantive = F.exists("records", lambda r: r["impact_level"] == "substantive")
    return results.where(F.col("clause_change_kind").isin("REPLACED", "ADDED", "DELETED") | substantive)


def low_confidence(results: DataFrame) -> DataFrame:
    """Records of a low band, in order: pair_id, ord, clause_id, rec_ord, record."""
    rows = results.select("pair_id", "ord", "clause_id", F.posexplode("records").alias("rec_ord", "record"))
    return rows.where(F.col("record.confidence_band").isin("LOW", "SUSPECT"))


def top_substantive(results: DataFrame, most: int = 5) -> DataFrame:
    """The substantive records of the highest confidence of each pair; the first on ties."""
    rows = results.select("pair_id", "ord", "clause_id", "summary", F.posexplode("records").alias("rec_ord", "record")).where("record.impact_level = 'substantive'")
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("record.confidence_score").desc(), "ord", "rec_ord"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def clause_prompt() -> Column:
    return F.to_json(F.struct("clause_id", "clause_change_kind", "summary", F.array_sort(F.array_distinct(F.flatten(F.transform("records", lambda r: r["tags"])))).alias("tags"), F.col("records").alias("evidence")))


def semantic_prompt() -> Column:
    return F.to_json(F.struct("clause_id", "record"))


def executive_prompts(results: DataFrame, stats: DataFrame) -> DataFrame:
    best = top_substantive(results).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "clause_id", "record"))), lambda x: F.struct(x["clause_id"], x["record"])).alias("changes"))
    return stats.join(best, "pair_id", "left").select("pair_id", F.to_json(F.struct(F.struct(*[F.col(c) for c in report.COUNTERS]).alias("statistics"), "changes")).alias("prompt"))


def _parsed(raw: Column, schema: str) -> Column:
    return F.from_json(ids.json_object(raw), schema)


def clause_analysis(results: DataFrame, raw: DataFrame) -> DataFrame:
    """results with analysis (summary, important_changes, review_points). raw: pair_id, ord, raw. An answer on another clause isn't used; a
    summary must say more than the rules' own; lists lose what is said already."""
    rows = results.join(raw.select("pair_id", "ord", _parsed(F.col("raw"), CLAUSE_ANSWER).alias("answer")), ["pair_id", "ord"], "left")
    named = T.sanitize(F.col("answer.clause_id"), 180)
    rows = rows.withColumn("answer", F.when((named == "") | (named == F.col("clause_id")), F.col("answer")))
    said = T.sanitize(F.col("answer.comparison_summary"), 360)
    rows = rows.withColumn("_said", said)
    good = (F.col("_said") != "") & ~T.is_generic_summary(F.col("_said")) & (T.dedupe_ratio(F.col("_said"), F.col("summary")) < 0.8)
    rows = rows.withColumn("_summary", F.when(good, F.col("_said")).otherwise(F.col("summary")))
    known = F.array("_summary", "summary")
    changes = T.distinct_texts(T.sanitize_list(F.col("answer.important_changes"), 6), known, F.least(F.lit(3), F.greatest(F.size("records"), F.lit(1))))
    rows = rows.withColumn("_changes", changes)
    points = T.distinct_texts(T.sanitize_list(F.col("answer.review_points"), 4), F.concat(known, "_changes"), 2)
    rows = rows.withColumn("_points", points)
    made = F.struct(F.col("_summary").alias("summary"), F.col("_changes").alias("important_changes"), F.col("_points").alias("review_points"))
    return rows.withColumn("analysis", made).drop("answer", "_said", "_summary", "_changes", "_points")


def executive_summary(results: DataFrame, alerts: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """pair_id, overview, key_points, evidence (clauses of each point), review_alerts. raw: pair_id, raw. Claims with numbers go; points need
    support in the 12 surest substantive changes; anomalies (pair_id, n, alert) and up to three records of low confidence are added."""
    pairs = results.select("pair_id").distinct()
    rows = pairs.withColumn("raw", F.lit(None).cast("string")) if raw is None else pairs.join(raw.select("pair_id", "raw"), "pair_id", "left")
    rows = rows.withColumn("answer", _parsed(F.col("raw"), EXECUTIVE_ANSWER))
    overview = T.sanitize(F.col("answer.overview"), 400)
    rows = rows.withColumn("overview", F.when(T.has_number(overview), F.lit("")).otherwise(overview))
    clean = lambda c, most: F.filter(T.sanitize_list(F.col(c), most), lambda x: ~T.has_number(x))
    rows = rows.withColumn("points", T.distinct_texts(clean("answer.key_points", 4), F.array("overview"), 4))
    rows = rows.withColumn("told", T.distinct_texts(clean("answer.review_alerts", 3), F.concat(F.array("overview"), "points"), 3))
    support = top_substantive(results, 12).select("pair_id", F.col("rank").alias("ord"), "clause_id", "summary", "record.tags", "record.old", "record.new")
    grounded = report.grounded_points(rows.select("pair_id", F.posexplode("points").alias("n", "point")), support)
    kept = grounded.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("n", "point", "clauses"))).alias("kept"))
    odd = alerts.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alert"))), lambda x: x["alert"]).alias("odd"))
    line = F.format_string("%s: %s (%.2f)", "clause_id", "record.confidence_band", "record.confidence_score")
    low = low_confidence(results).groupBy("pair_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "rec_ord", line.alias("line")))), 1, 3).alias("low"))
    rows = rows.join(kept, "pair_id", "left").join(odd, "pair_id", "left").join(low, "pair_id", "left")
    none = F.array().cast("array<string>")
    listed = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f]), none)
    return rows.select(
        "pair_id", "overview", listed("kept", "point").alias("key_points"), F.transform("kept", lambda x: x["clauses"]).alias("evidence"),
        F.array_distinct(F.concat("told", F.coalesce("odd", none), listed("low", "line"))).alias("review_alerts"),
    )


FORMAL_NOTE = "Các thay đổi chỉ mang tính hình thức trình bày, không làm thay đổi nội dung pháp lý."


def analyse(results: DataFrame, stats: DataFrame, alerts: DataFrame, model: Model, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """Results with the records' guarded effect, analysis and notes, and the executive summaries, all with the model's answers."""
    candidates = semantic_candidates(results)
    adjudged = ask(candidates, ["pair_id", "ord", "rec_ord"], model, SEMANTIC_SYSTEM, semantic_prompt(), at_once)
    judged = candidates.join(adjudged.select("pair_id", "ord", "rec_ord", _parsed(F.col("raw"), SEMANTIC_ANSWER).alias("answer")), ["pair_id", "ord", "rec_ord"]).withColumn("raw_effect", F.col("answer.semantic_effect"))
    effects = report.guarded_effect(judged).groupBy("pair_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("rec_ord", "effect"))).alias("effects"))
    rows = results.join(effects, ["pair_id", "ord"], "left")
    rows = rows.withColumn("records", F.transform("records", lambda r, i: r.withField("semantic_effect", F.coalesce(F.col("effects")[i], r["semantic_effect"])))).drop("effects")
    raw = ask(worth_asking(rows), ["pair_id", "ord"], model, CLAUSE_SYSTEM, clause_prompt(), at_once)
    rows = clause_analysis(rows, raw)
    formal = (F.col("clause_change_kind") == "MODIFIED") & F.forall("records", lambda r: r["impact_level"] == "formal")
    rows = rows.withColumn("notes", F.when(formal, F.lit(FORMAL_NOTE)).otherwise(F.col("analysis.summary")))
    told = executive_prompts(rows, stats)
    return rows, executive_summary(rows, alerts, ask(told, ["pair_id"], model, EXECUTIVE_SYSTEM, F.col("prompt"), at_once))


def judged(reports: DataFrame, model: Model, at_once: int = 4) -> DataFrame:
    """reports: case_name, report_markdown, ground_truth. case_name, score (0 to 10, null without an answer) and notes."""
    prompt = F.to_json(F.struct("ground_truth", "report_markdown"))
    answer = _parsed(F.col("raw"), "score double, notes string")
    rows = ask(reports, ["case_name"], model, JUDGE_SYSTEM, prompt, at_once).withColumn("answer", answer)
    missing = F.when(F.col("raw").isNull(), F.lit("unavailable")).when(F.col("answer.score").isNull() & F.col("answer.notes").isNull(), F.lit("no JSON"))
    return rows.select("case_name", F.greatest(F.lit(0.0), F.least(F.lit(10.0), "answer.score")).alias("score"), F.coalesce(missing, F.col("answer.notes")).alias("notes"))
