"""Sessions as an append-only log of events, their children as tables partitioned by session, and citations.

Events: session_id, seq (bigint, rising within a session), event (created, step, failed, completed, deleted), step, detail, ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as T

EVENTS = "session_id string, seq bigint, event string, step string, detail string, ts timestamp"


def state(events: DataFrame) -> DataFrame:
    """Each session's status and last step. Completion is final, and steps and failures count while a session is processing only;
    deleted sessions are gone. Ends are pre-aggregated, so a long session is one row after the shuffle."""
    at = lambda e: F.min(F.when(F.col("event") == e, F.col("seq")))
    ends = events.groupBy("session_id").agg(
        at("completed").alias("done"), at("failed").alias("broke"), at("deleted").alias("gone"), F.min("ts").alias("created_at"), F.max(F.when(F.col("event") == "completed", F.col("ts"))).alias("completed_at"),
        F.max(F.when(F.col("event").isin("created", "step"), F.struct("seq", "step"))).alias("last"), F.min_by("detail", F.when(F.col("event") == "failed", F.col("seq"))).alias("error"),
    )
    finished = F.col("done").isNotNull()
    status = F.when(finished, F.lit("completed")).when(F.col("broke").isNotNull(), F.lit("failed")).otherwise(F.lit("processing"))
    return ends.where("gone IS NULL").select(
        "session_id", status.alias("status"), F.when(finished, F.lit("completed")).otherwise(F.col("last.step")).alias("last_step"), F.when(status == "failed", F.substring("error", 1, 1000)).alias("error_message"), "created_at", "completed_at"
    )


def recovered(events: DataFrame) -> DataFrame:
    """Failure events for the sessions that a restart interrupted."""
    last = events.groupBy("session_id").agg(F.max("seq").alias("seq"))
    open_ = state(events).where("status = 'processing'").join(last, "session_id")
    return open_.select("session_id", (F.col("seq") + 1).alias("seq"), F.lit("failed").alias("event"), F.lit("recovery").alias("step"), F.lit("startup_recovery_interrupted").alias("detail"), F.current_timestamp().alias("ts"))


def completed_sessions(events: DataFrame) -> DataFrame:
    return state(events).where("status = 'completed'").orderBy(F.coalesce("completed_at", "created_at").desc(), "session_id")


def write_children(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the sessions in rows and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def delete_children(spark: SparkSession, path: str, session_id: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={session_id}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def citations(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a citable thing: clauses, their changes, and chunks of both sides. results: session_id, clause_id, records, text_a, text_b."""
    c = F.col
    clause = results.select("session_id", F.lit("clause").alias("citation_type"), ids.stable_id("clause", c("session_id"), c("clause_id")).alias("citation_id"), "clause_id", F.lit(None).cast("string").alias("doc_side"), T.clip(F.concat_ws(" ", "text_a", "text_b")).alias("body"))
    exploded = results.select("session_id", "clause_id", F.posexplode("records").alias("n", "r"))
    inner = ids.stable_id("change", c("session_id"), c("clause_id"), c("n"), c("r.change_kind"), c("r.old"), c("r.new"))
    change = exploded.select("session_id", F.lit("change").alias("citation_type"), ids.stable_id("citation", c("session_id"), inner).alias("citation_id"), "clause_id", F.lit(None).cast("string").alias("doc_side"), T.clip(F.concat_ws(" ", "r.old", "r.new")).alias("body"))
    chunk = chunks.select("session_id", F.lit("chunk").alias("citation_type"), ids.stable_id("citation", c("session_id"), c("chunk_id")).alias("citation_id"), c("breadcrumb").alias("clause_id"), c("doc_label").alias("doc_side"), T.clip(c("content")).alias("body"))
    return clause.unionByName(change).unionByName(chunk)


def candidates(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """What questions are answered from: change, clause and chunk candidates with their search text and facets."""
    c, none = F.col, F.array().cast("array<string>")
    facet = lambda f: F.array_distinct(F.transform("records", lambda r: r[f]))
    clause = results.select(
        "session_id", F.lit("clause").alias("candidate_type"), "clause_id", ids.stable_id("clause", c("session_id"), c("clause_id")).alias("citation_id"), F.concat_ws(" ", "clause_id", "text_a", "text_b").alias("search_text"),
        F.lit(None).cast("string").alias("impact_level"), F.lit(None).cast("double").alias("confidence_score"), F.array_distinct(F.flatten(F.transform("records", lambda r: r["tags"]))).alias("c_tags"),
        F.array_distinct(F.concat(F.array("clause_change_kind"), facet("change_kind"))).alias("c_kinds"), facet("impact_level").alias("c_impacts"), facet("semantic_effect").alias("c_effects"), (c("ord") * 1000).alias("cand_ord"),
    )
    rows = results.select("session_id", "clause_id", "ord", F.posexplode("records").alias("n", "r"))
    inner = ids.stable_id("change", c("session_id"), c("clause_id"), c("n"), c("r.change_kind"), c("r.old"), c("r.new"))
    change = rows.select(
        "session_id", F.lit("change").alias("candidate_type"), "clause_id", ids.stable_id("citation", c("session_id"), inner).alias("citation_id"), F.concat_ws(" ", "clause_id", "r.old", "r.new", F.array_join("r.tags", " ")).alias("search_text"),
        c("r.impact_level").alias("impact_level"), c("r.confidence_score").alias("confidence_score"), c("r.tags").alias("c_tags"), F.array("r.change_kind").alias("c_kinds"), F.array("r.impact_level").alias("c_impacts"),
        F.array("r.semantic_effect").alias("c_effects"), (c("ord") * 1000 + c("n") + 1).alias("cand_ord"),
    )
    chunk = chunks.select(
        "session_id", F.lit("chunk").alias("candidate_type"), c("breadcrumb").alias("clause_id"), ids.stable_id("citation", c("session_id"), c("chunk_id")).alias("citation_id"), F.concat_ws(" ", "breadcrumb", "title", "content").alias("search_text"),
        F.lit(None).cast("string").alias("impact_level"), F.lit(None).cast("double").alias("confidence_score"), none.alias("c_tags"), none.alias("c_kinds"), none.alias("c_impacts"), none.alias("c_effects"), (c("raw_index") * 1000 + c("sub_index")).alias("cand_ord"),
    )
    return change.unionByName(clause).unionByName(chunk)


def messages_of(answers: DataFrame, seq: int = 0) -> DataFrame:
    """The two messages, of user and assistant, that an answered question adds."""
    user = answers.select("session_id", "question_id", F.lit("user").alias("role"), F.col("question").alias("content"), F.array().cast("array<string>").alias("citation_ids"), F.lit(None).cast("string").alias("answer_type"), F.lit(0).alias("part"))
    reply = answers.select("session_id", "question_id", F.lit("assistant").alias("role"), F.col("answer_markdown").alias("content"), F.array_distinct("citation_ids").alias("citation_ids"), "answer_type", F.lit(1).alias("part"))
    return user.unionByName(reply)


def cited(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Citations of messages (message_id, citation_ids) in the order in which they are named."""
    rows = messages.select("message_id", F.posexplode("citation_ids").alias("n", "citation_id"))
    return rows.join(known, "citation_id").orderBy("message_id", "n")


def nested(sessions: DataFrame, known: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their citations and messages as arrays."""
    c = known.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("citation_type", "citation_id"))).alias("citations"))
    m = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "role", "content"))).alias("messages"))
    return sessions.join(c, "session_id", "left").join(m, "session_id", "left")


def newest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rn", rank).where(F.col("rn") <= n)
