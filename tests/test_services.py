import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chat, evaluate, retrieval, sessions
from palimpsest.streaming import jobs

CANDIDATE = (
    "session_id string, candidate_type string, clause_id string, citation_id string, search_text string, impact_level string, confidence_score double, c_tags array<string>, c_kinds array<string>, c_impacts array<string>, c_effects array<string>, cand_ord int"
)


def ask(spark, question):
    rows = [
        ("s", "change", "Điều 5", "c1", "Điều 5 thời hạn 30 ngày thành 45 ngày Thời hạn", "substantive", 0.9, ["Thời hạn"], ["MODIFIED"], ["substantive"], ["SUBSTANTIVE"], 1),
        ("s", "change", "Điều 7", "c2", "Điều 7 bảo mật dữ liệu sửa định dạng", "formal", 0.9, ["Định dạng"], ["MODIFIED"], ["formal"], ["FORMAL"], 2),
        ("s", "chunk", "Điều 7", "k1", "Điều 7 Bên B bảo mật dữ liệu khách hàng", None, None, [], [], [], [], 3),
    ]
    questions = spark.createDataFrame([("q", "s", question)], "question_id string, session_id string, question string")
    planned = chat.plan(questions)
    return planned.first(), chat.answer(planned, chat.evidence(planned, spark.createDataFrame(rows, CANDIDATE))).first()


def test_summary_cites_all_in_order(spark):
    plan, answer = ask(spark, "Những chi tiết đã được sửa ở bản v2 là gì, tóm tắt giúp")
    assert answer.answer_type == "diff_answer" and set(answer.citation_ids) == {"c1", "c2"}
    assert plan.intent in ("diff_summary", "filtered_change_query")


@pytest.mark.parametrize("question", ["Có thay đổi nào về thời hạn không?", "Co thay doi nao ve thoi han khong?"])
def test_filters_by_tag(spark, question):
    plan, answer = ask(spark, question)
    assert plan.tags == ["Thời hạn"] and answer.citation_ids == ["c1"]


def test_document_question(spark):
    plan, answer = ask(spark, "Điều 7 bản mới nói gì?")
    assert answer.answer_type == "document_answer" and "k1" in answer.citation_ids


def test_off_subject(spark):
    _, answer = ask(spark, "Thời tiết hôm nay thế nào?")
    assert answer.answer_type == "insufficient_evidence" and answer.citation_ids == []


def test_metadata():
    found = retrieval.sanitized(pd.Series([{"a": [None, None], "b": [1, "2", True], "c": None, "d": [1, 2.5], "e": {"x": 1}}]))[0]
    assert found == {"b": ["1", "2", "True"], "d": [1.0, 2.5], "e": json.dumps({"x": 1})}


def test_embedding_cache(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, content string")
    made, fresh = retrieval.embed(rows, retrieval.HashingEmbedder(8))
    assert fresh.count() == 2 and made.where("vec is null").count() == 0
    _, again = retrieval.embed(rows, retrieval.HashingEmbedder(8), cache=fresh)
    assert again.count() == 0


def test_sessions(spark):
    rows = [("a", 1, "created", "ingestion"), ("a", 2, "step", "chunking"), ("a", 3, "completed", None), ("a", 4, "failed", "x"), ("b", 1, "created", "ingestion"), ("c", 1, "created", "ingestion"), ("c", 2, "deleted", None)]
    log = spark.createDataFrame([(s, n, e, st, "boom" if e == "failed" else None, None) for s, n, e, st in rows], sessions.EVENTS)
    state = {r.session_id: (r.status, r.last_step) for r in sessions.state(log).collect()}
    assert state == {"a": ("completed", "completed"), "b": ("processing", "ingestion")}
    after = log.unionByName(sessions.recovered(log))
    assert {r.session_id: r.status for r in sessions.state(after).collect()} == {"a": "completed", "b": "failed"}
    assert [r.session_id for r in sessions.completed_sessions(after).collect()] == ["a"]


def test_greedy_matching_and_metrics(spark):
    scores = spark.createDataFrame([("k", 0, 0, 0.9), ("k", 0, 1, 0.8), ("k", 1, 0, 0.85), ("k", 2, 1, 0.05)], "case_name string, pred_ord int, gt_ord int, score double")
    found = evaluate.greedy_match(scores)
    assert [(r.pred_ord, r.gt_ord) for r in found.collect()] == [(0, 0)]
    side = lambda n, c: spark.createDataFrame([("k", i) for i in range(n)], f"case_name string, {c} int")
    m = {r.case_name: r for r in evaluate.case_metrics(found, side(3, "pred_ord"), side(2, "gt_ord")).collect()}
    assert (m["k"].tp, m["k"].fp, m["k"].fn, m["k"].precision, m["k"].recall) == (1, 2, 1, 0.3333, 0.5) and m[None].f1 == 0.4


def test_guards(spark):
    truth = spark.createDataFrame([("k", "Numerical", "Điều 5", "30 ngày", "45 ngày")], "case_name string, type string, location string, v1_content string, v2_content string")
    report = spark.createDataFrame([("k", "balanced", "Điều 5: 30 thành 60", 1)], "case_name string, preset string, report string, atomic_changes int")
    r = evaluate.guards(report, truth).first()
    assert (r.clause_recall, r.number_recall, r.volume_alignment) == (1.0, 0.5, 1.0)
    kinds = truth.select(evaluate.bucket(F.col("type")).alias("b")).first().b
    assert kinds == "Lexical"


def test_pair_scores(spark):
    predicted = spark.createDataFrame([("k", 0, "Điều 5", "Điều 5 sửa", "MODIFIED", "substantive", "SUBSTANTIVE", "30 ngày", "45 ngày", ["Số liệu"], [])], "case_name string, pred_ord int, clause_id string, summary string, change_kind string, impact_level string, semantic_effect string, old string, new string, tags array<string>, meta_tags array<string>")
    truth = spark.createDataFrame([("k", 0, "Numerical", "Điều 5", "30 ngày", "45 ngày"), ("k", 1, "Typo", "Phụ lục B", "xyz", "xzy")], "case_name string, gt_ord int, type string, location string, v1_content string, v2_content string")
    scores = {r.gt_ord: r.score for r in evaluate.pair_scores(predicted, truth).collect()}
    assert scores[0] > 0.5 > scores[1]


def test_streaming_windows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "e", 1.0) for i in range(9)], "id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.progress_counts(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("progress").agg(F.sum("n")).first()[0] == 9
