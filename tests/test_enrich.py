"""What a language model adds, what of it is dropped, and the checks around it."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest import rules
from palimpsest.functions import text as T
from palimpsest.operators import changes, enrich, evaluate, report

RESULTS = f"pair_id string, ord int, clause_id string, clause_change_kind string, text_a string, text_b string, similarity double, summary string, records array<{changes.RECORD}>"


def record(kind="MODIFIED", level="substantive", status="AUTO", score=0.9, band="HIGH", tags=("Số liệu",), old="30 ngày", new="45 ngày"):
    return (kind, level, "SUBSTANTIVE" if level == "substantive" else "FORMAL", status, list(tags), [], score, band, old, new, [])


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("p", 0, "Điều 1", "MODIFIED", "a", "b", 0.9, "Điều 1 có 1 thay đổi thực chất", [record(), record(score=0.4, band="LOW", status="REVIEW_NEEDED", tags=["Ngôn ngữ chuyên môn"], old="bên bán", new="người bán")]),
        ("p", 1, "Điều 2", "MODIFIED", "a", "b", 0.9, "Điều 2 đổi hình thức", [record(level="formal", tags=["Định dạng"])]),
        ("p", 2, "Điều 3", "ADDED", None, "b", 0.0, "Điều 3 được thêm", [record(kind="ADDED", score=0.95, new="bảo mật dữ liệu khách hàng")]),
        ("q", 0, "Điều 1", "MODIFIED", "a", "b", 0.9, "Điều 1 đổi hình thức", [record(level="formal", tags=["Định dạng"])]),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_distinct_texts(spark):
    rows = spark.createDataFrame([(["Bên A trả tiền.", "bên a trả tiền", "Bên B giao hàng đúng hạn", "", None, "Bên B giao hàng đúng hạn!", "Khác hẳn"], ["Khác  HẲN"])], "items array<string>, known array<string>")
    assert rows.select(T.distinct_texts(F.col("items"), F.col("known"))).first()[0] == ["Bên A trả tiền.", "Bên B giao hàng đúng hạn"]
    assert rows.select(T.distinct_texts(F.col("items"), most=1)).first()[0] == ["Bên A trả tiền."]
    assert rows.select(T.distinct_texts(F.lit(None).cast("array<string>"))).first()[0] == []


def test_which_clauses_and_records_are_asked(results):
    assert {(r.pair_id, r.ord) for r in enrich.worth_asking(results).collect()} == {("p", 0), ("p", 2)}
    assert [(r.ord, r.rec_ord) for r in enrich.semantic_candidates(results).collect()] == [(0, 1)]
    assert [(r.ord, r.rec_ord) for r in enrich.low_confidence(results).collect()] == [(0, 1)]
    assert [(r.ord, r.rec_ord) for r in enrich.top_substantive(results, 2).orderBy("rank").collect()] == [(2, 0), (0, 0)]


def test_clause_analysis(spark, results):
    answers = {
        ("p", 0): {"clause_id": "Điều 1", "comparison_summary": "Thời hạn thanh toán dài hơn trước", "important_changes": ["- Thời hạn thanh toán dài hơn trước", "Trả chậm hơn", "Trả chậm hơn."], "review_points": ["Trả chậm hơn", "Hỏi lại bên mua"]},
        ("p", 2): {"clause_id": "Điều 9", "comparison_summary": "Nói về điều khác"},
    }
    raw = spark.createDataFrame([(*k, f"```json\n{json.dumps(v, ensure_ascii=False)}\n```") for k, v in answers.items()] + [("q", 0, "no json")], "pair_id string, ord int, raw string")
    found = {(r.pair_id, r.ord): r.analysis for r in enrich.clause_analysis(results, raw).collect()}
    assert found["p", 0].summary == "Thời hạn thanh toán dài hơn trước" and found["p", 0].important_changes == ["Trả chậm hơn"] and found["p", 0].review_points == ["Hỏi lại bên mua"]
    assert found["p", 2].summary == "Điều 3 được thêm" and found["p", 1].important_changes == [] and found["q", 0].summary == "Điều 1 đổi hình thức"


def test_executive_summary(spark, results):
    answer = {"overview": "Có 3 thay đổi", "key_points": ["Điều 3 được thêm", "Tăng 15 ngày", "Điều 3 được thêm vào", "Chuyện không liên quan gì cả xyz"], "review_alerts": ["Xem lại bảo mật"]}
    raw = spark.createDataFrame([("p", json.dumps(answer, ensure_ascii=False))], "pair_id string, raw string")
    alerts = spark.createDataFrame([("p", 1, "[ANOMALY] x")], "pair_id string, n int, alert string")
    found = {r.pair_id: r for r in enrich.executive_summary(results, alerts, raw).collect()}
    # claims with numbers go, the article's own among them
    assert found["p"].overview == "" and found["p"].key_points == [] and found["p"].review_alerts == ["Xem lại bảo mật", "[ANOMALY] x", "Điều 1: LOW (0.40)"]
    assert found["q"].review_alerts == [] and enrich.executive_summary(results, alerts).count() == 2
    points = spark.createDataFrame([("p", 0, "bảo mật dữ liệu khách hàng"), ("p", 1, "bảo mật dữ liệu của khách hàng"), ("p", 2, "zzzz qqqq")], "pair_id string, n int, point string")
    support = enrich.top_substantive(results, 12).select("pair_id", F.col("rank").alias("ord"), "clause_id", "summary", "record.tags", "record.old", "record.new")
    assert [(r.n, r.clauses) for r in report.grounded_points(points, support, threshold=0.5).collect()] == [(0, ["Điều 3"])]


def test_a_model_that_fails_is_done_without(spark, results):
    def model(system, prompt):
        if system == enrich.SEMANTIC_SYSTEM:
            return '{"semantic_effect": "LEXICAL_EQUIVALENT", "factual_summary": "same"}'
        raise TimeoutError

    stats = changes.statistics(results.withColumn("match_type", F.col("clause_change_kind")), results)
    alerts = spark.createDataFrame([], "pair_id string, n int, alert string")
    slow, enrich.time.sleep = enrich.time.sleep, lambda s: None
    try:
        rows, told = enrich.analyse(results, stats, alerts, model)
        found = {(r.pair_id, r.ord): r for r in rows.collect()}
    finally:
        enrich.time.sleep = slow
    assert [r.semantic_effect for r in found["p", 0].records] == ["SUBSTANTIVE", "LEXICAL_EQUIVALENT"]
    assert found["p", 1].notes == enrich.FORMAL_NOTE and found["p", 2].notes == "Điều 3 được thêm"
    assert {r.pair_id: r.key_points for r in told.collect()} == {"p": [], "q": []}
    judge = enrich.judged(spark.createDataFrame([("c", "r", "g")], "case_name string, report_markdown string, ground_truth string"), lambda s, p: 'x {"score": 12, "notes": "fine"}')
    assert tuple(judge.first()) == ("c", 10.0, "fine") and evaluate.mean_judge_score(judge).first().mean_score == 10.0


def test_sinks_and_logs(spark, results, tmp_path):
    log = "Hit Rate (Top-1): 7/10 = 70.0%\nHit Rate (Top-3): 10/10 = 100.0%\nTrung bình: 12.5 ms\nRAM tăng thêm: 23 MB"
    m = evaluate.markdown_metrics(spark.createDataFrame([("x", log)], "name string, markdown string")).first()
    assert (m.hit_rate_at1_pct, m.query_ms, m.ram_delta_mb, m.mrr, m.precision_at1) == (70.0, 12.5, 23.0, None, 0.7) and abs(m.precision_at3_single_rel - 1 / 3) < 1e-9
    assert set(rules.LOG_FIGURES) < set(m.asDict())
    report.write_reports(spark.createDataFrame([("p", "# T\n\nx"), ("q", "# U")], "pair_id string, report_markdown string"), str(tmp_path / "r"))
    assert (tmp_path / "r" / "pair_id=p").exists()
    report.write_metrics(spark.createDataFrame([("c", 1.0)], "case_name string, f1 double"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m/markdown")).collect()] == ["| case_name | f1 |", "|---|---|", "| c | 1.0 |"]
    assert spark.read.json(str(tmp_path / "m/json")).count() == 1
    text = evaluate.pseudo_report(results).where("pair_id = 'q'").first().report
    assert text == "Điều 1\n30 ngày\n45 ngày"
    lines = report.diff_lines(results.withColumn("match_type", F.col("clause_change_kind"))).where("pair_id = 'p' AND ord = 2").first().line
    assert lines == "+ b"
