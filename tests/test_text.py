import difflib
import unicodedata

from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_anchor_form_ignores_marks_and_punctuation(spark):
    a = one(spark, T.anchor_form, "Điều 7: Bảo mật và bảo vệ dữ liệu — bắt buộc.")
    assert a == one(spark, T.anchor_form, "Dieu 7 Bao mat va bao ve du lieu bat buoc") == "dieu 7 bao mat va bao ve du lieu bat buoc"
    assert one(spark, T.anchor_form, "Phần II > Điều 1") == one(spark, T.anchor_form, "Phần I > Điều 1")


def test_folded_keeps_the_stroke(spark):
    assert one(spark, T.folded, "Thay đổi") == "thay đoi"
    assert one(spark, T.evaluation_form, "Thay đổi") == "thay doi"


def test_normalize(spark):
    assert one(spark, T.normalize, "  “a” – b…  ") == '"a" - b...'
    assert one(spark, T.normalize, unicodedata.normalize("NFD", "ế")) == "ế"
    assert one(spark, T.normalize, None) == ""


def test_semantic_form(spark):
    assert one(spark, T.semantic_form, "- Bên A ,  trả:50\n* Bên B<br>x") == "bên a, trả: 50 bên b x"
    assert one(spark, T.semantic_form, None) == ""


def test_markdown_and_style(spark):
    assert one(spark, T.strip_markdown, "***a*** **b** *c* __d__ _e_ `f`") == "a b c d e f"
    assert [one(spark, T.line_style, x) for x in ("# Phần I", "Điều 12", "1.2. x", "x")] == ["Heading 1", "Heading 2", "Heading 3", "Normal"]
    assert one(spark, T.table_row, "| a |  | b|") == "a | b"


def test_tokens(spark):
    t = "SLA 4 giờ, uptime 99,5% trong 30 ngày tại Hà Nội. a.b@c.vn"
    assert one(spark, T.times, t) == ["4 giờ", "30 ngày"]
    assert one(spark, T.numbers, "1,5% 2 1,5%") == ["1,5%", "2"] or one(spark, T.numbers, "1,5% 2 1,5%") == ["1,5", "2"]
    assert one(spark, T.locations, t)[0] == "hà nội"
    assert one(spark, T.subjects, t) == ["a.b@c.vn"]
    assert one(spark, T.metrics, t) == {"sla_response_hours": ["4"], "uptime_percent": ["99.5"]}


def test_metric_deltas(spark):
    found = one(spark, T.metric_deltas, "Hỗ trợ 8/5, SLA 4 giờ", "Hỗ trợ 24/7, SLA 2 giờ")
    assert [tuple(x) for x in found] == [("support_window", "8/5", "24/7"), ("sla_response_hours", "4", "2")]


def test_ratio_is_that_of_difflib(spark):
    for a, b in (("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", ""), ("Điều 1", "điều 2")):
        assert one(spark, T.text_ratio, a, b) == difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()


def test_sanitize(spark):
    assert one(spark, T.sanitize, "- 1) a\nb") == "a b"
    assert one(spark, lambda c: T.sanitize_list(F.split(c, ";"), 2), "- a;a;;b;c") == ["a", "b"]
    assert one(spark, T.truncate, "x" * 300) == "x" * 237 + "..."
    assert one(spark, T.merged_cells if False else (lambda c: T.merged_cells(F.split(c, ";"))), "a;a;;b; b") == "a | b"


def test_json_object(spark):
    assert one(spark, ids.json_object, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, ids.json_object, 'so {"a": {"b": 2}} it is') == '{"a": {"b": 2}}'
    assert one(spark, ids.json_object, "{no") is None
    assert one(spark, ids.sse_frame, "stats", "{}") == "event: stats\ndata: {}\n\n"
