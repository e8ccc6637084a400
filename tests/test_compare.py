import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import align, anomalies, changes, chunks
from palimpsest.plans import compare
from palimpsest.sources import paragraphs as P

PARAGRAPHS = "doc_id string, doc_label string, pos int, text string, style string, page int"


def sections(spark, lines, most=1500):
    rows = [("d", "doc_A", i, t, "Normal", p) for i, (t, p) in enumerate(lines)]
    made = chunks.with_ids(chunks.sub_chunks(chunks.sectionize(spark.createDataFrame(rows, PARAGRAPHS)), most))
    return made.orderBy("raw_index", "sub_index").collect()


def test_one_article_over_two_pages(spark):
    (c,) = sections(spark, [("Điều 1: Nghĩa vụ bảo mật", 1), ("a) Bên A giữ bí mật thông tin", 1), ("b) Bên B giữ bí mật thông tin", 2)])
    assert (c.page, c.page_end, c.line_pages, c.line_start, c.line_end, c.breadcrumb, c.title) == (1, 2, [1, 1, 2], 1, 3, "Điều 1", "Nghĩa vụ bảo mật")


def test_sub_chunks_keep_spans(spark):
    lines = [("Điều 2: Phạm vi công việc", 1), ("a) Nội dung thứ nhất của hợp đồng này", 1), ("b) Nội dung thứ hai của hợp đồng này", 2), ("c) Nội dung thứ ba của hợp đồng này", 2)]
    found = sections(spark, lines, 80)
    whole = "\n".join(t for t, _ in lines)
    assert len(found) >= 2 and found[0].page == found[0].page_end == 1
    for c in found:
        assert whole[c.char_start : c.char_end] in c.content
    assert found[-1].page == 2 and found[-1].content.startswith("[Điều 2 – Phạm vi công việc]\n")
    assert len({c.chunk_id for c in found}) == len(found)


def test_numbering_starts_sub_clauses(spark):
    found = sections(spark, [("Điều 3: Danh mục", 1), ("b1) Khoản thứ nhất trong điều", 1), ("(i) Khoản thứ hai trong điều", 1), ("1.2.3 Khoản thứ ba trong điều", 1)], 60)
    assert len(found) >= 3
    assert all(any(m in c.content for c in found) for m in ("b1)", "(i)", "1.2.3"))


def test_hierarchy_resets_and_noise_goes(spark):
    lines = [("Mở lời của văn bản hợp đồng dịch vụ", None), ("Trang 1/3", None), ("Phần I: Chung", None), ("Mục 1: Một", None), ("Điều 12", None), ("Ngắn.", None), ("Phần II: Riêng", None), ("Điều 1: Hai", None), ("Ký tên", None)]
    found = sections(spark, lines)
    assert [c.breadcrumb for c in found] == ["Mở đầu", "Phần I", "Phần I > Mục 1: Một", "Phần I > Mục 1: Một > Điều 12", "Phần II", "Phần II > Điều 1", "Phần ký tên & Xác nhận"]
    assert [c.raw_index for c in found] == list(range(7))


def test_ids_do_not_depend_on_numbers(spark):
    one = sections(spark, [("Điều 1: A là nội dung đầy đủ", 1)])[0]
    two = sections(spark, [("Điều 9: Một điều khác hẳn", 1), ("Điều 1: A là nội dung đầy đủ", 1)])[1]
    assert one.chunk_id == two.chunk_id and one.legacy_chunk_id != two.legacy_chunk_id


def test_greedy_tables(spark):
    rows = [("t", "doc_A", 0, ["| tên | vai |"] + [f"| người {i} | việc {i} |" for i in range(10)])]
    df = spark.createDataFrame(rows, "doc_id string, doc_label string, raw_index int, lines array<string>")
    df = df.withColumns({"content": F.array_join("lines", "\n"), "breadcrumb": F.lit("Phụ lục A"), "title": F.lit(None).cast("string"), "page": F.lit(1), "page_end": F.lit(1), "line_pages": F.array_repeat(F.lit(1), 11), "sub_index": F.lit(0)})
    found = chunks.sub_chunks(df, 80).orderBy("sub_index").collect()
    assert len(found) > 2 and all("| tên | vai |" in c.content for c in found)
    assert sum(c.line_end - c.line_start + 1 for c in found) == 11


@pytest.mark.parametrize(("sim", "same", "expected"), [(0.955, True, [("MODIFIED", True)]), (0.98, True, [("UNCHANGED", False)]), (0.94, True, [("MODIFIED", True)]), (0.5, False, [("DELETED", False), ("ADDED", False)]), (0.98, False, [("MODIFIED", False)]), (0.8, False, [("MODIFIED", False)])])
def test_classification(spark, sim, same, expected):
    df = spark.createDataFrame([(sim, False, "a", "b", 1.0 if same else 0.9)], "sim double, anchored boolean, text_a string, text_b string, ratio double")
    assert [(r.match_type, r.near_threshold) for r in align.classify(df).orderBy("part").collect()] == expected


def brute_alignment(sim, gap):
    n, m = sim.shape
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = -gap * np.arange(n + 1), -gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + sim[i - 1, j - 1], best[i - 1, j] - gap, best[i, j - 1] - gap)
    return best[n, m]


def test_global_alignment_is_optimal_and_covers_all():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sim = np.round(rng.random((rng.integers(0, 7), rng.integers(0, 7))), 1)
        found = align.global_alignment(sim, 0.4)
        assert [i for i, _ in found if i >= 0] == list(range(sim.shape[0])) and [j for _, j in found if j >= 0] == list(range(sim.shape[1]))
        total = sum(sim[i, j] if i >= 0 and j >= 0 else -0.4 for i, j in found)
        assert abs(total - brute_alignment(sim, 0.4)) < 1e-9


def test_bonus_raises_equal_clauses(spark):
    cells = [(i, j, 0.9, f"dieu {i}", f"dieu {j}", 2, 2) for i in range(2) for j in range(2)]
    df = spark.createDataFrame(cells, "i int, j int, sim double, clause_a string, clause_b string, n_a int, n_b int")
    from palimpsest.rules import Settings

    found = {(r.i, r.j): r.sim for r in align.with_bonus(df, Settings(hint_alpha=0.1, hint_min_gap=2)).collect()}
    assert found[0, 0] == found[1, 1] == pytest.approx(1.0) and found[0, 1] == pytest.approx(0.9)
    assert all(r.sim == 0.9 for r in align.with_bonus(df, Settings(hint_alpha=0.1, hint_min_gap=3)).collect())


def greedy_collapse(rows):
    out, i = [], 0
    while i < len(rows):
        if i + 1 < len(rows) and rows[i][1] == rows[i + 1][1] != "" and {rows[i][0], rows[i + 1][0]} == {"ADDED", "DELETED"}:
            out.append("REPLACED")
            i += 2
        else:
            out.append(rows[i][0])
            i += 1
    return out


def test_collapse_is_greedy(spark):
    rng = random.Random(5)
    cases = {f"p{k}": [(rng.choice(["ADDED", "DELETED", "MODIFIED"]), rng.choice(["x", "y", ""])) for _ in range(rng.randint(1, 12))] for k in range(40)}
    rows = [(p, i, k, c, "a", "b", 0.5) for p, items in cases.items() for i, (k, c) in enumerate(items)]
    df = spark.createDataFrame(rows, "pair_id string, ord int, match_type string, clause_id string, text_a string, text_b string, similarity double")
    found: dict = {}
    for r in changes.collapse(df).orderBy("pair_id", "ord").collect():
        found.setdefault(r.pair_id, []).append(r.match_type)
    assert found == {p: greedy_collapse(items) for p, items in cases.items()}


CLAUSE = "pair_id string, ord int, match_type string, clause_id string, text_a string, text_b string, similarity double"


PEOPLE_A = "Danh sách nhân sự\n| Lead Developer | Nguyễn A | 5 năm | Java |\n| QA Lead | Trần B | 4 năm | ISTQB |"
PEOPLE_B = "Danh sách\nnhân sự\n| Lead Developer | Lê C | 6 năm | Java |\n| QA Lead | Phạm D | 3 năm | ISTQB |"
CASES = {
    "place": ("Giải quyết trong 30 ngày tại Hà Nội.", "Giải quyết trong 30 ngày tại TP. Hồ Chí Minh.", "Điều 1"),
    "boilerplate": ("Bên A trả tiền.\nHợp đồng này được lập thành 02 bản.", "Bên A trả tiền.", "Điều 1"),
    "synonym": ("Các bên chấm dứt hợp đồng.", "Các bên kết thúc hợp đồng.", "Điều 1"),
    "service": ("Hỗ trợ 8/5, SLA 4 giờ", "Hỗ trợ 24/7, SLA 2 giờ", "Điều 1"),
    "uptime": ("Uptime 99.5 %", "Uptime 99.9 %", "Điều 1"),
    "people": (PEOPLE_A, PEOPLE_B, "Phụ lục A"),
}


@pytest.fixture(scope="module")
def records(spark):
    """All cases in one plan."""
    df = spark.createDataFrame([(k, 0, "MODIFIED", clause, a, b, 0.9) for k, (a, b, clause) in CASES.items()], CLAUSE)
    out: dict = {}
    for r in sorted(changes.change_records(df).collect(), key=lambda r: r.rec_ord):
        out.setdefault(r.pair_id, []).append(r.record)
    return out


def test_place_changes(records):
    (r,) = records["place"]
    assert "Địa điểm" in r.tags and "Thời hạn" not in r.tags and (r.semantic_effect, r.review_status) == ("SUBSTANTIVE", "AUTO")


def test_boilerplate_is_formal(records):
    found = records["boilerplate"]
    assert {r.impact_level for r in found} == {"formal"} and {r.semantic_effect for r in found} == {"FORMAL"}


def test_synonyms_need_review(records):
    (r,) = records["synonym"]
    assert (r.impact_level, r.semantic_effect, r.review_status) == ("substantive", "SUBSTANTIVE", "REVIEW_NEEDED")


def test_service_levels_are_critical(records):
    (r,) = records["service"]
    assert "CRITICAL_VALUE_DELTA" in r.meta_tags and {"Số liệu", "Thời hạn"} <= set(r.tags) and r.review_status == "REVIEW_NEEDED"
    (r,) = records["uptime"]
    assert "Số liệu" in r.tags and "CRITICAL_VALUE_DELTA" in r.meta_tags


def test_people(records):
    found = records["people"]
    assert sorted(r.change_kind for r in found) == ["MODIFIED", "REPLACED", "REPLACED"]
    assert [r.impact_level for r in found if r.change_kind == "MODIFIED"] == ["formal"]
    assert all("Nhân sự" in r.tags for r in found if r.change_kind == "REPLACED")


def test_rows_of_a_people_table(spark):
    table = """Danh sách | x
| STT | Họ tên | Vai trò |
|---|:-:|---|
| 1 | Nguyễn A | Lead  Developer | 5 năm | Java | Java | 2 năm kinh nghiệm |
| 2 | Trần B | Thư ký |
| a | b |
| Lê C | lead developer | ISTQB, | 3 năm |
| 7 | Phạm D | Lead Developer | PMP |"""
    df = spark.createDataFrame([(table,), ("không có bảng",), (None,)], "t string")
    found, none, null = [r.p for r in df.select(changes.personnel_rows(T.lines(F.col("t"))).alias("p")).collect()]
    assert [tuple(r) for r in found] == [
        ("Lead Developer", "Phạm D", "", "7, PMP", "7 | Phạm D | Lead Developer | PMP"),
        ("row_1", "Trần B", "", "2, Thư ký", "2 | Trần B | Thư ký"),
        ("lead developer", "Lê C", "3 năm", "ISTQB", "Lê C | lead developer | ISTQB, | 3 năm"),
    ]
    assert not none and not null


def test_bands(spark):
    rows = [(1.0, 0.95, 0.9, 0.9), (0.4, 0.3, 0.3, 0.3), (0.1, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    score = changes.confidence(*[F.col(x) for x in "abcd"])
    assert [r.x for r in df.select(changes.band(score).alias("x")).collect()] == ["HIGH", "LOW", "SUSPECT"]


def test_two_versions_end_to_end(spark):
    rows = []
    for side, second in (("a", "Điều 2: Thanh toán trong 30 ngày"), ("b", "Điều 2: Thanh toán trong 45 ngày")):
        lines = ["Điều 1: Phạm vi công việc của hợp đồng", second] + (["Điều 3: Bảo mật thông tin khách hàng"] if side == "b" else [])
        rows += [("p", side, f"doc_{side}", i, t) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "pair_id string, side string, doc_id string, pos int, text string").withColumns({"doc_label": F.col("side"), "style": F.lit("Normal"), "page": F.lit(1)})
    out = compare.compare_versions(df.where("side = 'a'"), df.where("side = 'b'"))
    s = out["statistics"].first()
    assert (s.unchanged, s.added, s.deleted) == (1, 1, 0) and s.modified + s.replaced == 1 and s.clauses_affected == 2
    results = {r.clause_change_kind: r for r in out["results"].collect()}
    assert results["ADDED"].source_a is None and results["ADDED"].source_b.file == "b"
    for r in results.values():
        source = r.source_b
        assert all((x.source_a, x.source_b) == (r.source_a, r.source_b) for x in r.records)
        assert source.chunk_id.startswith("doc_b__") and source.page == 1 and source.context_snippet.startswith("Điều")
    text = out["report"].first().report_markdown
    assert "## I. EXECUTIVE SUMMARY" in text and "Điều 3" in text and "- unchanged: 1" in text


CLAUSES = "pair_id string, ord int, clause_id string, clause_change_kind string, text_a string, text_b string"


def test_anomalies(spark):
    rows = [("p", 0, "Điều 1", "REPLACED", "SLA 4 giờ", "Không còn"), ("p", 1, "Điều 2", "MODIFIED", "x", "Theo SLA ở trên, uptime 99.9%"), ("p", 2, "Điều 3", "MODIFIED", "x", "uptime 99.5 % theo Điều 4"), ("p", 3, "Điều 4", "DELETED", "y", None)]
    alerts = [r.alert for r in anomalies.alerts(spark.createDataFrame(rows, CLAUSES)).orderBy("n").collect()]
    assert len(alerts) == 3 and alerts[0] == "[CRITICAL ANOMALY] Tham chiếu SLA còn xuất hiện ở Điều 2 dù điều khoản SLA chính đã bị thay thế/loại bỏ (Điều 1)." and "điều 4" in alerts[1] and "99.9" in alerts[2] and "99.5" in alerts[2]


def test_docx_and_markdown(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    xml = f'<w:document xmlns:w="{w}"><w:body>{p("Điều 1")}{p("")}<w:tbl><w:tr>{cell("a")}{cell("a")}{cell("b")}</w:tr></w:tbl>{p("cuối")}</w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    files = spark.createDataFrame([("/x/a.docx", 10, bytearray(raw.getvalue())), ("/x/b.txt", 10, bytearray(b""))], "path string, length long, content binary")
    assert [(r.pos, r.text, r.style) for r in P.docx_paragraphs(files, "doc_A").orderBy("pos").collect()] == [(0, "Điều 1", "Normal"), (1, "a | b", "Table"), (2, "cuối", "Normal")]
    assert [r.reason for r in P.intake(files).orderBy("path").collect()] == [None, "unsupported suffix"]
    page = "# **Điều 1** Một\ndòng\n\n| a | b |\n|---|---|\n| 1 |  |\n\nchữ *nghiêng*"
    pages = spark.createDataFrame([("d", 1, page), ("d", 2, "sau")], "doc_id string, page int, text string")
    found = [(r.pos, r.text, r.style, r.page) for r in P.markdown_paragraphs(pages, "doc_A").orderBy("pos").collect()]
    assert found == [(0, "Điều 1 Một", "Heading 2", 1), (1, "dòng", "Normal", 1), (2, "a | b", "Table", 1), (3, "1", "Table", 1), (4, "chữ nghiêng", "Normal", 1), (5, "sau", "Normal", 2)]
