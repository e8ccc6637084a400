"""Headings are tried only where a line may begin one, and what a line needs is computed once."""

from palimpsest import rules
from palimpsest.operators import chunks
from palimpsest.sources import paragraphs

LINES = [
    "  Phần I: Chung", "PHỤ LỤC A - Biểu mẫu", "phan 2", "Chương II", "CHƯƠNG 3: x", "Chuong IV", "chơng 1", "Mục 1", "MUC II – a", "Tiểu mục 4", "Căn cứ luật", "căn cứ", "Điều 1. Tên", "ĐIEU 2 tên", "Điều 12a", "Mẫu số 5: đơn", "Đại diện bên A",
    "đại diện các bên", "Người đại diện", "Phần ký tên", "Ký tên", "ĐÓNG DẤU", "Xác nhận của", "Thay mặt công ty", "Giám đốc", "Tổng giám đốc", "người lập biểu", "Trang 1/2", "12", "---", "", "số: 4/x", "plain words of a line", "é “x” – y…", "a\t \tb", "Chapter one", "Dieu 4",
]


def _documents(spark):
    rows = [(n, "\n".join(LINES[n:] + LINES[:n])) for n in range(len(LINES))] + [(900, None), (901, ""), (902, "Điều 1")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_no_heading_is_lost_by_trying_beginnings_first(spark, monkeypatch):
    for legacy in (False, True):
        found = _sorted(chunks.sectionize(paragraphs.text_paragraphs(_documents(spark)), legacy=legacy))
        with monkeypatch.context() as m:
            m.setattr(rules, "HEAD", "")
            assert found == _sorted(chunks.sectionize(paragraphs.text_paragraphs(_documents(spark)), legacy=legacy))
        assert len(found) > 5 * len(LINES)


def test_lines_go_to_python_once(spark):
    made = chunks.sectionize(paragraphs.text_paragraphs(_documents(spark)))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
