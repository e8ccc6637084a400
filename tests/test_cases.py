"""Annotated cases from files to metrics, and all presets over them."""

import json
import zipfile

from palimpsest.plans import cases
from palimpsest.rules import PRESETS

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(path, lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def _folder(root):
    old = ["Điều 1: Phạm vi công việc của hợp đồng này", "Điều 2: Bên B thanh toán trong 30 ngày", "Điều 3: Bảo mật thông tin khách hàng"]
    for name, change in (("Test_01_Difficult", (1, "Điều 2: Bên B thanh toán trong 45 ngày")), ("Test_02_Difficult", (2, "Điều 3: Bảo mật toàn bộ thông tin của các bên"))):
        folder = root / name
        folder.mkdir(parents=True)
        new = list(old)
        new[change[0]] = change[1]
        _docx(folder / "x_v1.docx", old)
        _docx(folder / "x_v2.docx", new)
        truth = {"pair_id": name, "difficulty_level": "hard", "description": "", "changes": [{"type": "Số liệu", "location": f"Điều {change[0] + 1}", "v1_content": old[change[0]], "v2_content": change[1]}]}
        (folder / "ground_truth.json").write_text(json.dumps(truth, ensure_ascii=False), encoding="utf-8")
    (root / "Test_03_Difficult").mkdir()
    _docx(root / "Test_03_Difficult" / "y_v1.docx", old)  # no second version, no annotations
    return f"file://{root}"


def test_a_folder_becomes_metrics(spark, tmp_path):
    path = _folder(tmp_path / "cases")
    files = cases.case_files(spark, path).collect()
    assert sorted((r.case_name, r.side) for r in files) == [(f"Test_0{k}_Difficult", s) for k in (1, 2) for s in "ab"]
    out = cases.evaluate_cases(spark, path)
    metrics = {r.case_name: (r.tp, r.fp, r.fn, r.f1) for r in out["metrics"].collect()}
    assert metrics == {"Test_01_Difficult": (1, 0, 0, 1.0), "Test_02_Difficult": (1, 0, 0, 1.0), None: (2, 0, 0, 1.0)}
    guards = {r.case_name: (r.clause_recall, r.number_recall, r.volume_alignment) for r in out["guards"].collect()}
    assert guards["Test_01_Difficult"] == (1.0, 1.0, 1.0)
    lines = [r.value for r in cases.evaluation_markdown(out["metrics"]).collect()]
    assert lines[0].startswith("| Case |") and lines[2] == "| Test_01_Difficult | 1 | 0 | 0 | 100.00% | 100.00% | 100.00% |" and lines[-1].startswith("| Micro | 2 |")


def test_presets_run_over_all_cases(spark, tmp_path):
    path = _folder(tmp_path / "cases")
    guards, sweep = cases.sweep_cases(spark, path)
    found = {(r.case_name, r.preset): (r.clause_recall, r.number_recall, r.volume_alignment) for r in guards.collect()}
    assert found.keys() == {(f"Test_0{k}_Difficult", p) for k in (1, 2) for p in PRESETS}
    for name, settings in list(PRESETS.items())[:1]:
        alone = {r.case_name: (r.clause_recall, r.number_recall, r.volume_alignment) for r in cases.evaluate_cases(spark, path, settings)["guards"].collect()}
        assert alone == {case: v for (case, preset), v in found.items() if preset == name}
    assert sum(r.recommended for r in sweep.collect()) == 1
