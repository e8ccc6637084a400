"""Version pairs against brute force on whole shingle sets, and the queries over them."""

import difflib
import random

from palimpsest.plans import compare
from palimpsest.plans.queries import QUERIES


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(x, y):
    a, b = _shingles(x), _shingles(y)
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def _documents():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = {}
    for family in range(12):
        width = 4 if family % 2 else 12  # odd families have no line of 40 characters
        lines = [[word() for _ in range(width)] for _ in range(240 // width)]
        for copy in range(3):
            own = [list(x) for x in lines]
            for place in rng.sample(range(len(own)), copy * 2):
                own[place][1] = word()
            texts[family * 10 + copy] = "\n".join(" ".join(x) for x in own)
    shared = "this line is boilerplate that many quite different documents have in common"
    for n in range(20):
        texts[500 + n] = shared + "\n" + " ".join(word() for _ in range(80))
    return texts | {600: "", 601: " ", 602: "two words", 603: "two words", 604: None}


def test_near_copies_are_paired_and_boilerplate_is_not(spark):
    texts = _documents()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {(r.doc_a, r.doc_b) for r in compare.version_pairs(docs).select("doc_a", "doc_b").collect()}
    ids = sorted(k for k, v in texts.items() if v)
    expected = {b: [a for a in ids if a < b and _alike(texts[a], texts[b])] for b in ids}
    assert {b for _, b in found} == {b for b, a in expected.items() if a}
    assert len(found) == len({b for _, b in found}) == 25
    assert all(a in expected[b] for a, b in found)


def test_one_large_group_and_one_that_no_hub_holds(spark):
    """Every near copy is found where the first document of a band isn't one."""
    rng = random.Random(9)
    base = [f"w{n}" for n in range(200)]
    texts = {}
    for n in range(60):
        own = list(base)
        for place in rng.sample(range(200), 3 + n % 4):
            own[place] = f"x{n}-{place}"
        texts[n] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_b: r.doc_a for r in compare.version_pairs(docs).select("doc_a", "doc_b").collect()}
    expected = {b for b in texts if any(_alike(texts[a], texts[b]) for a in range(b))}
    assert 0 < len(expected) < 60 and set(found) == expected
    assert all(a < b and _alike(texts[a], texts[b]) for b, a in found.items())


def test_ratio_is_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(120)]
    lines = [" ".join(words[n : n + 8]) for n in range(0, 120, 8)]
    edited = {"late": lines[:9] + ["other words here"] + lines[10:], "first": ["other words here"] + lines[1:]}
    for name, other in edited.items():
        texts = {1: "\n".join(lines), 2: "\n".join(other)}
        spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (row,) = QUERIES["seq_ratio"](spark, f"{tmp_path}/{name}").collect()
        assert row.pair_id == "1-2"
        assert row.ratio < 1
        assert abs(row.ratio - difflib.SequenceMatcher(None, texts[1], texts[2], autojunk=False).ratio()) < 1e-4


def test_nw_align_embeds_lines_between_anchors_only(spark, monkeypatch, tmp_path):
    from palimpsest.operators import retrieval
    from palimpsest.plans.queries import QUERIES

    lines = [" ".join(f"w{n}x{k}" for k in range(8)) for n in range(40)]
    other = [*lines[:20], "one line that is not the same here", *lines[21:]]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked, embed = [], retrieval.embed
    monkeypatch.setattr(retrieval, "embed", lambda rows, *a, **k: (asked.append(rows.count()), embed(rows, *a, **k))[1])
    rows = QUERIES["nw_align"](spark, str(tmp_path)).collect()
    assert asked == [1, 1] and sum(r.anchored for r in rows) == 39


def test_records_judge_changed_lines_once(spark):
    """What three steps read is written once: the result's plan holds no judgement of lines any more."""
    from palimpsest.operators import changes

    rows = [("p", 0, "1", "MODIFIED", "a 10 ngày\nb", "a 12 ngày\nb", 0.9), ("p", 1, "2", "MODIFIED", "x  y", "x y", 0.9), ("p", 2, "3", "UNCHANGED", "z", "z", 1.0)]
    clauses = spark.createDataFrame(rows, "pair_id string, ord int, clause_id string, match_type string, text_a string, text_b string, similarity double")
    found = changes.change_records(clauses)
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ord, r.record.impact_level) for r in found.where("rec_ord >= 0").collect()) == [(0, "substantive"), (1, "formal")]


def test_texts_without_a_partner_are_not_shuffled(spark):
    """Keys of pairs are broadcast to the documents, also where Spark's own threshold wouldn't."""
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "One two three four five six"), (3, "others have none of these words")], "doc_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = compare.version_pairs(docs)
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        assert [(r.doc_a, r.doc_b) for r in pairs.collect()] == [(1, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 2
