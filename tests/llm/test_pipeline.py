import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, same

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    before = docs
    for n, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        after.write.parquet(str(tmp_path / n))
        after = spark.read.parquet(str(tmp_path / n))
        assert after.schema.names == docs.schema.names
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_near_copies_alone_make_no_recurring_line(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [[word() for _ in range(12)] for _ in range(20)]
    note = "this very line stands in many documents that have nothing else in common"
    texts = {}
    for n in range(25):
        own = [list(x) for x in base]
        own[n % 20][6] = word()
        texts[n] = "\n".join(" ".join(x) for x in own)
    for n in range(100, 125):
        texts[n] = note + "\n" + " ".join(word() for _ in range(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    stages = dict(corpus_pipeline.STAGES)
    after = stages["line_dedup"](spark, docs, SF)
    found = {r.doc_id: r.text for r in after.collect()}
    assert {n: found[n] for n in range(25)} == {n: texts[n] for n in range(25)}
    assert {n: found[n] for n in range(100, 125)} == {n: texts[n].split("\n")[1] for n in range(100, 125)}
    left = {r.doc_id for r in stages["near_dedup"](spark, after, SF).select("doc_id").collect()}
    assert left == {0, *range(100, 125)}


WORD = re.compile("[^\x20\x09-\x0d]+")


def _fixture():
    """Documents whose fate in each stage is known: junk goes, a recurring line goes, of near copies the first stays, and a shared passage goes from both its documents."""
    rng = random.Random(31)
    word = lambda: rng.choice("bcdfg") + "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3))
    texts, expected = {}, {}
    notice = "all rights in these pages are reserved by their owners"
    for n in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(8)]
        texts[n] = "\n".join([*lines[:4], *([notice] if n < 30 else []), *lines[4:]])
        expected[n] = "\n".join(lines)
    passage = [word() for _ in range(60)]
    for n in (60, 61):
        own = [word() for _ in range(100)]
        texts[n] = " ".join([*own[:50], *passage, *own[50:]])
        expected[n] = " ".join(own)
    base = [word() for _ in range(200)]
    for n in (70, 71, 72):
        own = list(base)
        own[10 * (n - 69)] = word()
        texts[n] = " ".join(own)
    expected[70] = texts[70]
    for n in range(80, 100):
        texts[n] = " ".join(rng.choice(["$$$", "###", "click", "win", "@@", "now!!"]) for _ in range(120))
    labels = [(n, 1, 0) for n in range(0, 75)] + [(n, 0, 0) for n in range(80, 95)]
    return texts, expected, labels


def test_run_against_what_each_stage_must_do(spark, tmp_path):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import vocabulary

    texts, expected, labels = _fixture()
    rows = [(n, t, "en", "s", len(t)) for n, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found, by_sequence = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert found.keys() == expected.keys()
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for n, text in expected.items():
        ids = tokenizer.encode(" ".join(WORD.findall(text)), add_special_tokens=False).ids + [0]
        (piece,) = found[n]
        assert (piece.piece, piece.start, piece.length, piece.ids_crc32) == (0, 0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048


def test_families_meet_documents_not_lines(spark, monkeypatch):
    """No shuffle before the lines are written: families are broadcast to the documents, also where Spark's own threshold wouldn't."""
    from pyspark.sql import functions as F

    from palimpsest.llm import line_templates
    from palimpsest.llm.shared import row_key

    plans, write = [], line_templates.cut
    monkeypatch.setattr(line_templates, "cut", lambda df: (plans.append(df._jdf.queryExecution().toString()), write(df))[1])
    docs = spark.createDataFrame([(i, f"a b c\nd e {i} f") for i in range(50)], "doc_id bigint, text string")
    families = docs.where("doc_id < 40").select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.lit(1).cast("bigint").alias("family"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert line_templates.recurring_lines(docs, families=families, min_docs=12).count() == 0
        assert line_templates.recurring_lines(docs, families=families, min_docs=11).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_families_are_those_of_near_duplicates_without_python(spark, monkeypatch):
    """One large group, near copies that no hub holds, short and empty texts, rows that share an id; and the stage before its lines runs no Python."""
    from pyspark.sql import functions as F

    from palimpsest.llm import families, minhash
    from palimpsest.llm.shared import row_key

    rng = random.Random(21)
    base = [f"w{n}" for n in range(150)]
    rows = []
    for n in range(120):
        own = list(base) if n % 3 else [f"v{n % 9}-{k}" for k in range(90)]
        for place in rng.sample(range(len(own)), n % 7):
            own[place] = f"x{n}-{place}"
        rows.append((n, " ".join(own)))
    rows += [(5, "another text of the same id"), (130, "two words"), (131, "TWO\twords"), (132, ""), (133, " "), (134, None), (None, rows[1][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    named = lambda df: {(bytes(r.row), r.component_id) for r in df.select("row", "component_id").collect()}
    expected = named(minhash.near_duplicates(docs).where("n_shingles > 0 AND doc_id IS NOT NULL"))

    def no_python(*_, **__):
        raise AssertionError("runs Python")

    monkeypatch.setattr(type(docs), "mapInArrow", no_python)
    monkeypatch.setattr(minhash, "_blocks", no_python)
    assert named(families.near_families(docs)) == expected
    assert 1 < len({c for _, c in expected}) < len(expected)
    assert len(corpus_pipeline.lines(spark, docs.select("doc_id", "text"), "").collect()) == len(rows)
