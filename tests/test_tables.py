import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from palimpsest.functions import tables


def _there(df):
    return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())


def test_scratch_drops_what_it_was_not_told_to_keep(spark):
    rows = spark.range(5)
    before = tables.cut(rows)
    with tables.scratch(spark) as keep:
        passing = tables.cut(rows)
        with tables.scratch(spark) as keep_inner:
            inner, result_inner = tables.cut(rows), keep_inner(rows)
        assert not _there(inner) and _there(result_inner)
        kept = keep(passing.where("id > 2"))
    assert not _there(passing) and not _there(result_inner)
    assert _there(before) and sorted(r.id for r in kept.collect()) == [3, 4]


def test_scratch_drops_its_tables_after_an_error(spark):
    left = []
    try:
        with tables.scratch(spark):
            left.append(tables.cut(spark.range(3)))
            raise KeyError
    except KeyError:
        pass
    assert not _there(left[0])


def test_once_judges_recurring_inputs_once_and_others_by_row(spark, monkeypatch):
    asked = []

    def judge(x):
        asked.append(x.count())
        return x.withColumn("n", F.length("s") + F.coalesce(F.length("t"), F.lit(100)))

    def found(rows):
        return sorted((r.id, r.n is None, r.n) if r.n is not None else (r.id, True, 0) for r in tables.once(rows, ["s", "t"], judge, ["n"]).select("id", "n").collect())

    text = F.when(F.col("id") % 7 != 0, F.repeat(F.lit("a"), (F.col("id") % 5).cast("int")))
    rows = spark.range(1000).select("id", text.alias("s"), F.when(F.col("id") % 3 > 0, F.lit("b")).alias("t"))
    expected = [(i, False, i % 5 + (1 if i % 3 else 100)) if i % 7 else (i, True, 0) for i in range(1000)]
    assert found(rows) == expected and asked == [12]
    monkeypatch.setattr(tables, "MOST_ONCE_BYTES", 1)
    assert found(rows) == expected and asked == [12, 1000]
    monkeypatch.setattr(tables, "MOST_ONCE", 3)
    assert found(rows) == expected and asked == [12, 1000, 1000]


def test_large_rows_are_written_and_read_a_few_at_a_time(spark):
    """Sixty rows of half a megabyte were one row group of one page, and their least and greatest were kept."""
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "").cast("binary")
    rows = tables.cut(spark.range(60).repartition(1).withColumn("body", body), large_rows=True)
    (file,) = (x.removeprefix("file://") for x in rows.inputFiles())
    written = pq.ParquetFile(file).metadata
    groups = [written.row_group(i) for i in range(written.num_row_groups)]
    assert max(g.total_byte_size for g in groups) < 8 << 20 and not any(g.column(1).is_stats_set for g in groups)
    with tables.batches_of(spark, 1):
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    assert [r.n for r in sizes] == [1] * 60
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1"
