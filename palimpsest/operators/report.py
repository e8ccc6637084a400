"""Markdown reports of comparisons and the checks on what a language model adds to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

KINDS = {"MODIFIED": "Sửa đổi", "REPLACED": "Thay thế", "ADDED": "Thêm mới", "DELETED": "Loại bỏ"}
COUNTERS = ("atomic_changes", "clauses_affected", "substantive", "formal", "replaced", "added", "deleted", "modified", "unchanged")


def source_line(file: Column, page: Column, page_end: Column, chunk_id: Column, lines: tuple[Column, Column] | None = None, chars: tuple[Column, Column] | None = None) -> Column:
    """File, pages, lines, characters and chunk, as far as they are known; lines and chars are first and last ones."""

    def stretch(sign: str, first: Column, last: Column) -> Column:
        start = F.concat(F.lit(sign), first.cast("string"))
        return F.when(last.isNotNull() & (last != first), F.concat(start, F.lit("-"), last.cast("string"))).otherwise(start)

    known = [stretch("p.", page, page_end), *[stretch(sign, *given) for sign, given in (("l.", lines), ("c.", chars)) if given]]
    return F.concat_ws(" · ", file, *known, F.nullif(T.text(chunk_id), F.lit("")))


def source_text(ref: Column) -> Column:
    """A source reference (chunks.SOURCE) as a line; `-` if there is none."""
    line = source_line(ref["file"], ref["page"], ref["page_end"], ref["chunk_id"], (ref["line_start"], ref["line_end"]), (ref["char_start"], ref["char_end"]))
    return F.when(ref.isNull(), F.lit("-")).otherwise(line)


def match_counters(pairs: DataFrame) -> DataFrame:
    """How many chunks of each pair of documents are unchanged, modified, added and deleted."""
    of = lambda k: F.count_if(F.col("match_type") == k).alias(k.lower())
    return pairs.groupBy("pair_id").agg(of("UNCHANGED"), of("MODIFIED"), of("ADDED"), of("DELETED"))


def diff_lines(pairs: DataFrame, limit: int = 150) -> DataFrame:
    """Aligned pairs (pair_id, ord, match_type, text_a, text_b) as lines of a diff, for consoles: unchanged ones aren't shown."""
    of = lambda sign, c: F.when(T.text(F.col(c)) != "", F.concat(F.lit(sign), F.substring(T.squeeze(F.col(c)), 1, limit)))
    return pairs.where("match_type <> 'UNCHANGED'").select("pair_id", "ord", F.concat_ws("\n", of("- ", "text_a"), of("+ ", "text_b")).alias("line"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One Markdown text a pair, in a folder of its own (pair_id=...) under path."""
    reports.select("pair_id", F.col("report_markdown").alias("value")).write.mode("overwrite").partitionBy("pair_id").option("lineSep", "\n").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines, and the same as a Markdown table beside them; both are as small as the number of cases."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    markdown_table(metrics).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def markdown_table(rows: DataFrame) -> DataFrame:
    """rows as a Markdown table of one column value: its head, then a line a row."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(f"| {' | '.join(rows.columns)} |",), (f"|{'---|' * len(rows.columns)}",)], "value string").coalesce(1)
    return head.unionByName(rows.select(cells.alias("value")))


def record_lines(r: Column) -> Column:
    head = F.concat(F.lit("- **"), r["change_kind"], F.lit("** · "), r["impact_level"], F.lit(" · "), r["confidence_band"], F.lit(" · "), F.array_join(r["tags"], ", "))
    removed, added = F.when(r["old"] != "", F.concat(F.lit("- "), r["old"])), F.when(r["new"] != "", F.concat(F.lit("+ "), r["new"]))
    diff = F.concat(F.lit("\n```diff\n"), F.concat_ws("\n", removed, added), F.lit("\n```"))
    review = F.when(r["review_status"] == "REVIEW_NEEDED", F.lit(" · REVIEW_NEEDED")).otherwise(F.lit(""))
    return F.concat(head, review, F.when((r["old"] != "") | (r["new"] != ""), diff).otherwise(F.lit("")))


def summary_line(results: DataFrame) -> DataFrame:
    """Clause results with a sentence on their kind and numbers of changes."""
    n = lambda k: F.size(F.filter("records", lambda r: r["impact_level"] == k)).cast("string")
    of = F.when(F.col("clause_change_kind") == "ADDED", F.lit("được thêm mới")).when(F.col("clause_change_kind") == "DELETED", F.lit("bị loại bỏ"))
    return results.withColumn("summary", F.concat(F.col("clause_id"), F.lit(" "), F.coalesce(of, F.concat(F.lit("có "), n("substantive"), F.lit(" thay đổi thực chất và "), n("formal"), F.lit(" thay đổi hình thức")))))


def report(results: DataFrame, stats: DataFrame, alerts: DataFrame | None = None, title: str = "BÁO CÁO SO SÁNH", date: str | None = None) -> DataFrame:
    """One Markdown text a pair of documents: summary with counters, details, additions, deletions."""
    rows = summary_line(results)
    kind = F.col("clause_change_kind")
    section = F.when(kind == "ADDED", F.lit(3)).when(kind == "DELETED", F.lit(4)).otherwise(F.lit(2))
    badge = F.lit("")
    for k, v in KINDS.items():
        badge = F.when(kind == k, F.lit(v)).otherwise(badge)
    body = F.concat(F.lit("### "), F.col("clause_id"), F.lit(" — "), badge, F.lit("\n"), F.col("summary"), F.lit("\n\n"), F.array_join(F.transform("records", record_lines), "\n"))
    parts = rows.select("pair_id", section.alias("section"), F.col("ord"), body.alias("line"))
    counters = F.concat(*[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"), F.lit("\n")) for c in COUNTERS])
    head = F.concat(F.lit(f"# {title}\n"), F.lit(f"Ngày: {date}\n") if date else F.lit(""), F.lit("\n## I. EXECUTIVE SUMMARY\n"), counters)
    parts = parts.unionByName(stats.select("pair_id", F.lit(0).alias("section"), F.lit(0).alias("ord"), head.alias("line")))
    if alerts is not None:
        parts = parts.unionByName(alerts.select("pair_id", F.lit(1).alias("section"), F.col("n").alias("ord"), F.concat(F.lit("> "), F.col("alert")).alias("line")))
    for n, name in ((2, "II. FULL DETAIL"), (3, "III. ĐIỀU KHOẢN/PHỤ LỤC THÊM MỚI"), (4, "IV. ĐIỀU KHOẢN BỊ LOẠI BỎ")):
        parts = parts.unionByName(stats.select("pair_id", F.lit(n).alias("section"), F.lit(-1).alias("ord"), F.lit(f"\n## {name}").alias("line")))
    ordered = F.array_sort(F.collect_list(F.struct("section", "ord", "line")))
    return parts.groupBy("pair_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("report_markdown"))


def grounded_points(points: DataFrame, changes: DataFrame, threshold: float = 0.38, most: int = 3) -> DataFrame:
    """A model's key points (pair_id, n, point) with the clauses of the up to `most` changes (pair_id, ord, clause_id, summary, and if there
    are any tags, old, new) that support them: alike in their summary, clause, tags or all together. Points without support, and those whose clauses an earlier point has, go."""
    point = F.col("point")
    tags = F.array_join("tags", " ") if "tags" in changes.columns else F.lit("")
    whole = F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (F.col("clause_id"), F.col("summary"), tags, *[F.col(c) for c in ("old", "new") if c in changes.columns])])
    score = F.greatest(*[T.dedupe_ratio(point, c) for c in (F.col("summary"), F.col("clause_id"), tags, whole)])
    rows = points.join(changes, "pair_id").withColumn("score", score).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("pair_id", "n").orderBy(F.col("score").desc(), "ord"))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("pair_id", "n", "point").agg(F.array_sort(F.collect_set("clause_id")).alias("clauses"))
    first = F.row_number().over(Window.partitionBy("pair_id", "clauses").orderBy("n"))
    return kept.withColumn("k", first).where("k = 1").drop("k")


def guarded_effect(records: DataFrame) -> DataFrame:
    """A model's effect (raw_effect) is taken where the tags, kind and entities don't speak against it."""
    from palimpsest.rules import OBVIOUS_TAGS

    r = F.col("record")
    fixed = F.arrays_overlap(r["tags"], F.array(*[F.lit(t) for t in OBVIOUS_TAGS])) | r["change_kind"].isin("ADDED", "DELETED") | (F.size(r["entity_changes"]) > 0)
    known = F.col("raw_effect").isin("SUBSTANTIVE", "LEXICAL_EQUIVALENT")
    effect = F.when(known & ~(fixed & (F.col("raw_effect") == "LEXICAL_EQUIVALENT")), F.col("raw_effect")).otherwise(r["semantic_effect"])
    return records.withColumn("effect", effect)
