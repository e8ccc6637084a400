"""Contradictions across the clauses of one comparison. clauses: pair_id, ord, clause_id, clause_change_kind, text_a, text_b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import rules
from palimpsest.functions import text as T


def metric_values(clauses: DataFrame, text: Column | None = None) -> DataFrame:
    """pair_id, metric, value and the set of clauses whose text states it."""
    c = F.col("text_b") if text is None else text
    rows = clauses.where("clause_change_kind <> 'DELETED'").select("pair_id", "clause_id", F.explode(T.metrics(c)).alias("metric", "vals"))
    rows = rows.select("pair_id", "clause_id", "metric", F.explode("vals").alias("value"))
    return rows.groupBy("pair_id", "metric", "value").agg(F.array_sort(F.collect_set("clause_id")).alias("clauses"))


def metric_conflicts(clauses: DataFrame) -> DataFrame:
    """Per metric the first two values, by number of clauses and value descending, that different clauses state."""
    found = metric_values(clauses)
    w = Window.partitionBy("pair_id", "metric").orderBy(F.size("clauses").desc(), F.col("value").desc())
    ranked = found.withColumn("rn", F.row_number().over(w))
    side = lambda n: ranked.select("pair_id", "metric", F.col("rn").alias(f"rn_{n}"), F.col("value").alias(f"value_{n}"), F.col("clauses").alias(f"clauses_{n}"))
    pairs = side("a").join(side("b"), ["pair_id", "metric"]).where("rn_a < rn_b AND NOT arrays_overlap(clauses_a, clauses_b)")
    first = F.row_number().over(Window.partitionBy("pair_id", "metric").orderBy("rn_a", "rn_b"))
    return pairs.withColumn("n", first).where("n = 1").drop("n", "rn_a", "rn_b")


def dangling_sla(clauses: DataFrame) -> DataFrame:
    """Pairs where a clause lost its SLA while others still refer to one."""
    has = lambda c: T.plain(F.col(c)).contains("sla")
    lost = clauses.where(F.col("clause_change_kind").isin("REPLACED", "DELETED") & has("text_a") & ~has("text_b"))
    refs = clauses.where(has("text_b")).join(lost.select("pair_id", "clause_id"), ["pair_id", "clause_id"], "left_anti")
    listed = lambda df, n, k: df.groupBy("pair_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "clause_id"))), lambda x: x["clause_id"]), 1, k).alias(n))
    return listed(lost, "anchors", 2).join(listed(refs, "references", 3), "pair_id")


def orphan_references(clauses: DataFrame) -> DataFrame:
    """Mentions of an article or annex that was deleted, with the first deleted clause that fits; both in plain form."""
    deleted = clauses.where("clause_change_kind = 'DELETED'").select("pair_id", F.col("ord").alias("deleted_ord"), F.col("clause_id").alias("deleted"), T.plain(F.col("clause_id")).alias("form"))
    mentions = clauses.select("pair_id", "ord", "clause_id", F.explode(T.found(T.plain(F.col("text_b")), r"điều\s+\d+|phụ\s*lục\s+[a-z]")).alias("mention"))
    hits = mentions.join(deleted, "pair_id").where(F.col("form").contains(F.col("mention")))
    first = F.row_number().over(Window.partitionBy("pair_id", "ord", "mention").orderBy("deleted_ord"))
    return hits.withColumn("n", first).where("n = 1").drop("n", "deleted_ord", "form")


def alerts(clauses: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` alerts of each pair in order (SLA, then orphans by clause, then metrics), without those that say what an earlier one says."""
    join = lambda c: F.array_join(c, ", ")
    two = lambda c: join(F.slice(c, 1, 2))
    label = F.create_map(*[F.lit(x) for kv in rules.METRIC_LABELS.items() for x in kv])
    place = F.array_position(F.array(*[F.lit(m) for m in rules.METRIC_LABELS]), F.col("metric"))
    row = lambda k, order, text, *parts: (F.col("pair_id"), F.struct(F.lit(k).alias("k"), order.cast("bigint").alias("at"), F.format_string(text, *parts).alias("alert")).alias("row"))
    sla = dangling_sla(clauses).select(*row(1, F.lit(0), rules.SLA_ALERT, join("references"), join("anchors")))
    lost = orphan_references(clauses).select(*row(2, F.col("ord"), rules.ORPHAN_ALERT, "clause_id", "mention", "deleted"))
    odd = metric_conflicts(clauses).select(*row(3, place, rules.METRIC_ALERT, label[F.col("metric")], "value_a", two("clauses_a"), "value_b", two("clauses_b")))
    rows = sla.unionByName(lost).unionByName(odd).groupBy("pair_id").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    told = rows.select("pair_id", T.distinct_texts(F.transform("rows", lambda r: r["alert"]), most=most).alias("told"))
    return told.select("pair_id", F.posexplode("told").alias("n", "alert")).withColumn("n", F.col("n") + 1)
