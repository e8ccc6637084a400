"""Evaluation against annotated changes: pair scores, greedy one-to-one matching, precision and recall, guards, preset sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import rules
from palimpsest.functions import text as T
from palimpsest.functions.tables import cut

THRESHOLD = 0.08


def bucket(kind: Column) -> Column:
    out = F.lit("Other")
    for name, keys in reversed(rules.BUCKETS):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.lower(T.text(kind)).contains(k)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def type_hints(kind: Column) -> Column:
    form = T.evaluation_form(kind)
    return F.array_compact(F.array(*[F.when(form.rlike("|".join(keys)), F.lit(name)) for name, keys in rules.HINTS_OF_TYPE]))


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(T.text(p), F.lit("")) for p in parts])


def clause_tokens(c: Column) -> Column:
    return F.transform(T.found(c, r"điều\s+\d+[a-z]?|phụ\s+lục\s+[a-z0-9]+"), T.squeeze)


def anchors(form: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(form, F.lit(r"dieu\s+\d+[a-z]?|phu\s+luc\s+[a-z0-9]+|chuong\s+[ivxlcdm0-9]+"), F.lit(0)))


def raw_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.text(c), F.lit("(?U)" + rules.NUMBER), F.lit(0)))


def pair_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """predicted: case_name, pred_ord, clause_id, summary, change_kind, impact_level, semantic_effect, old, new, tags, meta_tags; truth:
    case_name, gt_ord, type, location, v1_content, v2_content. Scores of all pairs within a case, which is one pair of documents."""
    joined_tags = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    p = predicted.withColumn("p_text", joined(*[F.col(c) for c in ("clause_id", "summary", "change_kind", "impact_level", "semantic_effect", "old", "new")], joined_tags("tags"), joined_tags("meta_tags")))
    p = p.select("case_name", "pred_ord", "p_text", "impact_level", T.evaluation_form(F.col("p_text")).alias("p_form"), T.evaluation_form(F.coalesce(F.nullif("clause_id", F.lit("")), F.col("summary"))).alias("p_place"))
    g = truth.withColumn("g_text", joined(*[F.col(c) for c in ("location", "type", "v1_content", "v2_content")]))
    g = g.select(
        "case_name", "gt_ord", T.evaluation_form(F.col("g_text")).alias("g_form"), T.evaluation_form(F.col("location")).alias("g_place"), type_hints(F.col("type")).alias("hints"),
        F.array_union(raw_numbers(F.col("v1_content")), raw_numbers(F.col("v2_content"))).alias("g_numbers"),
    )
    rows = p.join(g, "case_name")
    c, has = F.col, lambda h: F.array_contains("hints", h)
    numbers = raw_numbers(c("p_text"))
    either = F.size(F.array_union(numbers, c("g_numbers")))
    jaccard = F.when((F.size(numbers) > 0) & (F.size("g_numbers") > 0), F.size(F.array_intersect(numbers, c("g_numbers"))) / either).otherwise(F.lit(0.0))
    anchor = F.when(F.arrays_overlap(anchors(c("p_form")), anchors(c("g_form"))), F.lit(0.18)).otherwise(F.lit(0.0))
    place = F.when((c("p_place") != "") & (c("g_place") != ""), T.sequence_ratio(c("p_place"), c("g_place"))).otherwise(F.lit(0.0))
    word = lambda *w: F.arrays_overlap(F.split("p_form", " "), F.array(*[F.lit(x) for x in w]))
    plus = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    bonus = plus(has("Số liệu") & word("so"), 0.05) + plus(has("Chính tả") & word("typo", "chinh", "ta"), 0.05) + plus(has("Định dạng") & word("format", "table", "structural"), 0.05) + plus(has("SUBSTANTIVE") & (c("impact_level") == "substantive"), 0.06)
    score = 0.46 * T.sequence_ratio(c("p_form"), c("g_form")) + 0.26 * place + 0.16 * jaccard + 0.12 * anchor + bonus
    return rows.select("case_name", "pred_ord", "gt_ord", F.when((c("p_form") == "") | (c("g_form") == ""), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0))).alias("score"))


def greedy_match(scores: DataFrame, threshold: float = THRESHOLD, most: int = 500_000) -> DataFrame:
    """One-to-one pairs by descending score, ties in order of pred_ord and gt_ord.

    A pair that is the first in that order among all that share its prediction, and among all that share its truth, is one that going through them in order takes; so rounds that take all such pairs and drop
    what shares something with them give the same result. Cases with more than `most` pairs take rounds of joins, spread over all tasks, until no more than that are left; the others are dealt into
    groups of about `most` pairs, which take the same rounds in memory. Pairs without a case are none."""
    columns = ["case_name", "pred_ord", "gt_ord", "score"]
    left = scores.where((F.col("score") >= threshold) & F.col("case_name").isNotNull()).select(*columns)
    sizes = cut(left.groupBy("case_name").agg(F.count(F.lit(1)).alias("n")))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    taken = None
    while largest > most:
        large = sizes.where(F.col("n") > most).select("case_name")
        pairs = cut(left.join(large, "case_name", "left_semi"))
        first = [pairs.groupBy("case_name", by).agg(F.min(F.struct((-F.col("score")).alias("s"), "pred_ord", "gt_ord")).alias("first")).select("case_name", "first.pred_ord", "first.gt_ord", "first.s") for by in ("pred_ord", "gt_ord")]
        chosen = cut(first[0].join(first[1].drop("s"), ["case_name", "pred_ord", "gt_ord"]).select("case_name", "pred_ord", "gt_ord", (-F.col("s")).alias("score")))
        taken = chosen if taken is None else taken.unionByName(chosen)
        for by in ("pred_ord", "gt_ord"):
            pairs = pairs.join(chosen.select("case_name", by), ["case_name", by], "left_anti")
        left = cut(left.join(large, "case_name", "left_anti").unionByName(pairs.select(*columns)))
        sizes = cut(left.groupBy("case_name").agg(F.count(F.lit(1)).alias("n")))
        total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    dealt = left.groupBy(F.pmod(F.xxhash64("case_name"), F.lit(max(1, -(-total // most)))).alias("group"))
    found = dealt.applyInArrow(_greedy, left.schema)
    return found if taken is None else found.unionByName(taken)


def _greedy(rows: pa.Table) -> pa.Table:
    """Rounds over the pairs of some cases."""
    rows = rows.select(["case_name", "pred_ord", "gt_ord", "score"]).sort_by([("case_name", "ascending"), ("score", "descending"), ("pred_ord", "ascending"), ("gt_ord", "ascending")])
    case, p, g = (rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) for c in ("case_name", "pred_ord", "gt_ord"))
    ends = [np.unique(case * (side.max(initial=0) + 2) + side, return_inverse=True)[1] for side in (p, g)]
    alive, kept = np.arange(len(case)), []
    used = [np.zeros(len(case), dtype=bool) for _ in ends]
    while len(alive):
        best = []
        for end in ends:
            first = np.zeros(len(case), dtype=np.int64)
            first[end[alive][::-1]] = alive[::-1]  # the last one written is the first in order
            best.append(first[end[alive]] == alive)
        chosen = alive[best[0] & best[1]]
        kept.append(chosen)
        for end, mark in zip(ends, used, strict=True):
            mark[end[chosen]] = True
        alive = alive[~used[0][ends[0][alive]] & ~used[1][ends[1][alive]]]
        if 100 * len(chosen) < len(alive):  # long chains: one after the other takes as long as there are pairs
            for k in alive.tolist():
                if not used[0][ends[0][k]] and not used[1][ends[1][k]]:
                    used[0][ends[0][k]] = used[1][ends[1][k]] = True
                    kept.append(np.array([k]))
            break
    return rows.take(pa.array(np.sort(np.concatenate(kept)) if kept else np.zeros(0, dtype=np.int64)))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1")]


def case_metrics(matches: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per case and, with a null case_name, for all cases together (micro): tp, fp, fn, precision, recall, f1."""
    count = lambda df, n: df.groupBy("case_name").agg(F.count(F.lit(1)).alias(n))
    rows = count(truth, "gt").join(count(predicted, "pred"), "case_name", "full_outer").join(count(matches, "tp"), "case_name", "left").na.fill(0)
    rows = rows.rollup("case_name").agg(F.sum("tp").alias("tp"), (F.sum("pred") - F.sum("tp")).alias("fp"), (F.sum("gt") - F.sum("tp")).alias("fn"))
    return rows.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.where("case_name IS NOT NULL").agg(*[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def guards(reports: DataFrame, truth: DataFrame) -> DataFrame:
    """reports: case_name, preset, report, atomic_changes. Recall of the truth's clauses and numbers in the report, and volume."""
    gathered = truth.groupBy("case_name").agg(
        F.array_distinct(F.flatten(F.collect_list(F.concat(*[clause_tokens(F.col(c)) for c in ("location", "v1_content", "v2_content")])))).alias("g_clauses"),
        F.array_distinct(F.flatten(F.collect_list(F.concat(raw_numbers(F.col("v1_content")), raw_numbers(F.col("v2_content")))))).alias("g_numbers"), F.count(F.lit(1)).alias("expected"),
    )
    rows = reports.join(gathered, "case_name")
    recall = lambda want, have: F.round(F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(F.lit(1.0)), 4)
    volume = F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("atomic_changes") - F.col("expected")) / F.col("expected")), 4)
    return rows.select("case_name", "preset", recall(F.col("g_clauses"), clause_tokens(F.col("report"))).alias("clause_recall"), recall(F.col("g_numbers"), raw_numbers(F.col("report"))).alias("number_recall"), volume.alias("volume_alignment"))


def sweep(scored: DataFrame) -> DataFrame:
    """Averages of each preset, its composite, and which is recommended (the first by name on ties)."""
    means = scored.groupBy("preset").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("clause_recall", "number_recall", "volume_alignment")])
    means = means.withColumn("composite", F.round(0.45 * F.col("clause_recall") + 0.45 * F.col("number_recall") + 0.1 * F.col("volume_alignment"), 4))
    best = means.agg(F.max(F.struct("composite")).alias("b"), F.min_by("preset", F.struct(-F.col("composite"), "preset")).alias("name"))
    return means.join(F.broadcast(best.select("name"))).withColumn("recommended", F.col("preset") == F.col("name")).drop("name")


def dataset_statistics(truth: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts of the three buckets, and the most frequent types."""
    kinds = truth.groupBy(bucket(F.col("type")).alias("bucket")).agg(F.count(F.lit(1)).alias("changes"))
    types = truth.groupBy("type").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.col("changes").desc(), "type").limit(most)
    return kinds, types


def stage_shares(timings: DataFrame) -> DataFrame:
    """timings: stage, seconds. Sum, extremes and share of each stage."""
    sums = timings.groupBy("stage").agg(F.sum("seconds").alias("total"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.avg("seconds").alias("mean"))
    return sums.join(F.broadcast(sums.agg(F.sum("total").alias("all")))).withColumn("share", F.round(F.col("total") / F.col("all"), 6)).drop("all")


def estimated_prf(cases: DataFrame) -> DataFrame:
    """Of a baseline's cases (gt_changes, predicted_atomic_changes, clause_recall): precision, recall and F1 if the mean recall of clauses held for changes."""
    sums = cases.agg(F.sum("gt_changes").alias("total_gt"), F.sum("predicted_atomic_changes").alias("total_pred"), F.round(F.avg("clause_recall"), 4).alias("mean"))
    matched = F.least(F.col("total_gt").cast("double"), F.col("total_pred").cast("double"), F.col("mean") * F.col("total_gt"))
    p, r = F.coalesce(F.try_divide("matched", "total_pred"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "total_gt"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return sums.withColumn("matched", matched).select(F.round(p, 4).alias("precision_est"), F.round(r, 4).alias("recall_est"), F.round(f1, 4).alias("f1_est"), "total_gt", "total_pred")


def mean_judge_score(judged: DataFrame) -> DataFrame:
    """judged: score, null where the judge gave none."""
    return judged.agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count("score").alias("scored"), F.count(F.lit(1)).alias("cases"))


def pseudo_report(records: DataFrame) -> DataFrame:
    """Clause ids and texts of all records (pair_id, ord, clause_id, records) as one text a pair, for the guards."""
    parts = F.array_compact(F.concat(F.array("clause_id"), F.flatten(F.transform("records", lambda r: F.array(r["old"], r["new"])))))
    rows = records.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", parts.alias("parts")))).alias("rows"))
    return rows.select("pair_id", F.array_join(F.flatten(F.transform("rows", lambda x: x["parts"])), "\n").alias("report"))


def markdown_metrics(logs: DataFrame) -> DataFrame:
    """logs: name, markdown. The figures that a benchmark's log states, each by the first of its patterns that fits; precision at 1 and 3 if
    each query has one right answer."""

    def first(patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("markdown", f"(?i){p}", 1), F.lit("")).try_cast("double") for p in patterns])

    rows = logs.select("name", *[first(patterns).alias(name) for name, patterns in rules.LOG_FIGURES.items()])
    return rows.withColumns({"precision_at1": F.col("hit_rate_at1_pct") / 100, "precision_at3_single_rel": F.col("hit_rate_at3_pct") / 100 / 3})
