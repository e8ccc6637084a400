"""Questions over a comparison: a rule planner, candidate scoring, evidence and a deterministic answer, for many questions at once.

Questions are rows (question_id, session_id, question), plans are columns, and candidates meet the questions of their session in a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import rules
from palimpsest.functions import text as T


def _contains_any(c: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | c.contains(k)
    return out


def plan(questions: DataFrame) -> DataFrame:
    """questions with intent, answer_type, source, structured_limit, chunk_limit, clause_hint and four filters."""
    lower, plain, folded = F.lower(T.text(F.col("question"))), T.plain(F.col("question")), F.col("_folded")
    rows = questions.withColumn("_folded", T.folded(F.col("question")))
    labels = lambda listed: T.labels_of(folded, listed, {k: T.folded_word(k) for keys in listed.values() for k in keys})
    rows = rows.withColumns({
        "clause_hint": F.nullif(F.regexp_extract(lower, "(?iU)" + rules.CLAUSE_HINT, 1), F.lit("")),
        "tags": labels(rules.TAG_WORDS), "kinds": labels(rules.KIND_WORDS), "impacts": labels(rules.IMPACT_WORDS), "effects": labels(rules.EFFECT_WORDS),
    })
    quote, document, summary = _contains_any(lower, rules.QUOTE_WORDS), _contains_any(plain, rules.DOCUMENT_HINTS), _contains_any(plain, rules.SUMMARY_HINTS)
    hint = F.col("clause_hint").isNotNull()
    filters = (F.size("tags") + F.size("kinds") + F.size("impacts") + F.size("effects")) > 0
    row = lambda i, a, s, m, n, keep: F.struct(F.lit(i).alias("intent"), F.lit(a).alias("answer_type"), F.lit(s).alias("source"), F.lit(m).alias("structured_limit"), F.lit(n).alias("chunk_limit"), F.lit(keep).alias("keep"))
    chosen = (
        F.when(quote, row("quote_request", "document_answer", "chunk", 2, 3, "clause,tags"))
        .when(hint & document, row("clause_lookup", "document_answer", "hybrid", 3, 2, "clause,tags,kinds,impacts,effects"))
        .when(filters, row("filtered_change_query", "diff_answer", "structured", 5, 2, "clause,tags,kinds,impacts,effects"))
        .when(hint, row("clause_lookup", "diff_answer", "structured", 4, 2, "clause"))
        .when(summary, row("diff_summary", "diff_answer", "structured", 6, 0, ""))
        .otherwise(row("general", "diff_answer", "hybrid", 4, 2, ""))
    )
    rows = rows.withColumn("_p", chosen).select("*", "_p.*")
    none = F.array().cast("array<string>")
    kept = lambda c: F.when(F.col("keep").contains(c), F.col(c)).otherwise(none)
    rows = rows.withColumns({c: kept(c) for c in ("tags", "kinds", "impacts", "effects")})
    domain = F.lit(False)
    for k in rules.DOMAIN_HINTS:
        domain = domain | T.has_keyword(folded, k)
    rows = rows.withColumn("is_domain", domain | hint | filters | F.col("intent").isin("diff_summary", "quote_request"))
    return rows.withColumn("clause_hint", F.when(F.col("keep").contains("clause"), F.col("clause_hint"))).drop("_p", "keep", "_folded")


def lexical_score(question: Column, candidate: Column) -> Column:
    q, c = T.words(question), T.words(candidate)
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(F.lit(0.0))
    clause = F.nullif(F.regexp_extract(F.lower(question), "(?iU)" + rules.CLAUSE_HINT, 1), F.lit(""))
    boost = F.when(clause.isNotNull() & F.lower(candidate).contains(clause), F.lit(0.12)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 0.55 * overlap + 0.45 * T.sequence_ratio(T.plain(question), T.plain(candidate)) + boost)


def matches_clause(hint: Column, clause: Column) -> Column:
    return hint.isNull() | F.lower(T.text(clause)).contains(hint) | (lexical_score(hint, T.text(clause)) >= 0.55)


def passes_filters(candidates: DataFrame) -> DataFrame:
    """Rows of questions with candidates that no filter of the plan excludes (lists of the candidate: c_tags, c_kinds, c_impacts, c_effects)."""
    rows = candidates
    for f in ("tags", "kinds", "impacts", "effects"):
        rows = rows.where((F.size(f) == 0) | F.arrays_overlap(f, f"c_{f}"))
    return rows.where(matches_clause(F.col("clause_hint"), F.col("clause_id")))


def score_structured(rows: DataFrame) -> DataFrame:
    """Change and clause candidates with score, cut at 0.12 but for summaries, capped at 1.4."""
    c, change = F.col, F.col("candidate_type") == "change"
    plus = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    hit = lambda f: (F.size(f) > 0) & F.arrays_overlap(f, f"c_{f}")
    score = lexical_score(c("question"), c("search_text"))
    score = score + plus(change, 0.08) + F.when(change, 0.08 * F.least(F.coalesce("confidence_score", F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)) + plus(change & (c("impact_level") == "substantive"), 0.08)
    score = score + plus(~change, 0.04)
    score = F.when((c("intent") == "diff_summary") & change, F.greatest(score, F.lit(0.58))).otherwise(score)
    score = score + plus((c("intent") == "clause_lookup") & ~change, 0.18) + plus(c("clause_hint").isNotNull(), 0.25)
    score = score + plus(hit("tags"), 0.22) + plus(hit("kinds"), 0.16) + plus(hit("impacts"), 0.14) + plus(hit("effects"), 0.14)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.4), score), 4))
    return rows.where((c("intent") == "diff_summary") | (c("score") > 0.12))


def structured_hits(planned: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidates of each question within its limit; for summaries one a clause."""
    rows = planned.join(candidates.where("candidate_type <> 'chunk'"), "session_id")
    rows = rows.where(~((F.col("candidate_type") == "clause") & F.col("intent").isin("diff_summary", "filtered_change_query") & F.col("clause_hint").isNull()))
    rows = score_structured(passes_filters(rows))
    order = [F.col("score").desc(), "cand_ord"]
    clause = F.row_number().over(Window.partitionBy("question_id", "clause_id").orderBy(*order))
    rows = rows.withColumn("_c", clause).where((F.col("intent") != "diff_summary") | (F.col("_c") == 1)).drop("_c")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("structured_limit"))


def chunk_hits(planned: DataFrame, candidates: DataFrame) -> DataFrame:
    rows = planned.join(candidates.where("candidate_type = 'chunk'"), "session_id")
    hint = F.col("clause_hint")
    rows = rows.where(hint.isNull() | matches_clause(hint, F.col("clause_id")))
    score = lexical_score(F.col("question"), F.col("search_text")) + F.when(hint.isNotNull(), F.lit(0.28)).otherwise(F.lit(0.0)) + F.when(F.col("intent") == "quote_request", F.lit(0.14)).otherwise(F.lit(0.0))
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.3), score), 4)).where("score > 0.12")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "cand_ord"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.greatest("chunk_limit", F.lit(1)))


def evidence(planned: DataFrame, candidates: DataFrame) -> DataFrame:
    """The evidence of each question in order: structured hits, and chunks where the plan or a lack of hits asks for them."""
    columns = ["question_id", "candidate_type", "clause_id", "citation_id", "search_text", "impact_level", "score", "rank", "source", "intent", "question"]
    structured, chunks = structured_hits(planned, candidates).select(*columns), chunk_hits(planned, candidates).select(*columns)
    top = structured.groupBy("question_id").agg(F.max("score").alias("top"), F.every(F.when(F.col("rank") <= 2, F.col("impact_level") == "formal").otherwise(F.lit(True))).alias("formal"))
    chunks = chunks.join(top, "question_id", "left")
    few = F.col("top").isNull() | (~F.col("intent").isin("diff_summary", "filtered_change_query") & ((F.col("top") < 0.72) | (F.col("formal") & ~F.lower("question").contains("hình thức"))))
    use = (F.col("source") == "chunk") | ((F.col("source") == "hybrid") & few) | ((F.col("source") == "structured") & F.col("top").isNull() & (F.col("rank") == 1))
    chunks = chunks.where(use).drop("top", "formal")
    rows = structured.where("source <> 'chunk'").withColumn("part", F.lit(0)).unionByName(chunks.withColumn("part", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("part", "rank"))
    return rows.withColumn("ord", rank).drop("part", "rank", "source", "intent")


def answer(planned: DataFrame, found: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """answer_type, answer_markdown and citation_ids of each question. Questions off the subject by their best hit, or without evidence, are
    refused; where only chunks answer, or the plan asks for them, it is a document_answer.
    model: adds raw_answer and raw_citations for a language model; an answer without known citations, or with advice, isn't used."""
    words = T.words(F.col("question"))
    shared = F.size(F.array_intersect(words, T.words(F.col("search_text")))) / F.greatest(F.size(words), F.lit(1))
    listed = found.withColumn("overlap", shared).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "citation_id", "clause_id", "search_text"))).alias("items"), F.max("score").alias("best"), F.max_by("overlap", F.struct("score", -F.col("ord"))).alias("overlap"),
        F.max(F.col("candidate_type") == "chunk").alias("has_chunk"), F.max(F.col("candidate_type") != "chunk").alias("has_structured"),
    )
    rows = planned.join(listed, "question_id", "left")
    refuse = F.col("items").isNull() | (~F.col("is_domain") & ((F.col("best") < 0.72) | (F.col("overlap") < 0.34)))
    used = F.slice("items", 1, F.greatest(F.lit(3), F.least(F.lit(5), F.size("items"))))
    text = F.array_join(F.transform(used, lambda x: F.concat(F.lit("- "), F.coalesce(x["clause_id"], F.lit("")), F.lit(": "), T.truncate(x["search_text"]))), "\n")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "answer_type": F.when(refuse, F.lit("insufficient_evidence")).when(F.col("has_chunk") & ((F.col("source") == "chunk") | ~F.col("has_structured")), F.lit("document_answer")).otherwise(F.col("answer_type")),
        "answer_markdown": F.when(refuse, F.lit("Không đủ bằng chứng trong tài liệu để trả lời.")).otherwise(text),
        "citation_ids": F.when(refuse, none).otherwise(F.transform(used, lambda x: x["citation_id"])),
    })
    if model is not None:
        rows = model(rows)
        known = F.filter("raw_citations", lambda x: F.array_contains("citation_ids", x))
        good = ~refuse & (F.size(known) > 0) & ~F.lower("raw_answer").rlike("cần |nên ") & (T.squeeze(F.col("raw_answer")) != "")
        rows = rows.withColumns({"answer_markdown": F.when(good, F.col("raw_answer")).otherwise(F.col("answer_markdown")), "citation_ids": F.when(good, known).otherwise(F.col("citation_ids"))})
    return rows.select("question_id", "session_id", "question", "intent", "answer_type", "answer_markdown", "citation_ids")


def answer_deltas(answers: DataFrame, size: int = 32) -> DataFrame:
    """Answers in pieces of about `size` characters, cut after words, for clients that show them as they come."""
    pieces = F.regexp_extract_all(F.col("answer_markdown"), F.lit(rf"(?s).{{1,{size}}}(?=\s|$)\s?|.{{1,{size}}}"), F.lit(0))
    return answers.select("question_id", F.posexplode(pieces).alias("n", "delta"))
