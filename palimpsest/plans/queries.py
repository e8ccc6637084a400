"""Queries over the driver's tables, one for each operator that they can show, with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import ids
from palimpsest.functions import text as T
from palimpsest.functions.tables import cut, once, shared_dir
from palimpsest.operators import align, anomalies, changes, chat, chunks, enrich, evaluate, report, retrieval, session_store, sessions, vector_index
from palimpsest.plans import compare
from palimpsest.rules import PRESETS, Settings
from palimpsest.sources import paragraphs
from palimpsest.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


#: SQL of lines and of squeezed text.
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"
SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query()
def version_changes(spark, d):
    """Flagship: near copies paired as versions, lines aligned, changes counted."""
    return compare.line_statistics(compare.compare_lines(compare.version_pairs(table(spark, d, "documents"))))


@query(f"SELECT doc_id, substr(sha1(lower({SQUEEZED})), 1, 12) AS fingerprint FROM documents")
def chunk_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT doc_id, md5(replace(regexp_replace(translate(trim(regexp_replace(nfc_normalize(text), '[ \\t]+', ' ', 'g')), '“”‘’', '\"\"'''''), '[–—]', '-', 'g'), '…', '...')) AS text_md5 FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("text_md5"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(trim(line), '^([0-9]+|-{{3,}}|_{{3,}}|\\.{{3,}}|confidential)$')) AS n_noise FROM l GROUP BY doc_id")
def noise_filter(spark, d):
    return _lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_noise(T.strip(F.col("line")))).alias("n_noise"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM l")
def line_offsets(spark, d):
    return chunks.line_offsets(_lines(spark, d), ["doc_id"], text="line").select("doc_id", "pos", "offset")


@query(f"WITH l AS ({LINES}) SELECT doc_id, pos, array_to_string(list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> ''), ' | ') AS row_text FROM l WHERE contains(line, '|')")
def table_row_normal(spark, d):
    return _lines(spark, d).where(F.col("line").contains("|")).select("doc_id", "pos", T.table_row(F.col("line")).alias("row_text"))


@query(
    f"WITH l AS ({LINES}) SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?s)\\*\\*\\*(.*?)\\*\\*\\*', '\\1', 'g'), "
    "'(?s)\\*\\*(.*?)\\*\\*', '\\1', 'g'), '(?s)\\*(.*?)\\*', '\\1', 'g'), '(?s)__(.*?)__', '\\1', 'g'), '(?s)_(.*?)_', '\\1', 'g'), '`([^`]+)`', '\\1', 'g')) AS stripped FROM l WHERE regexp_matches(line, '[*_`]')"
)
def markdown_strip(spark, d):
    return _lines(spark, d).where(F.col("line").rlike("[*_`]")).select("doc_id", "pos", T.strip_markdown(F.col("line")).alias("stripped"))


@query(
    f"WITH l AS ({LINES}), s AS (SELECT regexp_replace(line, '^[*_#\\s]+', '') AS x FROM l) SELECT CASE WHEN regexp_matches(x, '^(CHƯƠNG|Chương|PH[AẦ]N|Phần)\\s+[IVXLC\\d]+') THEN 'Heading 1' "
    "WHEN regexp_matches(x, '^(Đi[eề]u|ĐI[EỀ]U)\\s+\\d+') THEN 'Heading 2' WHEN regexp_matches(x, '^\\d+\\.\\d+[. ]') THEN 'Heading 3' ELSE 'Normal' END AS style, count(*) AS n FROM s GROUP BY style"
)
def style_detect(spark, d):
    return _lines(spark, d).groupBy(T.line_style(F.col("line")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, CASE WHEN length({SQUEEZED}) > 240 THEN rtrim(substr({SQUEEZED}, 1, 237)) || '...' ELSE {SQUEEZED} END AS snippet, substr({SQUEEZED}, 1, 1200) AS clipped FROM documents")
def truncate_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("snippet"), T.clip(F.col("text")).alias("clipped"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b\\d+(?:[.,]\\d+)?%?\\b'))), ' ') AS numbers FROM documents")
def number_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.numbers(F.col("text"))), " ").alias("numbers"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[\\p{L}\\p{N}_]+'), lambda x: lower(x)))), ' ') AS emails FROM documents")
def email_subjects(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.subjects(F.col("text"))), " ").alias("emails"))


@query("SELECT conv_id, turn, len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: length(x) > 1))) AS n_words FROM conversations")
def word_sets(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"))


@query("SELECT conv_id, turn, md5(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS form_md5 FROM conversations")
def folded_form(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.folded(F.col("text"))).alias("form_md5"))


@query(
    f"WITH l AS ({LINES}), o AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(replace(replace(line, '–', '-'), '<br>', ' '), '\\s+', ' ', 'g')), '^[-*•]+\\s*', '') AS own FROM l), "
    "j AS (SELECT doc_id, regexp_replace(lower(string_agg(own, ' ' ORDER BY pos)), '\\s+', ' ', 'g') AS t FROM o GROUP BY doc_id) "
    "SELECT doc_id, md5(trim(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(t, ''), ' ?([,.;:])', '\\1', 'g'), '([,.;:])', '\\1 ', 'g'), ',  ', ', '), '.  ', '. '), ';  ', '; '), ':  ', ': '))) AS form_md5 "
    "FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN j USING (doc_id)"
)
def semantic_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.semantic_form(F.col("text"))).alias("form_md5"))


@query("SELECT o_orderkey, 'change_' || substr(sha1(o_orderkey::VARCHAR || '||' || o_custkey::VARCHAR || '||' || o_orderstatus), 1, 12) AS stable_id FROM orders")
def stable_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.stable_id("change", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("stable_id"))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.35 * l_quantity / 50 + 0.25 * l_discount * 10 + 0.25 * l_tax * 10 + 0.15)), 9) AS s FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, s AS score, CASE WHEN s >= 0.85 THEN 'HIGH' WHEN s >= 0.6 THEN 'MEDIUM' WHEN s >= 0.3 THEN 'LOW' ELSE 'SUSPECT' END AS band FROM x"
)
def confidence_band(spark, d):
    """The inputs have two decimals, so nine decimals of a score are exact, and a score on a band's border is on it in any engine."""
    c = F.col
    rows = table(spark, d, "lineitem").withColumn("score", F.round(changes.confidence(c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 10, F.lit(1.0)), 9))
    return rows.select("l_orderkey", "l_linenumber", "score", changes.band(c("score")).alias("band"))


_UNIT = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query(
    f"WITH x AS {_UNIT}, p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(1 - list_cosine_similarity(q.e, i.e), 6) AS distance FROM x q JOIN x i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 20 = 0) "
    "SELECT query_id, item_id, distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) <= 5"
)
def cosine_topk(spark, d):
    """Queries are the rows whose id is divisible by 20, against all rows of their label."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return retrieval.nearest(x.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), x.withColumnRenamed("vec_id", "item_id"), 5, "label").select("query_id", "item_id", "distance")


@query(
    f"WITH x AS {_UNIT}, p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(1 - list_cosine_similarity(q.e, i.e), 6) AS distance FROM x q, x i WHERE q.label = 0 AND i.label = 1 AND q.vec_id % 20 = 0) "
    "SELECT query_id, item_id, distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) <= 3"
)
def cross_retrieval(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    return retrieval.nearest(x.where("label = 0 AND vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), x.where("label = 1").withColumnRenamed("vec_id", "item_id"), 3).select("query_id", "item_id", "distance")


def _indexed(spark: SparkSession, d: str, exact: bool) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    index = vector_index.build(x.withColumnRenamed("vec_id", "item_id"))
    return vector_index.search(index, x.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), exact=exact)


@query()
def vector_index_topk(spark, d):
    return _indexed(spark, d, exact=False)


@query(
    f"WITH x AS {_UNIT}, p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(1 - list_cosine_similarity(q.e, i.e), 6) AS distance FROM x q, x i WHERE q.vec_id % 20 = 0 AND i.vec_id <> q.vec_id) "
    "SELECT query_id, item_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS INT) AS rank FROM p QUALIFY rank <= 5"
)
def vector_index_exact(spark, d):
    return _indexed(spark, d, exact=True)


@query(
    f"WITH x AS {_UNIT}, p AS (SELECT q.vec_id AS query_id, q.label = i.label AS hit, round(1 - list_cosine_similarity(q.e, i.e), 6) AS distance, i.vec_id AS item_id FROM x q, x i WHERE q.vec_id % 20 = 0 AND i.vec_id <> q.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM p QUALIFY rank <= 3), f AS (SELECT query_id, min(rank) FILTER (hit) AS rank FROM r GROUP BY query_id) "
    "SELECT count(*) AS queries, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS hit_at_1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM f"
)
def hit_at_k_mrr(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    found = retrieval.nearest(x.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), x.withColumnRenamed("vec_id", "item_id"), 3)
    labels = x.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), x.select(F.col("vec_id").alias("item_id"), F.col("label").alias("il"))
    ranks = found.join(labels[0], "query_id").join(labels[1], "item_id").groupBy("query_id").agg(F.min(F.when(F.col("ql") == F.col("il"), F.col("rank"))).alias("rank"))
    return retrieval.hit_metrics(ranks)


@query(
    "WITH n AS (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation) SELECT a.n_nationkey AS i, b.n_nationkey AS j, round(1.0 / (1 + abs(a.n_nationkey - b.n_nationkey)) + CASE WHEN greatest(a.k, b.k) >= 3 THEN 0.08 * (lower(a.n_name) = lower(b.n_name))::INT ELSE 0 END, 6) AS sim FROM n a JOIN n b USING (n_regionkey)"
)
def sim_matrix_bonus(spark, d):
    n = table(spark, d, "nation").withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("n_regionkey")))
    side = lambda s: n.select("n_regionkey", F.col("n_nationkey").alias(s), F.lower("n_name").alias(f"clause_{'a' if s == 'i' else 'b'}"), F.col("k").alias(f"n_{'a' if s == 'i' else 'b'}"))
    cells = side("i").join(side("j"), "n_regionkey").withColumn("sim", 1 / (1 + F.abs(F.col("i") - F.col("j"))))
    return align.with_bonus(cells).select("i", "j", F.round("sim", 6).alias("sim"))


@query()
def nw_align(spark, d):
    """Lines of version pairs as chunks, anchored, embedded and aligned globally. Only lines between anchors are embedded."""
    pairs = cut(compare.version_pairs(table(spark, d, "documents")))
    side = lambda c: pairs.select("pair_id", F.posexplode(T.lines(F.col(c))).alias("i", "content"))
    both = []
    for c in ("text_a", "text_b"):
        rows = side(c).withColumns({"key": T.plain(F.col("content")), "clause": F.substring_index(T.plain(F.col("content")), " ", 2)})
        both.append(cut(rows))
    found = cut(align.runs(*both))
    asked = align.in_gaps(found)
    own = lambda rows, s: rows.join(asked.where(F.col("side") == s).select("pair_id", "i"), ["pair_id", "i"], "left_semi")
    a, b = (retrieval.embed(own(rows, s), retrieval.HashingEmbedder())[0] for rows, s in zip(both, "ab", strict=True))
    return align.align(a, b, found=found)


@query()
def seq_ratio(spark, d):
    pairs = compare.version_pairs(table(spark, d, "documents"))
    return pairs.select("pair_id", F.round(T.text_ratio(F.col("text_a"), F.col("text_b")), 4).alias("ratio"))


@query(
    "WITH p AS (SELECT o_orderkey, (o_totalprice % 1000) / 1000 AS s, CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS r FROM orders) SELECT o_orderkey, CASE WHEN s >= 0.95 AND r < 0.998 THEN 'MODIFIED' WHEN s >= 0.95 AND s < 0.97 THEN 'MODIFIED' WHEN s >= 0.95 THEN 'UNCHANGED' WHEN s >= 0.75 THEN 'MODIFIED' ELSE 'DELETED' END AS match_type, "
    "(s >= 0.95 AND r >= 0.998 AND s < 0.97) OR (s >= 0.93 AND s < 0.95) AS near_threshold FROM p UNION ALL SELECT o_orderkey, 'ADDED', false FROM p WHERE s < 0.75"
)
def classify_pairs(spark, d):
    c = F.col
    pairs = table(spark, d, "orders").select(
        "o_orderkey", ((c("o_totalprice") % 1000) / 1000).alias("sim"), F.when(c("o_custkey") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("ratio"), F.lit(False).alias("anchored"), F.lit("a").alias("text_a"), F.lit("b").alias("text_b")
    )
    return align.classify(pairs).select("o_orderkey", "match_type", "near_threshold")


_KINDS = "CASE event_id % 3 WHEN 0 THEN 'DELETED' WHEN 1 THEN 'ADDED' ELSE 'MODIFIED' END"


def _event_clauses(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, F.lit("DELETED")).when(F.col("event_id") % 3 == 1, F.lit("ADDED")).otherwise(F.lit("MODIFIED"))
    return e.select(F.col("user_id").cast("string").alias("pair_id"), F.col("event_id").alias("ord"), kind.alias("match_type"), F.col("event_type").alias("clause_id"), F.lit("x").alias("text_a"), F.lit("y").alias("text_b"), F.col("value").alias("similarity"))


@query(
    f"WITH e AS (SELECT user_id::VARCHAR AS pair_id, event_id AS ord, {_KINDS} AS k, event_type AS c, value AS s FROM events), "
    "n AS (SELECT *, coalesce(((k = 'DELETED' AND lead(k) OVER w = 'ADDED') OR (k = 'ADDED' AND lead(k) OVER w = 'DELETED')) AND c = lead(c) OVER w, false) AS edge, lead(s) OVER w AS s2 FROM e WINDOW w AS (PARTITION BY pair_id ORDER BY ord)), "
    "g AS (SELECT *, sum((NOT edge)::INT) OVER (PARTITION BY pair_id ORDER BY ord) - (NOT edge)::INT AS run FROM n), "
    "m AS (SELECT *, edge AND row_number() OVER (PARTITION BY pair_id, run ORDER BY ord) % 2 = 1 AS merge FROM g), "
    "u AS (SELECT *, coalesce(lag(merge) OVER (PARTITION BY pair_id ORDER BY ord), false) AS used FROM m) "
    "SELECT pair_id, ord, CASE WHEN merge THEN 'REPLACED' ELSE k END AS match_type, CASE WHEN merge THEN greatest(s, s2) ELSE s END AS similarity FROM u WHERE NOT used"
)
def collapse_replacements(spark, d):
    return changes.collapse(_event_clauses(spark, d)).select("pair_id", "ord", "match_type", "similarity")


@query(f"WITH e AS (SELECT user_id::VARCHAR AS pair_id, {_KINDS} AS k FROM events) SELECT pair_id, count(*) FILTER (k = 'UNCHANGED') AS unchanged, count(*) FILTER (k = 'MODIFIED') AS modified, count(*) FILTER (k = 'ADDED') AS added, count(*) FILTER (k = 'DELETED') AS deleted FROM e GROUP BY pair_id")
def match_histogram(spark, d):
    return report.match_counters(_event_clauses(spark, d))


@query("SELECT user_id::VARCHAR AS pair_id, arg_max(event_id, struct_pack(v := value, i := -event_id)) AS best_event, max(value) AS best_value FROM events GROUP BY user_id")
def best_record(spark, d):
    """A user's events as the records of one clause, in order."""
    record = F.struct("event_id", F.col("value").alias("confidence_score"))
    rows = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("pair_id")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    return changes.best_record(rows).select("pair_id", F.col("best.event_id").alias("best_event"), F.col("best.confidence_score").alias("best_value"))


@query(
    "WITH m AS (SELECT l_orderkey::VARCHAR AS pair_id, l_quantity::INT::VARCHAR AS value, list_sort(list(DISTINCT 'Điều ' || l_linenumber)) AS clauses FROM lineitem GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY len(clauses) DESC, value DESC) AS rn FROM m) SELECT a.pair_id, 'uptime_percent' AS metric, a.value AS value_a, b.value AS value_b FROM r a JOIN r b USING (pair_id) "
    "WHERE a.rn < b.rn AND NOT list_has_any(a.clauses, b.clauses) QUALIFY row_number() OVER (PARTITION BY a.pair_id ORDER BY a.rn, b.rn) = 1"
)
def metric_conflicts(spark, d):
    """Orders as comparisons whose lines are clauses, each of which states its quantity as an uptime."""
    c, text = F.col, F.concat(F.lit("Cam kết uptime "), F.col("l_quantity").cast("int").cast("string"), F.lit(" % mỗi tháng"))
    clauses = table(spark, d, "lineitem").select(
        c("l_orderkey").cast("string").alias("pair_id"), F.concat(F.lit("Điều "), c("l_linenumber").cast("string")).alias("clause_id"), F.lit("MODIFIED").alias("clause_change_kind"), text.alias("text_b")
    )
    return anomalies.metric_conflicts(clauses).select("pair_id", "metric", "value_a", "value_b")


@query(
    "WITH c AS (SELECT (c_custkey // 50)::VARCHAR AS pair_id, c_custkey AS ord, c_name AS clause_id, c_acctbal < 0 AS lost, c_acctbal < 5000 AS names FROM customer), "
    "a AS (SELECT pair_id, list(clause_id ORDER BY ord, clause_id)[1:2] AS anchors FROM c WHERE lost GROUP BY pair_id), "
    "b AS (SELECT pair_id, list(clause_id ORDER BY ord, clause_id)[1:3] AS refs FROM c WHERE names AND NOT lost GROUP BY pair_id) "
    "SELECT pair_id, array_to_string(anchors, ' ') AS anchors, array_to_string(refs, ' ') AS refs FROM a JOIN b USING (pair_id)"
)
def anti_anchor_refs(spark, d):
    """Customers as clauses, fifty a comparison: those in debt lost their SLA, others below 5000 still name one."""
    c, debt = F.col, F.col("c_acctbal") < 0
    clauses = table(spark, d, "customer").select(
        F.floor(c("c_custkey") / 50).cast("string").alias("pair_id"), c("c_custkey").alias("ord"), c("c_name").alias("clause_id"), F.when(debt, F.lit("REPLACED")).otherwise(F.lit("MODIFIED")).alias("clause_change_kind"),
        F.when(debt, F.lit("SLA: 4 giờ")).otherwise(F.lit("x")).alias("text_a"), F.when(~debt & (c("c_acctbal") < 5000), F.lit("Theo SLA.")).otherwise(F.lit("y")).alias("text_b"),
    )
    return anomalies.dangling_sla(clauses).select("pair_id", F.array_join("anchors", " ").alias("anchors"), F.array_join("references", " ").alias("refs"))


@query(f"WITH k AS (SELECT source, substr(sha256('hashing-8||{retrieval.DOCUMENT_INSTRUCTION}: ' || text), 1, 16) AS cache_key FROM documents) SELECT DISTINCT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE source = 'src0')")
def cache_miss_anti(spark, d):
    """What is embedded anew when one source's vectors are cached already."""
    docs, embedder = table(spark, d, "documents").select("source", "text"), retrieval.HashingEmbedder(8)
    cache = retrieval.embed(docs.where("source = 'src0'"), embedder, text="text")[1]
    return retrieval.embed(docs, embedder, text="text", cache=cache)[1].select("cache_key")


@query(
    "WITH b AS (SELECT o_custkey AS k, count(*) AS n_b FROM orders GROUP BY 1) SELECT coalesce(c_custkey, k) AS role, n_b, CASE WHEN n_b IS NULL THEN 'DELETED' WHEN c_custkey IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS kind FROM customer FULL JOIN b ON c_custkey = k"
)
def full_outer_roles(spark, d):
    """The join of roles by a full outer join: customers on one side, those who ordered on the other."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("role"), F.lit(True).alias("known"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("role")).agg(F.count(F.lit(1)).alias("n_b"))
    kind = F.when(F.col("n_b").isNull(), F.lit("DELETED")).when(F.col("known").isNull(), F.lit("ADDED")).otherwise(F.lit("MODIFIED"))
    return a.join(b, "role", "full_outer").select("role", "n_b", kind.alias("kind"))


@query("SELECT 'chunk' AS candidate_type, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'clause', item_id, length(text) FROM benchmark UNION ALL SELECT 'change', conv_id * 1000 + turn, length(text) FROM conversations")
def candidate_union(spark, d):
    n = F.length("text").alias("n")
    a = table(spark, d, "documents").select(F.lit("chunk").alias("candidate_type"), F.col("doc_id").alias("id"), n)
    b = table(spark, d, "benchmark").select(F.lit("clause").alias("candidate_type"), F.col("item_id").alias("id"), n)
    c = table(spark, d, "conversations").select(F.lit("change").alias("candidate_type"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), n)
    return a.unionByName(b).unionByName(c)


@query()
def question_plans(spark, d):
    q = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("question"))
    return chat.plan(q).select("question_id", "intent", "answer_type", "source", "structured_limit", "chunk_limit", "is_domain")


@query(
    "WITH s AS (SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM s QUALIFY rank <= 6"
)
def diff_summary_topk(spark, d):
    """The best event of each type (clause) of a user, and of these the six best."""
    order = [F.col("value").desc(), F.col("event_id")]
    rows = retrieval_newest(table(spark, d, "events"), ["user_id", "event_type"], order, 1).drop("rn")
    return retrieval_newest(rows, ["user_id"], order, 6).select("user_id", "event_type", "event_id", F.col("rn").alias("rank"))


retrieval_newest = sessions.newest


@query("WITH m AS (SELECT o_custkey AS message_id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS l FROM orders GROUP BY 1), u AS (SELECT message_id, unnest(l) AS id, generate_subscripts(l, 1) - 1 AS n FROM m) SELECT message_id, n, id AS citation_id, o_orderstatus AS body FROM u JOIN orders ON id = o_orderkey")
def citations_in_order(spark, d):
    o = table(spark, d, "orders")
    m = o.groupBy(F.col("o_custkey").alias("message_id")).agg(F.array_sort(F.collect_list(F.struct(-F.col("o_totalprice"), "o_orderkey"))).alias("l")).withColumn("citation_ids", F.transform("l", lambda x: x["o_orderkey"]))
    return sessions.cited(m, o.select(F.col("o_orderkey").alias("citation_id"), F.col("o_orderstatus").alias("body"))).select("message_id", "n", "citation_id", "body")


@query("SELECT conv_id AS session_id, count(*) AS n_messages, string_agg(turn::VARCHAR || ':' || role, ',' ORDER BY turn, role) AS messages FROM conversations GROUP BY conv_id")
def session_nested(spark, d):
    c = table(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("session_id")).distinct()
    m = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role", F.lit("").alias("content"))
    none = s.select("session_id", F.lit("x").alias("citation_type"), F.lit("y").alias("citation_id")).where("false")
    rows = sessions.nested(s, none, m)
    return rows.select("session_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(F.transform("messages", lambda x: F.concat(x["message_id"].cast("string"), F.lit(":"), x["role"])), ",").alias("messages"))


def _session_log(events: DataFrame, session: Column) -> DataFrame:
    """Events as a log of sessions: purchases complete them, errors are failures."""
    kind = F.when(F.col("event_type") == "purchase", F.lit("completed")).when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("step"))
    return events.select(session.cast("string").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("event_type").alias("step"), F.lit(None).cast("string").alias("detail"), F.col("ts").cast("timestamp").alias("ts"))


@query(
    "WITH e AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'step' END AS event, event_type AS step FROM events) SELECT session_id, CASE WHEN count(*) FILTER (event = 'completed') > 0 THEN 'completed' WHEN count(*) FILTER (event = 'failed') > 0 THEN 'failed' ELSE 'processing' END AS status, "
    "CASE WHEN count(*) FILTER (event = 'completed') > 0 THEN 'completed' ELSE arg_max(step, seq) FILTER (event = 'step') END AS last_step FROM e GROUP BY session_id"
)
def session_state_latest(spark, d):
    return sessions.state(_session_log(table(spark, d, "events"), F.col("user_id"))).select("session_id", "status", "last_step")


@query("WITH c AS (SELECT DISTINCT 'run_' || (n_nationkey * 7) AS collection, n_nationkey * 7 AS k FROM nation) SELECT collection FROM c QUALIFY row_number() OVER (ORDER BY k DESC) > 5")
def retention_topk(spark, d):
    c = table(spark, d, "nation").select(F.concat(F.lit("run_"), (F.col("n_nationkey") * 7).cast("string")).alias("collection"))
    return retrieval.stale_collections(c)


@query(
    "WITH p AS (SELECT lang AS case_name, (n_chars > 600)::INT AS p, quality AS y FROM labels JOIN documents USING (doc_id)), s AS (SELECT case_name, sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn FROM p GROUP BY ROLLUP (case_name)) SELECT case_name, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, "
    "round(tp / (tp + fp), 4) AS \"precision\", round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1 FROM s"
)
def prf1_rollup(spark, d):
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select(F.col("lang").alias("case_name"), (F.col("n_chars") > 600).cast("int").alias("p"), F.col("quality").alias("y"))
    s = p.rollup("case_name").agg(F.sum(F.col("p") * F.col("y")).alias("tp"), F.sum(F.col("p") * (1 - F.col("y"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("y")).alias("fn"))
    return s.select("*", *evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    "WITH pre(preset, t) AS (VALUES ('aggressive', 0.94), ('balanced', 0.95), ('conservative', 0.96)), c AS (SELECT preset, c_nationkey, avg((c_acctbal / 10000 >= t - 0.9)::INT) AS a, avg((c_acctbal > 0)::INT) AS b FROM customer, pre GROUP BY ALL), m AS (SELECT preset, round(avg(a), 4) AS clause_recall, round(avg(b), 4) AS number_recall FROM c GROUP BY preset), "
    "k AS (SELECT *, round(0.45 * clause_recall + 0.45 * number_recall + 0.1, 4) AS composite FROM m) SELECT *, 1.0::DOUBLE AS volume_alignment, preset = (SELECT preset FROM k ORDER BY composite DESC, preset LIMIT 1) AS recommended FROM k"
)
def preset_sweep(spark, d):
    """Cases (nations) times presets in one plan."""
    pre = spark.createDataFrame([(n, s.unchanged) for n, s in PRESETS.items()], "preset string, t double")
    rows = table(spark, d, "customer").join(F.broadcast(pre))
    share = lambda c: F.avg(c.cast("int"))
    cases = rows.groupBy("preset", "c_nationkey").agg(share(F.col("c_acctbal") / 10000 >= F.col("t") - 0.9).alias("clause_recall"), share(F.col("c_acctbal") > 0).alias("number_recall"), F.lit(1.0).alias("volume_alignment"))
    return evaluate.sweep(cases)


@query("SELECT type, count(*) AS changes FROM (SELECT p_type AS type FROM part) GROUP BY type ORDER BY changes DESC, type LIMIT 10")
def type_top10(spark, d):
    return evaluate.dataset_statistics(table(spark, d, "part").select(F.col("p_type").alias("type")))[1]


@query(
    "WITH t AS (SELECT lower(p_name || ' ' || p_type) AS x FROM part) SELECT CASE WHEN regexp_matches(x, 'semantic|paraphrase|logic shift') THEN 'Semantic' WHEN regexp_matches(x, 'structural|table manipulation|silent deletion|addition|deletion|merge|split') THEN 'Structural' WHEN regexp_matches(x, 'numerical|typo|formatting noise|word order|micro deletion|lexical') THEN 'Lexical' ELSE 'Other' END AS bucket, count(*) AS changes FROM t GROUP BY 1"
)
def type_buckets(spark, d):
    return evaluate.dataset_statistics(table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("type")))[0]


@query("SELECT event_type AS stage, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def stage_share(spark, d):
    rows = evaluate.stage_shares(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))
    return rows.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1")
def events_json(spark, d):
    """JSON objects found in what surrounds them, as models answer."""
    answer = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```"))
    found = F.get_json_object(ids.json_object(answer), "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(found).alias("with_k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hour_windows(spark, d):
    """The streaming job's plan over a finished table, where the watermark holds nothing back."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.progress_counts(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\\b[^>]*>.*?</(?:h[1-6]|p|li)>') AS l FROM pages), u AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM p) SELECT page_id, pos, lower(regexp_extract(raw, '^<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM u"
)
def html_blocks(spark, d):
    return paragraphs.html_blocks(table(spark, d, "pages"))


@query(
    f"WITH l AS ({LINES}), k AS (SELECT doc_id, pos, {SQUEEZED.replace('text', 'line')} AS t FROM l), f AS (SELECT * FROM k WHERE t <> '' AND NOT regexp_matches(t, '(?i)^([0-9]+|-{{3,}}|_{{3,}}|\\.{{3,}}|confidential)$')), "
    "c AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY pos) AS content, count(*) AS n_lines FROM f GROUP BY doc_id) SELECT doc_id::VARCHAR AS doc_id, 'Mở đầu' AS breadcrumb, n_lines, md5(content) AS content_md5 FROM c WHERE length(content) >= 30 OR len(regexp_extract_all(content, '\\p{L}')) >= 5"
)
def sectionize(spark, d):
    """Plain documents have no legal headings: each is one preamble."""
    rows = chunks.sectionize(paragraphs.text_paragraphs(table(spark, d, "documents")))
    return rows.select("doc_id", "breadcrumb", F.size("lines").cast("bigint").alias("n_lines"), F.md5("content").alias("content_md5"))


@query()
def change_records(spark, d):
    """Version pairs as one clause each: records with tags, impact, confidence and judgement."""
    pairs = compare.version_pairs(table(spark, d, "documents")).select("pair_id", F.lit(0).alias("ord"), F.lit("MODIFIED").alias("match_type"), F.lit("Mở đầu").alias("clause_id"), "text_a", "text_b", F.lit(0.9).alias("similarity"))
    return changes.change_records(pairs).select("pair_id", "ord", "rec_ord", "record.*")


@query()
def compared_statistics(spark, d):
    """The whole comparison of each document with its version: counters of clauses and atomic changes."""
    pairs = compare.version_pairs(table(spark, d, "documents"))
    side = lambda n: paragraphs.text_paragraphs(pairs.select(F.col(f"doc_{n}").alias("doc_id"), F.col(f"text_{n}").alias("text")).distinct()).join(
        pairs.select("pair_id", F.col(f"doc_{n}").cast("string").alias("doc_id")), "doc_id"
    )
    return compare.compare_versions(_named(side("a")), _named(side("b")))["statistics"]


def _named(rows):
    """Each pair has its own copy of a document that several pairs compare."""
    return rows.withColumn("doc_id", F.concat_ws("/", "pair_id", "doc_id"))


@query(
    "WITH e AS (SELECT user_id::VARCHAR AS pair_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type <> 'view') SELECT pair_id, event_id AS ord, rank FROM e WHERE rank <= 5"
)
def top_substantive(spark, d):
    """A user's events as clauses of one record each; views count as formal."""
    level = F.when(F.col("event_type") == "view", F.lit("formal")).otherwise(F.lit("substantive"))
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("pair_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("clause_id"), F.lit("").alias("summary"), F.array(F.struct(level.alias("impact_level"), F.col("value").alias("confidence_score"))).alias("records")
    )
    return enrich.top_substantive(rows).select("pair_id", "ord", "rank")


@query(
    "WITH c AS (SELECT o_custkey, count(*) AS gt, (sum(o_totalprice) / 100000)::BIGINT AS pred, avg((o_orderstatus = 'F')::INT) AS recall FROM orders GROUP BY 1), t AS (SELECT sum(gt) AS g, sum(pred) AS p, round(avg(recall), 4) AS a FROM c), m AS (SELECT g, p, least(g, p, a * g) AS m FROM t) "
    "SELECT round(m / p, 4) AS precision_est, round(m / g, 4) AS recall_est, round(2 * (m / p) * (m / g) / (m / p + m / g), 4) AS f1_est, g::BIGINT AS total_gt, p::BIGINT AS total_pred FROM m"
)
def estimated_prf(spark, d):
    """Customers as cases."""
    c = F.col
    cases = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("gt_changes"), F.round(F.sum("o_totalprice") / 100000).cast("bigint").alias("predicted_atomic_changes"), F.avg((c("o_orderstatus") == "F").cast("int")).alias("clause_recall"))
    return evaluate.estimated_prf(cases)


@query()
def greedy_match(spark, d):
    """Cases are customers: parts that they ordered, matched with the suppliers of these parts by the largest quantity."""
    c = F.col
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    scores = rows.groupBy(c("o_custkey").alias("case_name"), c("l_partkey").alias("pred_ord"), c("l_suppkey").alias("gt_ord")).agg(F.max(c("l_quantity").cast("double") / 50).alias("score"))
    return evaluate.greedy_match(scores, 0.0)


@query()
def orphan_refs(spark, d):
    n = table(spark, d, "nation")
    clauses = n.select(F.col("n_regionkey").cast("string").alias("pair_id"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("Điều "), F.col("n_nationkey").cast("string")).alias("clause_id"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("DELETED")).otherwise(F.lit("MODIFIED")).alias("clause_change_kind"), F.concat(F.lit("theo Điều "), (F.col("n_nationkey") - 1).cast("string")).alias("text_b"))
    return anomalies.orphan_references(clauses)


__all__ = ["ORACLE_SQL", "QUERIES", "Settings", "jobs"]


TOKENS = "list_filter(regexp_split_to_array(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(
    f"WITH t AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations) SELECT conv_id, turn, md5(array_to_string(w, ' ')) AS evaluation_md5, "
    "md5(array_to_string(list_filter(w, lambda x: x NOT IN ('i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x')), ' ')) AS anchor_md5 FROM t"
)
def comparison_forms(spark, d):
    """The forms in which evaluation and anchors compare texts."""
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", F.md5(T.evaluation_form(F.col("text"))).alias("evaluation_md5"), F.md5(T.anchor_form(F.col("text"))).alias("anchor_md5"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'dieu ' || c_custkey ELSE 'phu luc ' || c_nationkey END AS anchor FROM customer")
def clause_anchors(spark, d):
    """Customers as clauses: articles, annexes, and some that are neither."""
    clause = F.expr("concat(CASE c_custkey % 3 WHEN 0 THEN 'Khoản' WHEN 1 THEN 'Điều  ' || c_custkey ELSE 'PHỤ LỤC ' || c_nationkey END, ': ', c_name)")
    return table(spark, d, "customer").select("c_custkey", T.clause_anchor(T.anchor_form(clause)).alias("anchor"))


SANITIZED = "trim(substr(regexp_replace(trim(regexp_replace(%s, '\\s+', ' ', 'g')), '^[-*\\d.)\\s]+', ''), 1, %d))"


@query(
    f"SELECT doc_id, {SANITIZED % ('text', 320)} AS point, "
    f"least(5, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {SANITIZED % ('x', 220)}), lambda x: x <> '')))) AS n_points FROM documents"
)
def sanitized_points(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.sanitize(c).alias("point"), F.size(T.sanitize_list(F.split(c, "\n"), 5)).cast("bigint").alias("n_points"))


@query(
    "SELECT doc_id, doc_id::VARCHAR || '__' || source || '_' || lang || '__fp' || substr(sha1(lower(" + SQUEEZED + ")), 1, 12) || CASE WHEN doc_id % 3 > 0 THEN '_s' || (doc_id % 3) ELSE '' END AS chunk_id, "
    "doc_id::VARCHAR || '__' || source || '_' || lang || '__idx' || doc_id || '_sub' || (doc_id % 3) AS legacy_id, substr(sha256('hashing||' || text), 1, 16) AS cache_key, "
    "md5('event: chunk' || chr(10) || 'data: ' || text || chr(10) || chr(10)) AS frame_md5 FROM documents"
)
def chunk_keys(spark, d):
    """Ids of chunks, old and new, keys of their cached vectors, and the frames that carry them to a listener."""
    docs = table(spark, d, "documents")
    name, crumb, sub = F.col("doc_id").cast("string"), F.concat_ws(" > ", "source", "lang"), F.col("doc_id") % 3
    return docs.select(
        "doc_id", ids.chunk_id(name, crumb, F.col("text"), sub).alias("chunk_id"), ids.legacy_chunk_id(name, crumb, F.col("doc_id"), sub).alias("legacy_id"),
        ids.cache_key(F.lit("hashing"), F.col("text")).alias("cache_key"), F.md5(ids.sse_frame(F.lit("chunk"), F.col("text"))).alias("frame_md5"),
    )


@query("SELECT p_partkey, concat_ws(' | ', p_name, p_brand, p_type) AS row_text FROM part")
def merged_row(spark, d):
    """Table rows with a merged cell, an empty one and one with white space around it."""
    cells = F.array("p_name", "p_brand", "p_brand", F.lit("  "), F.concat(F.lit(" "), F.col("p_type"), F.lit("\t")))
    return table(spark, d, "part").select("p_partkey", T.merged_cells(cells).alias("row_text"))


def _terms(hours: str, uptime: str, days: str) -> Column:
    """What a clause of a service contract says."""
    return F.expr(f"concat('SLA phản hồi trong ', int({hours}), ' giờ, uptime ', int({uptime}), '%; bàn giao trong ', int({days}), ' ngày tại Hà Nội')")


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity::INT || ' giờ|' || l_linenumber::INT || ' ngày' AS times, 'hà nội' AS locations, (l_quantity::INT)::VARCHAR AS sla, (l_partkey % 100)::INT::VARCHAR AS uptime, "
    "true AS has_number, false AS generic FROM lineitem"
)
def stated_facts(spark, d):
    """Order lines as clauses: times, places and metrics that they state."""
    clauses = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _terms("l_quantity", "l_partkey % 100", "l_linenumber").alias("t"))
    c = F.col("t")
    one = lambda name: F.array_join(F.col("m")[name], "|")
    made = {
        "times": F.array_join(T.times(c), "|"), "locations": F.array_join(T.locations(c), "|"), "sla": one("sla_response_hours"), "uptime": one("uptime_percent"), "has_number": T.has_number(c), "generic": T.is_generic_summary(c),
    }
    # the same clause stands in many contracts
    rows = once(clauses, ["t"], lambda x: x.withColumn("m", T.metrics(c)).withColumns(made), list(made))
    return rows.select("l_orderkey", "l_linenumber", *made)


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, (l_linenumber * 4)::INT AS q2, (l_partkey % 4)::INT AS p, (l_suppkey % 4)::INT AS p2 FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN q = q2 AND p = p2 THEN 'none' ELSE 'substantive' END AS impact, CASE WHEN q <> q2 THEN 'Số liệu|Thời hạn' WHEN p <> p2 THEN 'Số liệu' ELSE '' END AS tags, "
    "concat_ws('|', CASE WHEN q <> q2 THEN 'sla_response_hours:' || q || '>' || q2 END, CASE WHEN p <> p2 THEN 'uptime_percent:' || p || '>' || p2 END) AS deltas FROM x"
)
def stated_changes(spark, d):
    """Order lines as clauses in two versions: what changed, how it is tagged and how metrics moved."""
    both = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _terms("l_quantity", "l_partkey % 4", "1").alias("old"), _terms("l_linenumber * 4", "l_suppkey % 4", "1").alias("new"))
    old, new = F.col("old"), F.col("new")
    told = F.transform(T.metric_deltas(old, new), lambda x: F.concat(x["metric"], F.lit(":"), x["before"], F.lit(">"), x["after"]))
    tags = F.array_join(changes.change_tags(F.col("impact"), F.lit("Điều 1"), old, new), "|")
    judge = lambda x: x.withColumn("impact", changes.impact(old, new)).withColumns({"tags": tags, "deltas": F.array_join(told, "|")})
    # the same change stands in many contracts
    rows = once(both, ["old", "new"], judge, ["impact", "tags", "deltas"])
    return rows.select("l_orderkey", "l_linenumber", "impact", "tags", "deltas")


@query(
    "WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'REPLACED' WHEN 'O' THEN 'MODIFIED' ELSE 'ADDED' END AS kind, o_custkey AS k, o_orderkey % 100 / 100.0::DOUBLE AS ratio FROM orders) "
    "SELECT o_orderkey, CASE WHEN (k % 5 <> 0 AND k % 2 <> 0 AND k % 3 <> 0 AND kind <> 'ADDED' AND ((kind = 'REPLACED' AND ratio < 0.35) OR ratio >= 0.55)) OR k % 97 = 0 OR k % 10 < 3 THEN 'REVIEW_NEEDED' ELSE 'AUTO' END AS status FROM x"
)
def review_states(spark, d):
    """Orders as records: which of them a person should look at."""
    k = F.col("o_custkey")
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("REPLACED")).when(F.col("o_orderstatus") == "O", F.lit("MODIFIED")).otherwise(F.lit("ADDED"))
    level = F.when(k % 5 == 0, F.lit("formal")).otherwise(F.lit("substantive"))
    tags = F.array(F.when(k % 3 == 0, F.lit("Số liệu")).otherwise(F.lit("Chính tả")))
    score = F.when(k % 10 < 3, F.lit(0.5)).otherwise(F.lit(0.6))
    return table(spark, d, "orders").select("o_orderkey", changes.review_status(kind, level, tags, k % 2 == 0, F.col("o_orderkey") % 100 / F.lit(100.0), k % 97 == 0, score).alias("status"))


@query(
    "SELECT (event_id // 3)::VARCHAR AS session_id, max(event_id) + 1 AS seq, 'failed' AS event, 'recovery' AS step, 'startup_recovery_interrupted' AS detail FROM events "
    "GROUP BY event_id // 3 HAVING count(*) FILTER (event_type IN ('purchase', 'error')) = 0"
)
def session_recovery(spark, d):
    """Three events a session: those that neither completed nor failed were interrupted."""
    log = _session_log(table(spark, d, "events"), F.expr("event_id div 3"))
    return sessions.recovered(log).select("session_id", "seq", "event", "step", "detail")


@query(
    "SELECT o_orderkey, concat_ws(' · ', o_orderpriority, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'p.' || (o_custkey % 7) ELSE 'p.' || (o_custkey % 7) || '-' || (o_custkey % 7 + o_custkey % 3) END, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'chunk_' || o_orderkey END) AS source FROM orders"
)
def source_lines(spark, d):
    """Where a citation's text comes from: file, pages, chunk, each of which can be unknown."""
    page = F.nullif(F.col("o_custkey") % 7, F.lit(0))
    chunk = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("chunk_"), F.col("o_orderkey"))).otherwise(F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", report.source_line(F.col("o_orderpriority"), page, page + F.col("o_custkey") % 3, chunk).alias("source"))


@query(
    "SELECT l_orderkey AS pair_id, count(*) FILTER (l_suppkey % 4 = 0) AS unchanged, count(*) FILTER (l_suppkey % 4 = 1) AS modified, count(*) FILTER (l_suppkey % 4 = 2) AS added, count(*) FILTER (l_suppkey % 4 = 3) AS deleted FROM lineitem GROUP BY 1"
)
def match_counts(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("UNCHANGED", "MODIFIED", "ADDED", "DELETED")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return report.match_counters(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), kind.alias("match_type")))


@query(
    f"WITH p AS (SELECT doc_id, substr({SQUEEZED}, 1, 150) AS x FROM documents) SELECT doc_id // 10 AS pair_id, doc_id AS ord, "
    "concat_ws(chr(10), CASE WHEN doc_id % 4 <> 2 AND x <> '' THEN '- ' || x END, CASE WHEN doc_id % 4 <> 3 THEN '+ new' END) AS line FROM p WHERE doc_id % 4 <> 0"
)
def diff_listing(spark, d):
    """Documents as aligned chunks: replaced, added, deleted, and unchanged ones, which aren't listed."""
    n = F.col("doc_id") % 4
    kind = F.when(n == 0, F.lit("UNCHANGED")).when(n == 1, F.lit("MODIFIED")).when(n == 2, F.lit("ADDED")).otherwise(F.lit("DELETED"))
    pairs = table(spark, d, "documents").select(
        F.expr("doc_id div 10").alias("pair_id"), F.col("doc_id").alias("ord"), kind.alias("match_type"), F.when(n != 2, F.col("text")).alias("text_a"), F.when(n != 3, F.lit("new")).alias("text_b")
    )
    return report.diff_lines(pairs)


@query(
    "SELECT conv_id::VARCHAR AS session_id, turn AS question_id, 'user' AS role, text AS content, 0 AS n_citations, NULL AS answer_type, 0 AS part FROM conversations UNION ALL "
    "SELECT conv_id::VARCHAR, turn, 'assistant', upper(role), CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END, 'document_answer', 1 FROM conversations"
)
def answer_messages(spark, d):
    """Turns as questions that were answered, with citations of which some are named twice."""
    named = F.array(F.lit("a"), F.when(F.col("turn") % 2 == 0, F.lit("a")).otherwise(F.lit("b")))
    answers = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("question_id"), F.col("text").alias("question"), F.upper("role").alias("answer_markdown"), named.alias("citation_ids"), F.lit("document_answer").alias("answer_type")
    )
    return sessions.messages_of(answers).withColumn("n_citations", F.size("citation_ids")).drop("citation_ids")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Điều ' || o_custkey WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'N/A' END AS label FROM orders")
def clause_labels(spark, d):
    article = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  Điều   "), F.col("o_custkey"))).otherwise(F.lit(" "))
    title = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderpriority"), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", ids.clause_label(article, title).alias("label"))


@query(
    f"WITH t AS (SELECT doc_id, source, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS page, len(string_split(text, chr(10))) AS n, {SQUEEZED} AS x FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, CAST(coalesce(page, doc_id + 1) AS INT) AS page, CASE WHEN x <> '' THEN substr(x, 1, 160) END AS snippet, "
    "concat_ws(' · ', source, 'p.' || coalesce(page, doc_id + 1) || CASE WHEN page + 1 <> coalesce(page, doc_id + 1) THEN '-' || (page + 1) ELSE '' END, "
    "CASE WHEN n = 1 THEN 'l.1' ELSE 'l.1-' || n END, CASE WHEN length(text) = 0 THEN 'c.0' ELSE 'c.0-' || length(text) END, 'c' || doc_id) AS line FROM t"
)
def source_refs(spark, d):
    """Whole documents as chunks, of which some have no page."""
    page = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7)
    made = {"page": page, "page_end": page + 1, "raw_index": F.col("doc_id"), "content": F.col("text"), "line_start": F.lit(1), "line_end": F.size(F.split("text", "\n")), "char_start": F.lit(0), "char_end": F.length("text"), "chunk_id": F.concat(F.lit("c"), F.col("doc_id"))}
    rows = table(spark, d, "documents").where("text IS NOT NULL").withColumns(made)
    rows = rows.select("doc_id", chunks.source_ref(F.col("source")).alias("ref"))
    return rows.select("doc_id", F.col("ref.page").alias("page"), F.col("ref.context_snippet").alias("snippet"), report.source_text(F.col("ref")).alias("line"))


@query(
    "WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS pair_id, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN '__unknown_clause__' || o_orderkey ELSE 'Điều ' || (o_orderkey % 2) END AS clause_id, * FROM orders), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, clause_id, o_orderstatus, o_orderpriority ORDER BY ord) AS again FROM l) "
    "SELECT pair_id, clause_id, min(ord) AS ord, max(o_orderkey % 97 / 97.0::DOUBLE) AS similarity, arg_min(o_orderpriority, ord) FILTER (o_orderstatus <> 'F') AS text_a, arg_min(CAST(o_orderdate AS VARCHAR), ord) AS text_b, "
    "arg_min(o_orderstatus, ord) AS clause_change_kind, arg_min(CAST(ord AS INT), ord) FILTER (ord % 3 = 0) AS source_page, string_agg(o_orderstatus || o_orderpriority, ',' ORDER BY ord) FILTER (again = 1) AS records FROM r GROUP BY pair_id, clause_id"
)
def merged_clauses(spark, d):
    """A customer's orders as results of clauses, several of one clause: some without a text or source, with records that repeat."""
    c = F.col
    record = F.struct(c("o_orderstatus").alias("change_kind"), F.lit("formal").alias("impact_level"), F.lit("FORMAL").alias("semantic_effect"), F.array("o_orderpriority").alias("tags"), F.lit("old").alias("old"), F.lit("new").alias("new"))
    rows = table(spark, d, "orders").select(
        c("o_custkey").cast("string").alias("pair_id"), c("o_orderkey").alias("ord"), F.when(c("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Điều "), c("o_orderkey") % 2)).alias("clause_id"),
        (c("o_orderkey") % 97 / F.lit(97.0)).alias("similarity"), F.when(c("o_orderstatus") != "F", c("o_orderpriority")).otherwise(F.lit("")).alias("text_a"), c("o_orderdate").cast("string").alias("text_b"),
        c("o_orderstatus").alias("clause_change_kind"), F.when(c("o_orderkey") % 3 == 0, F.struct(c("o_orderkey").cast("int").alias("page"))).alias("source_a"), F.array(record).alias("records"),
    )
    merged = changes.merge_clauses(rows)
    shown = F.array_join(F.transform("records", lambda r: F.concat(r["change_kind"], r["tags"][0])), ",")
    return merged.select("pair_id", "clause_id", "ord", "similarity", "text_a", "text_b", "clause_change_kind", c("source_a.page").alias("source_page"), shown.alias("records"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 5 <> 0 AND (o_custkey % 3 <> 0 OR o_orderkey % 2 = 0)")
def session_commits(spark, d):
    """Customers as sessions of their orders: all are committed, some again with fewer orders, some deleted."""
    store = session_store.SessionStore(spark, f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), "o_custkey", "o_orderkey", "o_orderstatus")
    again = orders.where("o_custkey % 3 = 0")
    store.commit({"sessions": orders.select("session_id").distinct(), "results": orders})
    store.commit({"sessions": again.select("session_id").distinct(), "results": again.where("o_orderkey % 2 = 0")})
    store.delete(orders.where("o_custkey % 5 = 0").select("session_id"))
    return store.table("results").select("session_id", "o_orderkey", "o_orderstatus")
