"""Line dedup by a log-template tree of fixed depth.

A line falls through the tree by its number of tokens and its leading tokens; tokens with a digit are variable fields and count as
`<*>`. In a leaf, a token that fewer than `min_docs` documents have at its place is a variable field too. What is left is the
line's template: one that recurs in `min_docs` different documents, with enough fixed tokens, is boilerplate, and its lines are
dropped from all documents. Documents with one and the same text count as one, so copies alone make no template.
A caller that knows near copies passes them as families, each of which counts as one too.

All of it is DataFrame operations. Leaves, kinds of lines and templates are named by 128 bits of hash. Counts are pre-aggregated; lines meet templates in plain joins that AQE can split where
one line is very common; no group is gathered but a document's own dropped line numbers.

Cases: a null text has no lines and stays null; an empty one has one empty line, which is kept. Lines with fewer than `min_fixed`
fixed tokens are never dropped. Equal rows are treated alike. A document may end up with an empty text; it stays a row.
An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import SPACE, Carried, cut, quoted, row_key, small

VARIABLE = "<*>"


def _tokens(line):
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*", VARIABLE)).otherwise(line)
    return F.array_remove(F.split(masked, SPACE), "")


def _named(*parts) -> Column:
    """128 bits that stand for the parts."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))


def recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = 20, depth: int = 2, min_fixed: int = 2, fixed_share: float = 0.7, families: DataFrame | None = None) -> DataFrame:
    """Each line to drop: row (16 bytes, see shared.row_key over doc_id and text), line (from 0), template. families: row and family (bigint);
    rows of one family count as one document."""
    body = F.col(quoted(text))
    rows = docs.select(row_key(F.col("doc_id"), body).alias("row"), F.xxhash64(body).alias("doc"), body.alias("body"))
    if families is not None:
        rows = rows.join(small(families), "row", "left").withColumn("doc", F.coalesce("family", "doc"))
    lines = rows.select("row", "doc", F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    lines = lines.select("row", "doc", "line", _tokens(F.col("raw")).alias("tokens")).where(F.size("tokens") >= min_fixed)
    leaf = _named(F.size("tokens"), F.slice("tokens", 1, depth))
    lines = cut(lines.select("row", "doc", "line", leaf.alias("leaf"), "tokens"))
    # leaves that too few documents reach hold no recurring template
    leaves = lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    lines = cut(lines.join(cut(leaves), "leaf", "left_semi"))
    places = lines.select("leaf", "doc", F.posexplode("tokens").alias("place", "token")).where(F.col("token") != VARIABLE).distinct()
    fixed = places.groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf", "place", "token")
    # each kind of line once: its tokens, those that are fixed in its leaf, and so its template
    kinds = cut(lines.select("leaf", "tokens").distinct().withColumn("kind", _named("leaf", "tokens")))
    spread = kinds.select("kind", "leaf", F.posexplode("tokens").alias("place", "token"))
    kept = spread.join(cut(fixed), ["leaf", "place", "token"], "left_semi")
    fixed_of = kept.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("fixed"))
    templates = kinds.join(fixed_of, "kind").select(
        "kind", _named("leaf", "fixed").alias("template"), F.size("fixed").alias("n_fixed"), (F.size("tokens") - F.size(F.filter("tokens", lambda t: t == VARIABLE))).alias("n_words")
    )
    templates = cut(templates.where((F.col("n_fixed") >= min_fixed) & (F.col("n_fixed") >= fixed_share * F.col("n_words"))).select("kind", "template"))
    found = lines.select("row", "doc", "line", _named("leaf", "tokens").alias("kind")).join(templates, "kind")
    found = cut(found.select("row", "doc", "line", "template"))
    recurring = found.select("template", "doc").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")
    return found.join(cut(recurring), "template", "left_semi").select("row", "line", "template")


def drop_recurring_lines(docs: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """docs with the text's recurring lines removed, and n_lines and n_dropped (long)."""
    found = recurring_lines(docs, text, **parameters)
    drops = found.groupBy("row").agg(F.collect_set("line").alias("drop"))
    body = F.col(quoted(text))
    work = Carried(docs, ["n_lines", "n_dropped"], {text: "text"}, row=row_key(F.col("doc_id"), body), lines=F.split(body, "\n"))
    rows = work.rows.join(drops, "row", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("bigint")
    rows = rows.select("own", F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(kept).alias("text"), size("lines").alias("n_lines"), size("drop").alias("n_dropped"))
    return work.back(rows, "n_lines", "n_dropped")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, hash(text) AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
t AS (SELECT doc_id, doc, line, list_filter(regexp_split_to_array(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tokens FROM l),
e AS (SELECT *, (len(tokens), tokens[1:2]) AS leaf FROM t WHERE len(tokens) >= 2),
v AS (SELECT leaf FROM e GROUP BY leaf HAVING count(DISTINCT doc) >= 20),
s AS (SELECT e.* FROM e SEMI JOIN v USING (leaf)),
x AS (SELECT leaf, doc, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM s),
f AS (SELECT leaf, place, token FROM x WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc) >= 20),
k AS (SELECT DISTINCT leaf, tokens FROM s),
kx AS (SELECT leaf, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM k),
m AS (SELECT kx.leaf, kx.tokens, list((kx.place, kx.token) ORDER BY kx.place) AS fixed FROM kx JOIN f USING (leaf, place, token) GROUP BY kx.leaf, kx.tokens),
q AS (SELECT leaf, tokens, fixed FROM m WHERE len(fixed) >= 2 AND len(fixed) >= 0.7 * len(list_filter(tokens, lambda x: x <> '<*>'))),
h AS (SELECT s.doc_id, s.doc, s.line, q.leaf, q.fixed FROM s JOIN q ON s.leaf = q.leaf AND s.tokens = q.tokens),
r AS (SELECT leaf, fixed FROM h GROUP BY ALL HAVING count(DISTINCT doc) >= 20),
d AS (SELECT h.doc_id, h.line FROM h JOIN r ON h.leaf = r.leaf AND h.fixed = r.fixed),
g AS (SELECT l.doc_id, count(*) AS n_lines, count(d.line) AS n_dropped, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (d.line IS NULL), '') AS kept
      FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g
"""
