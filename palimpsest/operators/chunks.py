"""Paragraphs to chunks: a hierarchy of parts, chapters and articles, and sub-chunks of long articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import rules
from palimpsest.functions import ids
from palimpsest.functions import text as T


def top_level(c: Column) -> Column:
    """Label of a part or annex; null for other lines."""
    at = "(?iU)" + rules.TOP_LEVEL
    label = F.regexp_extract(c, at, 1)
    label = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 100)))
    return F.when(c.rlike(at), F.concat(label, F.lit(" "), F.upper(F.regexp_extract(c, at, 2))))


def mid_level(c: Column, legacy: bool = False) -> Column:
    return F.when(T.any_match(c, rules.MID_LEVEL_LEGACY if legacy else rules.MID_LEVEL), c)


def signature(c: Column) -> Column:
    return F.when(c.rlike("(?iU)" + rules.SIGNATURE), F.lit(rules.SIGNATURE_LABEL))


def article(c: Column) -> Column:
    """Struct of number and title (null without one); null for other lines."""
    out = F.lit(None).cast("struct<number:string,title:string>")
    for i, p in reversed(list(enumerate(rules.ARTICLE))):
        at = "(?iU)" + p
        title = F.lit(None).cast("string") if i == 2 else F.nullif(T.strip(F.regexp_extract(c, at, 2)), F.lit(""))
        out = F.when(c.rlike(at), F.struct(T.strip(F.regexp_extract(c, at, 1)).alias("number"), title.alias("title"))).otherwise(out)
    return out


def is_sub_clause(c: Column) -> Column:
    return c.rlike("(?iU)" + rules.SUB_CLAUSE)


def is_strong_noise(content: Column) -> Column:
    c = T.clause_key(content)
    shapes = T.any_match(c, (r"^trang\s+\d+\s*(/\s*\d+)?$", r"^\d+$", r"^[-_.]{3,}$", r"^số:\s*[\w/\-]+$"))
    return (c == "") | shapes | ((F.length(c) < 30) & (F.regexp_count(c, F.lit(r"\p{L}")) < 5))


def is_kept(content: Column, has_article: Column) -> Column:
    return has_article | (F.length(content) >= 30) | ~is_strong_noise(content)


def is_table(lines: Column, share: float = rules.Settings.table_share) -> Column:
    return (F.size(lines) > 0) & (F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("|"))) >= share * F.size(lines))


def line_offsets(rows: DataFrame, keys: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """rows with offset: where each line begins in its lines joined by line ends."""
    before = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)))


def sectionize(paragraphs: DataFrame, normalized: bool = False, legacy: bool = False) -> DataFrame:
    """Chunks of each document: running header state and segments as windows over its paragraphs."""
    if not normalized:
        paragraphs = paragraphs.withColumn("text", T.nfc(T.text(F.col("text"))))
    t = F.col("text")
    # exploded, so that the text and its marks are computed once: a condition on a column repeats how the column is made
    made = F.transform(F.array(t), lambda x: T.strip(x if normalized else T.without_variants(x)))
    rows = paragraphs.withColumn("text", F.explode(made)).where((t != "") & ~T.is_noise(t))
    top = F.coalesce(top_level(t), F.when(mid_level(t, legacy).isNull(), signature(t)))
    mid = F.when(top.isNull(), mid_level(t, legacy))
    marks = F.struct(top.alias("top"), mid.alias("mid"), F.when(top.isNull() & mid.isNull(), article(t)).alias("art"))
    rows = rows.withColumn("_m", F.explode(F.array(F.when(t.rlike("(?iU)" + rules.HEAD), marks))))
    rows = rows.select("*", F.col("_m.top").alias("_top"), F.col("_m.mid").alias("_mid"), F.col("_m.art").alias("_art")).drop("_m")
    is_top, is_mid, is_art = (F.col(c).isNotNull() for c in ("_top", "_mid", "_art"))
    doc = ["doc_id", "doc_label"]
    run = lambda *k: Window.partitionBy(*doc, *k).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_te": F.sum(is_top.cast("int")).over(run()), "_seg": F.sum((is_top | is_mid | is_art).cast("int")).over(run())})
    rows = rows.withColumn("_first", F.first(~(is_top | is_mid | is_art)).over(run()))
    rows = rows.withColumn("_me", F.sum(is_mid.cast("int")).over(run("_te")))
    last = lambda c, *k: F.last(c, ignorenulls=True).over(run(*k))
    rows = rows.withColumns({"top": last("_top"), "mid": last("_mid", "_te"), "_a": last("_art", "_te", "_me")})
    # a document that begins with body text has a preamble until its first part
    rows = rows.withColumn("top", F.when(F.col("top").isNull() & F.col("_first"), F.lit(rules.PREAMBLE)).otherwise(F.col("top")))
    rows = rows.groupBy(*doc, "_seg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "page", "top", "mid", "_a"))).alias("rows"),
    )
    lines = F.transform("rows", lambda r: r["text"])
    pages = F.filter(F.transform("rows", lambda r: r["page"]), lambda p: p.isNotNull())
    end = F.col("rows")[F.size("rows") - 1]
    out = rows.select(
        *doc, "_seg", lines.alias("lines"), F.array_join(lines, "\n").alias("content"), end["top"].alias("top_level"), end["mid"].alias("mid_level"), end["_a"]["number"].alias("article"), end["_a"]["title"].alias("title"),
        F.transform("rows", lambda r: r["page"]).alias("line_pages"), F.get(pages, F.lit(0)).alias("page"), F.get(pages, F.size(pages) - 1).alias("page_end"), F.col("rows")[0]["pos"].alias("first_pos"),
    )
    out = out.where(is_kept(F.col("content"), F.col("article").isNotNull()))
    crumb = F.concat_ws(" > ", "top_level", "mid_level", "article")
    out = out.withColumn("breadcrumb", F.when(crumb == "", F.lit(rules.GENERAL)).otherwise(crumb))
    number = F.row_number().over(Window.partitionBy(*doc).orderBy("_seg")) - 1
    out = out.withColumns({"raw_index": number, "sub_index": F.lit(0), "line_start": F.lit(1), "line_end": F.size("lines"), "char_start": F.lit(0), "char_end": F.length("content")})
    return out.drop("_seg")


def sub_chunks(chunks: DataFrame, most: int = rules.Settings.max_chunk) -> DataFrame:
    """Chunks longer than `most` split at sub-clauses, or, tables, filled up greedily under their repeated header line."""

    def by_clause(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | is_sub_clause(x), i)), lambda x: x.isNotNull())
        return F.transform(starts, lambda s, k: F.struct(s.alias("at"), F.coalesce(F.get(starts, k + 1), F.size(lines)).alias("to")))

    def by_size(lines: Column) -> Column:
        # the header is repeated in each group, so it counts for all of them
        state = F.struct(F.array().cast("array<struct<at:int,to:int>>").alias("done"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).alias("i"))
        header = F.length(lines[0]) + 1

        def step(s: Column, x: Column) -> Column:
            full = (s["i"] > s["at"]) & (s["i"] > 0) & (s["size"] + F.length(x) + 1 > most)
            done = F.when(full, F.concat(s["done"], F.array(F.struct(s["at"].alias("at"), s["i"].alias("to"))))).otherwise(s["done"])
            size = F.when(full, header + F.length(x) + 1).otherwise(s["size"] + F.length(x) + 1)
            return F.struct(done.alias("done"), F.when(full, s["i"]).otherwise(s["at"]).alias("at"), size.alias("size"), (s["i"] + 1).alias("i"))

        return F.aggregate(lines, state, step, lambda s: F.concat(s["done"], F.array(F.struct(s["at"].alias("at"), s["i"].alias("to")))))

    table = is_table(F.col("lines"))
    groups = F.when(F.length("content") <= most, F.array(F.struct(F.lit(0).alias("at"), F.size("lines").alias("to")))).when(table, by_size(F.col("lines"))).otherwise(by_clause(F.col("lines")))
    rows = chunks.withColumn("_groups", groups).withColumn("_n", F.size("_groups")).select("*", F.posexplode("_groups").alias("_k", "_g")).drop("_groups", "sub_index")
    part = F.slice("lines", F.col("_g.at") + 1, F.col("_g.to") - F.col("_g.at"))
    head = F.concat(F.lit("["), F.concat_ws(" – ", "breadcrumb", "title"), F.lit("]\n"), F.when(table, F.concat(F.element_at("lines", 1), F.lit("\n"))).otherwise(F.lit("")))
    own = F.array_join(part, "\n")
    start = F.aggregate(F.slice("lines", 1, F.col("_g.at")), F.lit(0), lambda s, x: s + F.length(x) + 1)
    pages = F.filter(F.slice("line_pages", F.col("_g.at") + 1, F.col("_g.to") - F.col("_g.at")), lambda p: p.isNotNull())
    split = F.col("_n") > 1
    return rows.withColumns({
        "content": F.when(split & (F.col("_k") > 0), F.concat(head, own)).otherwise(own),
        "sub_index": F.when(split, F.col("_k")).otherwise(F.lit(0)),
        "page": F.when(split, F.array_min(pages)).otherwise(F.col("page")),
        "page_end": F.when(split, F.array_max(pages)).otherwise(F.col("page_end")),
        "line_start": F.col("_g.at") + 1, "line_end": F.col("_g.to"),
        "char_start": start, "char_end": start + F.length(own),
    }).drop("_groups", "_g", "_k", "_n")


def with_ids(chunks: DataFrame) -> DataFrame:
    c = F.col
    return chunks.withColumns({
        "content_fingerprint": ids.fingerprint(c("content")),
        "chunk_id": ids.chunk_id(c("doc_id"), c("breadcrumb"), c("content"), c("sub_index")),
        "legacy_chunk_id": ids.legacy_chunk_id(c("doc_id"), c("breadcrumb"), c("raw_index"), c("sub_index")),
    })


#: Where a change stands in a file.
SOURCE = "struct<file:string,page:int,page_end:int,line_start:int,line_end:int,char_start:int,char_end:int,chunk_id:string,context_snippet:string>"


def source_ref(file: Column, chunk: Callable[[str], Column] = F.col) -> Column:
    """Of a chunk's columns (see SOURCE; raw_index; content), a reference to its place. A chunk without a page is referred to by its number, from 1."""
    snippet = F.nullif(F.substring(T.squeeze(chunk("content")), 1, 160), F.lit(""))
    places = [chunk(c).alias(c) for c in ("page_end", "line_start", "line_end", "char_start", "char_end", "chunk_id")]
    return F.struct(file.alias("file"), F.coalesce(chunk("page"), chunk("raw_index") + 1).alias("page"), *places, snippet.alias("context_snippet")).cast(SOURCE)
