"""Hashes, ids, JSON and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import clause_key, squeeze, text


def fingerprint(content: Column) -> Column:
    return F.substring(F.sha1(clause_key(content)), 1, 12)


def chunk_id(doc_id: Column, breadcrumb: Column, content: Column, sub_index: Column) -> Column:
    """Stable under re-numbering of chunks; sub-chunks of one article differ by their number."""
    return F.concat(doc_id, F.lit("__"), F.replace(text(breadcrumb), F.lit(" > "), F.lit("_")), F.lit("__fp"), fingerprint(content), F.when(sub_index > 0, F.concat(F.lit("_s"), sub_index.cast("string"))).otherwise(F.lit("")))


def legacy_chunk_id(doc_id: Column, breadcrumb: Column, raw_index: Column, sub_index: Column) -> Column:
    return F.concat(doc_id, F.lit("__"), F.replace(text(breadcrumb), F.lit(" > "), F.lit("_")), F.lit("__idx"), raw_index.cast("string"), F.lit("_sub"), sub_index.cast("string"))


def stable_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 12))


def cache_key(model: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(model, F.lit("||"), content), 256), 1, 16)


def json_object(raw: Column) -> Column:
    """The JSON object in a model's answer: a fenced one, else from the first brace to the last; null if there is none."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    found = F.coalesce(fenced, braces)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def clause_label(article: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(squeeze(article), F.lit("")), F.nullif(squeeze(title), F.lit("")), F.lit("N/A"))
