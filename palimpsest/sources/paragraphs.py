"""Sources of ordered paragraphs: doc_id, doc_label, pos, text, style, page."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T

SCHEMA = "doc_id string, doc_label string, pos int, text string, style string, page int"
MAX_BYTES = 50 << 20
SUFFIXES = (".docx", ".pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def intake(files: DataFrame) -> DataFrame:
    """Files (path, length, content) with name, sha256 and, where one can't be taken, the reason."""
    name = F.regexp_replace(F.regexp_extract(F.col("path"), r"[^/\\]+$", 0), r"(?U)[^\w.\- ]", "_")
    reason = F.when(~suffix(F.col("path")).isin(*SUFFIXES), F.lit("unsupported suffix")).when(F.col("length") > MAX_BYTES, F.lit("too large"))
    return files.withColumns({"name": name, "sha256": F.sha2("content", 256), "reason": reason})


def docx_paragraphs(files: DataFrame, label: str) -> DataFrame:
    """Word files (path, content): paragraphs and table rows in the order of the body."""

    def runs(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    def body(content: bytes) -> Iterator[tuple[str, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
            names = {}
            if "word/styles.xml" in z.namelist():
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    named = s.find(f"{_W}name")
                    names[s.get(f"{_W}styleId")] = named.get(f"{_W}val") if named is not None else None
        for node in root.find(f"{_W}body"):
            if node.tag == f"{_W}p" and (found := runs(node)):
                style = node.find(f"{_W}pPr/{_W}pStyle")
                key = style.get(f"{_W}val") if style is not None else None
                yield found, names.get(key) or key or "Normal"
            elif node.tag == f"{_W}tbl":
                for row in node.iter(f"{_W}tr"):
                    cells = [" ".join(x for p in c.iter(f"{_W}p") if (x := runs(p))) for c in row.findall(f"{_W}tc")]
                    kept = [c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])]
                    if kept:
                        yield " | ".join(kept), "Table"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path.rsplit("/", 1)[-1], label, i, t, s, None) for i, (t, s) in enumerate(body(content))]
                yield pd.DataFrame(rows, columns=["doc_id", "doc_label", "pos", "text", "style", "page"]).astype({"page": "object"})

    return files.where(suffix(F.col("path")) == ".docx").select("path", "content").mapInPandas(read, SCHEMA)


def read_docx(spark: SparkSession, path: str, label: str) -> DataFrame:
    return docx_paragraphs(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path), label)


def markdown_paragraphs(pages: DataFrame, label: str) -> DataFrame:
    """Pages of Markdown (doc_id, page, text), as a PDF reader gives them. Blocks are tables, headings or text by their first line."""
    blocks = pages.select("doc_id", "page", F.posexplode(F.split(T.text(F.col("text")), "\n\n")).alias("b", "block")).withColumn("block", T.strip(F.col("block"))).where("block <> ''")
    rows = blocks.withColumn("first", F.split("block", "\n")[0]).select("doc_id", "page", "b", "first", F.posexplode(F.split("block", "\n")).alias("l", "line"))
    table, heading = F.col("first").startswith("|"), F.col("first").startswith("#")
    row = F.when(T.strip(F.col("line")).rlike(r"(?U)^\|[\s\-:|]+\|$"), F.lit("")).otherwise(T.table_row(F.col("line")))
    body = T.strip_markdown(F.when(heading & (F.col("l") == 0), F.regexp_replace("line", r"(?U)^#+\s*", "")).otherwise(F.col("line")))
    rows = rows.withColumn("text", F.when(table, row).otherwise(body)).where("text <> ''")
    rows = rows.withColumn("style", F.when(table, F.lit("Table")).otherwise(T.line_style(F.col("text"))))
    return _numbered(rows, ["page", "b", "l"], label)


def text_paragraphs(docs: DataFrame, label: str = "doc") -> DataFrame:
    """Lines of plain texts (doc_id, text), normalised, without empty ones."""
    # squeezed before they are rows: a condition on a column repeats how the column is made
    rows = docs.select("doc_id", F.posexplode(F.transform(F.split(T.text(F.col("text")), "\n"), T.squeeze)).alias("l", "text"))
    rows = rows.where("text <> ''").withColumns({"style": F.lit("Normal"), "page": F.lit(None).cast("int")})
    return _numbered(rows, ["l"], label)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of web pages (page_id, html) in order: tag and text of headings, paragraphs and list items."""
    found = F.regexp_extract_all(T.text(F.col("html")), F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    body = T.squeeze(F.regexp_replace("raw", r"(?s)<[^>]*>", " "))
    return rows.select("page_id", "pos", F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1)).alias("tag"), body.alias("text"))


def _numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """pos counts the rows of a document from 0. A document's rows come from one input row or a few pages, so they are gathered as one
    array instead of a window over the whole table."""
    gathered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "text", "style", *[c for c in ("page",) if c not in order]))).alias("rows"))
    return gathered.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(label).alias("doc_label"), F.posexplode("rows").alias("pos", "r")).select(
        "doc_id", "doc_label", "pos", "r.text", "r.style", F.col("r.page").cast("int").alias("page")
    )


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Annotated cases (JSON files in folders named after them), one row a change."""
    schema = "pair_id string, difficulty_level string, description string, changes array<struct<type:string,location:string,v1_content:string,v2_content:string>>"
    cases = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("case_name", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return cases.select("case_name", "pair_id", "difficulty_level", F.posexplode("changes").alias("gt_ord", "c")).select("case_name", "pair_id", "difficulty_level", "gt_ord", "c.*")
