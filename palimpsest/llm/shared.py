"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from palimpsest.functions.tables import batches_of, cut, drop, shared_dir, small

#: White space between words: space and U+0009 to U+000D, the characters `bytes.split()` splits on.
SPACE = "[\\x20\\x09-\\x0D]+"

__all__ = ["SPACE", "Carried", "batches_of", "cut", "drop", "let", "quoted", "row_key", "shared_dir", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a row: rows share one only if both id and text are equal."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\x00"), F.coalesce(text, F.lit("\x01")))))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it: a lambda's variable is bound, an expression is repeated."""
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Carried:
    """A caller's columns beside an operator's own: they travel in one struct `own`, so that none of their names meets one of the operator's.

    rows has the inputs under the operator's names, and own. back() gives the caller's columns in their order, without those that the
    result replaces, and after them what was made. same: columns of the caller that come back under the name of an input.
    """

    def __init__(self, docs: DataFrame, made: Iterable[str], same: Mapping[str, str] | None = None, **inputs: Column) -> None:
        replaced, self.same = {n.lower() for n in made}, dict(same or {})
        self.names = [c for c in docs.columns if c.lower() not in replaced]
        inside = [F.col(quoted(c)) for c in self.names if c not in self.same]
        self.rows = docs.select(*[c.alias(n) for n, c in inputs.items()], F.struct(*(inside or [F.lit(None).cast("boolean").alias("none")])).alias("own"))

    def schema(self, *names: str, **made: DataType) -> StructType:
        """Of rows that have own, the named inputs and what was made."""
        return StructType([*[StructField(n, self.rows.schema[n].dataType) for n in ("own", *names)], *[StructField(n, t) for n, t in made.items()]])

    def back(self, rows: DataFrame, *made: Column | str) -> DataFrame:
        return rows.select(*[F.col(self.same[n]).alias(n) if n in self.same else F.col("own").getField(n).alias(n) for n in self.names], *made)
