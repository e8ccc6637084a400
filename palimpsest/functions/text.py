"""Text functions over columns. A null text counts as an empty one unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from palimpsest import rules
from palimpsest.functions import sequences


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it: a lambda's variable is bound, an expression is repeated."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim knows the plain space only)."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def clause_key(c: Column) -> Column:
    return F.lower(squeeze(c))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; đ, which has none, stays."""
    drop = lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if unicodedata.category(ch) != "Mn")
    return s.map(lambda x: x if x is None or x.isascii() else drop(x))


def without_variants(c: Column) -> Column:
    """Runs of spaces and tabs as one space; one form of quotes, dashes and ellipses."""
    c = F.trim(F.regexp_replace(c, r"[ \t]+", " "))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[“”„]", '"'), "[‘’]", "'"), "[–—]", "-")
    return F.replace(c, F.lit("…"), F.lit("..."))


def normalize(c: Column) -> Column:
    return without_variants(nfc(text(c)))


def plain(c: Column) -> Column:
    """Lower case, anything but word characters a space, spaces collapsed."""
    return squeeze(F.regexp_replace(F.lower(text(c)), r"(?U)[^\w\s]", " "))


def folded(c: Column) -> Column:
    return plain(without_marks(F.lower(text(c))))


def anchor_form(c: Column) -> Column:
    """The form in which two chunks count as the same: no case, marks, punctuation, or roman numerals up to ten."""
    c = F.translate(without_marks(F.lower(text(c))), "đ—–", "d--")
    c = F.regexp_replace(c, r"(?U)\b(viii|vii|vi|iv|iii|ii|ix|x|v|i)\b", " ")
    return squeeze(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def evaluation_form(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.translate(without_marks(F.lower(text(c))), "đ", "d"), r"(?U)[^\w\s]", " "))


def clause_anchor(form: Column) -> Column:
    """Of a clause key in anchor_form: its article or annex; empty without one."""
    return F.regexp_extract(form, r"(dieu\s+\d+|phu\s+luc\s+[a-z0-9]+)", 1)


def lines(c: Column) -> Column:
    found = F.transform(F.split(text(c), r"\R"), strip)
    return F.filter(found, lambda x: x != "")


def semantic_form(c: Column) -> Column:
    """What must be equal for a change to be one of form only."""
    c = F.replace(F.replace(text(c), F.lit("–"), F.lit("-")), F.lit("<br>"), F.lit(" "))
    own = F.transform(F.split(c, r"\R"), lambda x: F.regexp_replace(squeeze(x), r"^[-*•]+\s*", ""))
    c = F.regexp_replace(F.lower(F.array_join(own, " ")), r"(?U)\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]*([,.;:])", "$1"), r"(?U)([,.;:])(?=\S)", "$1 ")
    return strip(c)


def truncate(c: Column, limit: int = 240) -> Column:
    c = squeeze(c)
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))).otherwise(c)


def clip(c: Column, limit: int = 1200) -> Column:
    return F.substring(squeeze(c), 1, limit)


def words(c: Column) -> Column:
    """The set of plain words of two characters or more."""
    return F.array_distinct(F.filter(F.split(plain(c), " "), lambda w: F.length(w) > 1))


def has_keyword(form: Column, keyword: str, key_form: str | None = None) -> Column:
    """Whether a plain or folded form holds a keyword as whole words."""
    return F.instr(F.concat(F.lit(" "), form, F.lit(" ")), f" {key_form or keyword} ") > 0


def any_match(c: Column, patterns: Iterable[str], flags: str = "(?iU)") -> Column:
    return c.rlike(flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def strip_markdown(c: Column) -> Column:
    c = text(c)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "__", "_"):
        c = F.regexp_replace(c, f"(?s){mark}(.*?){mark}", "$1")
    return strip(F.regexp_replace(c, "`([^`]+)`", "$1"))


def line_style(c: Column) -> Column:
    c = F.regexp_replace(text(c), r"(?U)^[*_#\s]+", "")
    at = lambda p: c.rlike(f"(?U)^(?:{p})")
    return (
        F.when(at(r"(CHƯƠNG|Chương|PH[AẦ]N|Phần)\s+[IVXLC\d]+"), "Heading 1").when(at(r"(Đi[eề]u|ĐI[EỀ]U)\s+\d+"), "Heading 2").when(at(r"\d+\.\d+[. ]"), "Heading 3").otherwise("Normal")
    )


def table_row(c: Column) -> Column:
    cells = F.filter(F.transform(F.split(text(c), r"\|"), strip), lambda x: x != "")
    return F.array_join(cells, " | ")


def merged_cells(cells: Column) -> Column:
    """A table row's cells, stripped, without repeats of the one before (a merged cell) and empty ones."""
    own = F.transform(cells, strip)
    kept = F.filter(own, lambda x, i: (i == 0) | (x != own[i - 1]))
    return F.array_join(F.filter(kept, lambda x: x != ""), " | ")


def is_noise(c: Column) -> Column:
    return any_match(c, rules.NOISE)


def sanitize(c: Column, limit: int = 320) -> Column:
    return strip(F.substring(F.regexp_replace(squeeze(c), r"(?U)^[-*\d.)\s]+", ""), 1, limit))


def sanitize_list(items: Column, most: int, limit: int = 220) -> Column:
    cleaned = F.filter(F.transform(items, lambda x: sanitize(x, limit)), lambda x: x != "")
    return F.slice(F.array_distinct(F.coalesce(cleaned, F.array().cast("array<string>"))), 1, most)


def has_number(c: Column) -> Column:
    return text(c).rlike(r"(?U)\b\d+(?:[.,]\d+)?\b")


def is_generic_summary(c: Column) -> Column:
    return any_match(plain(c), rules.GENERIC_SUMMARIES)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """All different matches, in lower case, in order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(f"(?iU){pattern}"), F.lit(group)), F.lower))


def times(c: Column) -> Column:
    return found(c, rules.TIME)


def numbers(c: Column) -> Column:
    return found(c, rules.NUMBER)


def locations(c: Column) -> Column:
    named = F.transform(found(c, rules.LOCATION, 1), squeeze)
    cities = F.filter(F.array(*[F.lit(x) for x in rules.CITIES]), lambda x: F.lower(text(c)).contains(x))
    return F.array_distinct(F.concat(named, cities))


def subjects(c: Column) -> Column:
    named = [F.transform(found(c, p, 1), squeeze) for p in rules.SUBJECT]
    return F.array_distinct(F.concat(*named, found(c, rules.EMAIL)))


def metric_values(squeezed: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found(squeezed, pattern, 1), lambda v: F.replace(v, F.lit(","), F.lit(".")))))


def metrics(c: Column) -> Column:
    """Map of a metric's name to its values, sorted, with decimal points; without the metrics that the text hasn't."""
    pairs = lambda s: F.array(*[F.struct(F.lit(n).alias("key"), metric_values(s, p).alias("value")) for n, p in rules.METRICS.items()])
    return F.map_from_entries(F.filter(let(squeeze(c), pairs), lambda x: F.size(x["value"]) > 0))


def metric_deltas(old: Column, new: Column) -> Column:
    """Array of (metric, before, after): values in order, paired by place, that differ."""

    def of(name: str, pattern: str, x: Column, y: Column) -> Column:
        zipped = F.zip_with(metric_values(x, pattern), metric_values(y, pattern), lambda before, after: F.struct(F.lit(name).alias("metric"), before.alias("before"), after.alias("after")))
        return F.filter(zipped, lambda d: ~d["before"].eqNullSafe(d["after"]))

    both = F.struct(squeeze(old).alias("x"), squeeze(new).alias("y"))
    return let(both, lambda s: F.concat(*[of(n, p, s["x"], s["y"]) for n, p in rules.METRICS.items()]))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def labels_of(form: Column, listed: Mapping[str, Iterable[str]], forms: Mapping[str, str]) -> Column:
    """The labels any of whose keywords the form holds, in the mapping's order. forms: keywords in the same form."""
    hits = [F.when(_any([has_keyword(form, k, forms[k]) for k in keys]), F.lit(label)) for label, keys in listed.items()]
    return F.array_compact(F.array(*hits))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def plain_word(value: str) -> str:
    """plain() of one Python value, for the constants that are compared with it."""
    return " ".join("".join(ch if ch.isalnum() or ch == "_" or ch.isspace() else " " for ch in value.lower()).split())


def folded_word(value: str) -> str:
    return plain_word("".join(ch for ch in unicodedata.normalize("NFKD", value.lower()) if unicodedata.category(ch) != "Mn"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts as they are; the order of the arguments matters."""

    def ratio(x: str | None, y: str | None) -> float:
        x, y = x or "", y or ""
        return sequences.ratio(x, y)

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def text_ratio(a: Column, b: Column) -> Column:
    return sequence_ratio(F.lower(text(a)), F.lower(text(b)))


def semantic_ratio(a: Column, b: Column) -> Column:
    return sequence_ratio(semantic_form(a), semantic_form(b))


def dedupe_ratio(a: Column, b: Column) -> Column:
    return sequence_ratio(plain(a), plain(b))


@F.pandas_udf(ArrayType(StringType()))
def _distinct_texts(items: pd.Series, known: pd.Series, most: pd.Series, threshold: pd.Series) -> pd.Series:
    def one(texts, references, limit, least) -> list[str]:
        kept, forms = [], [plain_word(r) for r in references if r] if references is not None else []
        for t in texts if texts is not None else ():
            form = plain_word(t or "")
            if t and not any(form == f or sequences.ratio(form, f) >= least for f in forms):
                kept.append(t)
                forms.append(form)
            if len(kept) >= limit:
                break
        return kept

    return pd.Series([one(*x) for x in zip(items, known, most, threshold, strict=True)])


def distinct_texts(items: Column, known: Column | None = None, most: Column | int = 1_000_000, threshold: float = 0.82) -> Column:
    """Of a list the texts, in order, that neither an earlier one nor a known one says too: in plain form equal, or alike to the threshold."""
    known = F.array().cast("array<string>") if known is None else known
    return _distinct_texts(items, known, F.lit(most) if isinstance(most, int) else most, F.lit(threshold))
