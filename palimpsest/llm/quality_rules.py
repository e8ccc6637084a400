"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and repeated 3-word windows. A document that passes them is compared with its
language: the Jensen-Shannon distance (base 2, 0 to 1) between its histogram of character classes and the language's, and the same
for the language's common words. Both references are summed over all documents. Short texts have noisy histograms, so the
common-word test needs `min_common_words` words, and the base rule on 50 words guards the other.

Everything is built-in functions over one row. Texts are read once: what a row measures is written down, without the text, for the
references and the verdicts. The only shuffle is that of a handful of sums per language. Languages outside
LANGUAGES share one reference, so the broadcast table has at most five rows.

Cases: a null or empty text has no words, zero counts, and fails the base rules. A null language counts as other. Repeated rows are
judged row by row; ids play no part. An empty table gives an empty result. Columns with the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import Carried, cut, let, quoted

LANGUAGES = ("en", "de", "fr", "es")

#: Common words by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "mit"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del"),
    "other": ("a", "de", "la", "in", "the", "en", "o", "i"),
}

MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE, MIN_COMMON_WORDS = 0.29, 0.235, 100
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept")

CLASSES = ("upper", "digit", "stop", "mark", "space", "other")
#: Characters of the class stop, of the class mark, and symbols of the base rules.
STOPS, MARKS, SYMBOLS = ".,;:?!'\"()-", "#*$%&|<>@^~=+_/\\[]{}`", "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
WHITE = " \t\n\x0b\x0c\r"


def _of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more. Windows are sorted with their places; those equal to
    a neighbour are the repeated ones; each covers what its predecessor doesn't."""

    def windows(w: Column) -> Column:
        n = F.size(w)
        pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(w, 3, n - 2), lambda ab, c: F.xxhash64(ab, c))

    def repeated(placed: Column) -> Column:
        twins = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

    def covered(at: Column) -> Column:
        fresh = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(fresh, F.lit(0), lambda s, x: s + x)

    def count(hashes: Column) -> Column:
        # most texts repeat no window: finding that out needs no sort
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, lambda p: let(repeated(p), covered)))

    total = F.when(F.size(words) >= 3, let(windows(words), count))
    return F.coalesce(total, F.lit(0)).cast("bigint")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit("other"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""

    def shares(counts: Column) -> Column:
        return let(counts, lambda a: let(F.nullif(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), lambda n: F.transform(a, lambda x: x / n)))

    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(shares(p), shares(q), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _measured(rows: DataFrame) -> DataFrame:
    """rows: own, text, lang. own, the language, the base counts and the two histograms (arrays of counts)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    language = _language(F.col("lang"))

    def facts(words: Column) -> Column:
        n = F.size(words).cast("double")
        # each word between two spaces of its own, so that counting is byte search
        spaced = F.concat(F.lit(" "), F.lower(F.array_join(words, "  ")), F.lit(" "))

        def common(s: Column) -> Column:
            out = F.lit(None).cast("array<double>")
            for name, listed in COMMON.items():
                found = [(F.octet_length(s) - F.octet_length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2) for w in listed]
                out = F.when(language == name, let(F.array(*found), lambda a: F.concat(a, F.array(n - F.aggregate(a, F.lit(0.0), lambda x, y: x + y))))).otherwise(out)
            return out

        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"), _repeat_words(words).alias("n_repeat_words"), let(spaced, common).alias("common")
        )

    def marks(rare: Column) -> Column:
        """Counts over what is left without small letters and white space, which is little in most texts."""
        return F.struct(_of(rare, SYMBOLS).cast("bigint").alias("n_symbols"), F.array(*[_of(rare, c).cast("double") for c in (UPPER, "0123456789", STOPS, MARKS)]).alias("counts"))

    one_space = t
    for c in WHITE[1:]:
        one_space = F.replace(one_space, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    facts_of = rows.select(
        "own",
        language.alias("language"),
        let(F.array_remove(F.split(one_space, " "), ""), facts).alias("facts"),
        let(F.regexp_replace(t, "[a-zß-öø-ÿ\\x20\\x09-\\x0D]+", ""), marks).alias("marks"),
        F.length(t).cast("double").alias("n"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    classes = let(
        F.concat("marks.counts", F.array(F.col("n") - F.col("facts.word_chars"))), lambda a: F.concat(a, F.array(F.col("n") - F.aggregate(a, F.lit(0.0), lambda x, y: x + y)))
    )
    return facts_of.select("own", "language", "facts.n_words", "facts.word_chars", "marks.n_symbols", "n_dup_lines", "facts.n_repeat_words", F.col("facts.common").alias("common"), classes.alias("classes"))


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_class_distance: float = MAX_CLASS_DISTANCE, max_common_distance: float = MAX_COMMON_DISTANCE, min_common_words: int = MIN_COMMON_WORDS
) -> DataFrame:
    """docs, but for the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance, kept."""
    work = Carried(docs, [text, *MADE], text=F.col(quoted(text)), lang=F.col(quoted(lang)))
    measured = cut(_measured(work.rows))
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    references = measured.groupBy("language").agg(sums("classes", len(CLASSES)).alias("class_ref"), sums("common", 9).alias("common_ref"))
    rows = measured.join(F.broadcast(references), "language")
    rows = rows.withColumn("class_distance", F.coalesce(_distance(F.col("classes"), F.col("class_ref")), F.lit(0.0)))
    common = F.coalesce(_distance(F.col("common"), F.col("common_ref")), F.lit(0.0))
    rows = rows.withColumn("common_distance", F.when(F.col("n_words") >= min_common_words, common).otherwise(F.lit(0.0)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = (F.col("class_distance") > max_class_distance) | (F.col("common_distance") > max_common_distance)
    return work.back(rows.withColumn("kept", ~F.col("base_failed") & ~far), *MADE)


def _sql() -> str:
    """The same in DuckDB: counts by lists and windows, both references by sums, the distances over unnested histograms."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    of = lambda chars: f"(length(text) - length(translate(text, {quote(chars)}, '')))::DOUBLE"
    counted = lambda w: f"len(list_filter(v, lambda x: x = {quote(w)}))::DOUBLE"
    common = " ".join(f"WHEN language = '{name}' THEN [{', '.join(map(counted, listed))}]" for name, listed in COMMON.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN {LANGUAGES} THEN lang ELSE 'other' END AS language,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM g),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM t WHERE times > 1) GROUP BY doc_id),
v AS (SELECT doc_id, language, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, list_transform(w, lambda x: lower(x)) AS v,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, language, n_words, word_chars, {of(SYMBOLS)}::BIGINT AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(text)::DOUBLE AS n,
             [{of(UPPER)}, {of("0123456789")}, {of(STOPS)}, {of(MARKS)}, (length(text) - word_chars)::DOUBLE] AS c5, CASE {common} END AS k8 FROM v),
h AS (SELECT *, list_append(c5, n - list_sum(c5)) AS c, list_append(k8, n_words - list_sum(k8)) AS k FROM m),
p AS (SELECT doc_id, language, 'c' AS kind, unnest(c) AS x, generate_subscripts(c, 1) AS place FROM h UNION ALL SELECT doc_id, language, 'k', unnest(k), generate_subscripts(k, 1) FROM h),
q AS (SELECT language, kind, place, sum(x) AS y FROM p GROUP BY ALL),
s AS (SELECT doc_id, kind, x / nullif(sum(x) OVER (PARTITION BY doc_id, kind), 0) AS x, y / nullif(sum(y) OVER (PARTITION BY doc_id, kind), 0) AS y FROM p JOIN q USING (language, kind, place)),
j AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2)) AS distance FROM s GROUP BY ALL),
f AS (SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, coalesce(a.distance, 0) AS class_distance, coalesce(b.distance, 0) AS common_distance
      FROM h LEFT JOIN r USING (doc_id) LEFT JOIN j a ON a.doc_id = h.doc_id AND a.kind = 'c' LEFT JOIN j b ON b.doc_id = h.doc_id AND b.kind = 'k')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND class_distance <= {MAX_CLASS_DISTANCE} AND (n_words < {MIN_COMMON_WORDS} OR common_distance <= {MAX_COMMON_DISTANCE}) AS kept FROM f
"""


ORACLE_SQL = _sql()
