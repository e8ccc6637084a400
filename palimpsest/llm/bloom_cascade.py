"""URL filter: exact rule lookup by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 those keys of the corpus that level 1 takes for listed ones; level 3 the listed
keys that level 2 takes for such; and so on until nobody is mistaken. Over the complete key universe, that is all keys
that the corpus's own urls can ask for, the levels together answer exactly, so urls are judged without a join.

Everything is a DataFrame expression. Rules are a table; building the filters joins its keys with those that the first level
mistakes for them. A filter is an array of 64-bit words held as one literal; its size follows the rule list
(about 1.44 * log2(universe / listed) bits a rule), not the corpus, and is checked against `max_filter_bits`.

Cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed. Repeated urls and page ids are
judged row by row. An empty table gives an empty result; an empty rule list allows all.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Carried, cut, let, quoted

#: Host and path of a rule, and what it says. A rule fits its host and subdomains where the url's path starts with its path.
Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Rules as a table: key (host and path), labels and length (what a url must have for it), verdict."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    labels = F.size(F.split("host", "[.]"))
    return rules.select(F.concat("host", "path").alias("key"), labels.alias("labels"), F.length("path").alias("length"), "verdict")


def lookup_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The keys under which a url could be listed: each host suffix with as many labels as some rule's host, followed by each
    beginning of the path that is as long as some rule's path."""
    keys = [F.when(F.length(path) >= m, F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m) if m else F.lit(""))) for n in labels for m in lengths]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: np.ndarray

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits).cast("bigint")) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.lit(self.words)
        found = [F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.places(key)]
        both = found[0]
        for x in found[1:]:
            both = both & x
        return both


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the universe: the first level without the key decides, odd ones against it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 0))
        return answer


def _encode(keys: DataFrame, number: int, n: int, rate: float, max_filter_bits: int) -> Level:
    """The filter of the column key; bits are set in partial aggregates, so the driver gets the finished words only."""
    bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    if bits > max_filter_bits:
        raise ValueError(f"level {number} needs {bits} bits, more than max_filter_bits")
    level = Level(number, bits, max(1, round(-math.log2(rate))), np.zeros(bits // 64, dtype=np.int64))
    at = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    rows = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) as int)))").alias("v")).collect()
    for r in rows:
        level.words[r.w] = r.v
    return level


def build_cascade(universe: DataFrame, listed: DataFrame, size: int, max_filter_bits: int = 1 << 24, max_levels: int = 60) -> Cascade:
    """universe: column key, repeats allowed; size: about how many different ones it has. listed: column key. Both stay tables: the driver
    gets finished filters, whose size is checked."""
    inside = cut(listed.select("key").distinct())
    n = inside.count()
    if not n:
        return Cascade(())
    first = _encode(inside, 1, n, min(0.5, n / max(size, 2 * n)), max_filter_bits)
    # of the universe, what the first filter takes for listed and isn't
    wrong = cut(universe.where(first.holds(F.col("key"))).select("key").distinct().join(inside, "key", "left_anti"))
    levels, sides = [first], {0: wrong, 1: inside}
    while len(levels) < max_levels:
        number = len(levels) + 1
        # who the filters of the other side have taken for theirs so far
        if number > 2:
            sides[number % 2] = sides[number % 2].where(levels[-1].holds(F.col("key")))
        wrong = sides[number % 2]
        n = wrong.count()
        if not n:
            return Cascade(tuple(levels))
        levels.append(_encode(wrong, number, n, 0.5, max_filter_bits))
    raise ValueError("the cascade didn't end: the listed keys can't be told from the universe")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced. rules: host, path, verdict."""
    listed = cut(rule_table(pages.sparkSession, rules))
    # few different numbers, however many rules there are
    shapes = listed.select("labels", "length").distinct().collect()
    work = Carried(pages, ["host", "path", "rule", "verdict"], host=url_host(F.col(quoted(url))), path=url_path(F.col(quoted(url))))
    keys = lookup_keys(F.col("host"), F.col("path"), sorted({r.labels for r in shapes}), sorted({r.length for r in shapes}))
    universe = work.rows.select(F.explode(keys).alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    verdicts = sorted(r.verdict for r in listed.select("verdict").distinct().collect())
    cascades = {v: build_cascade(universe, listed.where(F.col("verdict") == v), size) for v in verdicts}

    def says(key: Column) -> Column:
        found = F.lit(None).cast("string")
        for v in verdicts:
            found = F.when(cascades[v].holds(key), F.lit(v)).otherwise(found)
        return found

    judged = F.transform(keys, lambda k: F.struct(F.length(k).alias("length"), k.alias("rule"), says(k).alias("verdict")))
    best = let(F.array_max(F.filter(judged, lambda x: x["verdict"].isNotNull())), lambda b: F.struct(b["rule"].alias("rule"), F.coalesce(b["verdict"], F.lit(default)).alias("verdict")))
    return work.back(work.rows.withColumn("best", best), "host", "path", "best.rule", "best.verdict")


ORACLE_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, p.host AS host, p.path AS path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY page_id, p.host, p.path
"""
