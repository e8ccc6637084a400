"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from palimpsest.llm import phrases


def brute(rows, least, longest, most):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {p: a for p, a in counts.items() if a >= least}
    out = {}
    for (lang, p), a in often.items():
        inside = any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in often.items())
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * total[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k, often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((score, a, " ".join(p), l, r))
    found = []
    for lang, own in out.items():
        own.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        found += [(lang, n, p, a, l, r, total[lang], s) for n, (s, a, p, l, r) in enumerate(own[:most], 1)]
    return sorted(found)


def _rows(rng, n):
    vocabulary = ["a", "B", "c", "dé", "É", "漢", "x\x1cy", "u v", "#", "e"]
    return [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize(("block_bytes", "bucket_entries"), [(1 << 20, 1 << 20), (300, 40)])
def test_against_brute_force(spark, block_bytes, bucket_entries):
    rng = random.Random(1)
    rows = _rows(rng, 150) + [("New York City hall, new york", "en")] * 12 + [(None, "en"), ("", None), (" . ", "fr"), ("one two three four five six " * 9, "fr"), ("z " * 40, "es")]
    docs = spark.createDataFrame([(t, x, "w", 1) for t, x in rows], "text string, lang string, word string, block int").repartition(5)
    for least, longest, most in ((6, 5, 2000), (3, 3, 7)):
        found = phrases.collocations(docs, least=least, longest=longest, most=most, block_bytes=block_bytes, bucket_entries=bucket_entries).collect()
        assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found) == brute(rows, least, longest, most)


def test_nothing_frequent_and_nothing_at_all(spark):
    docs = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(docs, least=2).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a. a. a.", "en")], "text string, lang string"), least=2).count() == 0


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 3_000_000_007, 40_000_000_000_003, 5_000_000_029, 7_000_000_001
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    row = row.withColumn("top", phrases._exact(1000, F.col("a"), F.col("n"))).withColumn("bottom", phrases._exact(F.col("l"), F.col("r")))
    assert row.select(F.expr("top div bottom")).first()[0] == 1000 * a * n // (left * right)


def test_very_long_text(spark):
    words = [f"w{i % 700}" for i in range(400_000)]
    found = phrases.collocations(spark.createDataFrame([(" ".join(words), "en"), ("x" * 300_000, "en")], "text string, lang string"), most=None, block_bytes=1000).collect()
    assert len(found) == 700 and {r.k for r in found} == {5} and {r.a for r in found} == {571, 572}
