"""Near copies by DataFrame operations alone, for steps that run no Python.

The method, its parameters and its cases are those of `minhash`: classes of equal sets, bands of minima, hubs, then blocks, full sets confirm. What differs is how a step says it.
Minima are aggregates over the shingles of a text; a shingle's 80 hashes are Murmur's, with the minimum's number first, taken by groups of 16. Of each, the low 4 bits go into a signature of five numbers, whose differing digits
are counted as bits. A block is a join of its two sides, whose condition tries sizes, earlier buckets and estimates before it compares full sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.minhash import BANDS, BITS, ROWS, SLACK, NearDuplicates
from palimpsest.llm.shared import SPACE, cut, let, small

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Minima of a group, which has a row of its own: with all 80 in one row, the aggregate's code is too long for the JVM's compiler.
_DIGITS = 64 // BITS
GROUPS = BANDS * ROWS // _DIGITS
_LOWEST = sum(1 << BITS * k for k in range(_DIGITS))


def shingles(text: Column, shingle: int) -> Column:
    """Hashes of the distinct word shingles; of a text of fewer words one, all its words; none without words."""
    words = F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), SPACE), "")

    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (shingle - 1), F.lit(1)))
        return F.when(F.size(hashes) > 0, F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, shingle))))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _signature(minima: list[Column]) -> Column:
    """The low bits of a group's minima, packed."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(m.bitwiseAND(F.lit((1 << BITS) - 1)).cast("bigint"), BITS * k) for k, m in enumerate(minima)])


def likely(a: Column, b: Column, threshold: float) -> Column:
    """Whether the estimate of two signatures may pass; digits that are equal by chance are corrected for."""
    differ = F.lit(0)
    for k in range(GROUPS):
        x = a[k].bitwiseXOR(b[k])
        any_bit = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x, s) if s else x for s in range(BITS)])
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(_LOWEST)))
    chance = 0.5**BITS
    return differ <= BANDS * ROWS * (1 - chance) * (1 - threshold + SLACK)


class Families(NearDuplicates):
    """docs: row (see shared.row_key), doc_id (bigint) and text."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int) -> None:
        self.percent = percent
        docs = docs.where("doc_id IS NOT NULL")
        grams = shingles(F.col("text"), shingle)
        # exploded as a whole first: a column that is named several times would be computed as often
        listed = docs.select("row", "doc_id", F.explode(F.array(grams)).alias("grams"))
        named = listed.select("row", "doc_id", F.xxhash64("grams").alias("a"), F.xxhash64(F.lit("b"), "grams").alias("b"), F.size("grams").cast("bigint").alias("size"), "grams")
        each = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g")).select("row", "doc_id", "a", "b", "size", "g", F.explode("grams").alias("gram"))
        least = [F.min(F.hash(F.lit(k), "g", "gram")).alias(f"m{k}") for k in range(_DIGITS)]
        minima = [F.col(f"m{k}") for k in range(_DIGITS)]
        bands = F.array(*[F.xxhash64("g", F.lit(at), *minima[at : at + ROWS]) for at in range(0, _DIGITS, ROWS)])
        # a text's shingles lie in one task, so what is shuffled is a row a text and group
        sketched = each.groupBy("row", "doc_id", "a", "b", "size", "g").agg(*least).select("row", "doc_id", F.struct("a", "b").alias("set"), "size", "g", _signature(minima).alias("signature"), bands.alias("bands"))
        sketched = sketched.groupBy("row", "doc_id", "set", "size").agg(F.array_sort(F.collect_list(F.struct("g", "signature", "bands"))).alias("s"))
        self.rows = cut(sketched.select("row", "doc_id", "set", "size", F.col("s.signature").alias("signature"), F.flatten("s.bands").alias("bands")))
        one = F.min(F.struct(F.col("doc_id").alias("v"), "row", "size", "signature", "bands")).alias("one")
        self.members = cut(self.rows.groupBy("set").agg(one).select("set", "one.*"))
        self.classes = self.members.select("set", "v")
        banded = cut(self.members.select("v", "size", F.posexplode("bands").alias("band", "key")))
        shared = cut(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", F.xxhash64("v", "band")).alias("hub")).where("n > 1"))
        self.banded = cut(banded.join(shared, ["band", "key"]))
        near = cut(self.banded.select("v").distinct())
        self.sketch = cut(self.members.join(near, "v", "left_semi").select("v", "row", "size", "signature", "bands"))
        own = docs.select("row", "text").join(small(cut(self.sketch.select("row", "v"))), "row")
        self.sets = cut(own.select("v", grams.alias("grams")))

    def hub_pairs(self) -> DataFrame:
        pairs = self.banded.where("v <> hub").select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
        side = lambda c: self.sketch.select(F.col("v").alias(c), F.col("size").alias(f"size_{c}"), F.col("signature").alias(f"s{c}"))
        pairs = cut(pairs).join(side("a"), "a").join(side("b"), "b")
        return pairs.where((100 * F.least("size_a", "size_b") >= self.percent * F.greatest("size_a", "size_b")) & likely(F.col("sa"), F.col("sb"), self.percent / 100)).select("a", "b")

    def block_links(self, rows: DataFrame) -> DataFrame:
        """Of the links from one member to one component, one."""
        name = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("v", "label", "size", "signature", "bands", "grams")]
        block = ["band", "key", "i", "j"]
        a, b = (rows.where(F.col("outer") == F.lit(s == "a")).select(*block, *name(s)) for s in "ab")
        x, y = ({c: F.col(f"{c}_{s}") for c in ("v", "label", "size", "signature", "bands", "grams")} for s in "ab")
        fits = (x["label"] != y["label"]) & (100 * F.least(x["size"], y["size"]) >= self.percent * F.greatest(x["size"], y["size"]))
        # another bucket tries pairs that share an earlier one; keys of different bands differ
        first = (F.col("band") == 0) | ~F.arrays_overlap(F.slice(x["bands"], F.lit(1), F.col("band")), F.slice(y["bands"], F.lit(1), F.col("band")))
        common = let(F.size(F.array_intersect(x["grams"], y["grams"])).cast("bigint"), lambda n: 100 * n >= self.percent * (x["size"] + y["size"] - n))
        tried = fits & likely(x["signature"], y["signature"], self.percent / 100)
        links = a.join(b, block).where(F.when(tried, F.when(first, common).otherwise(F.lit(False))).otherwise(F.lit(False)))
        return links.groupBy(x["v"].alias("a"), y["label"].alias("label")).agg(F.min(y["v"]).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_families(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs: row (see shared.row_key), doc_id and text. row and component_id (the smallest doc_id reachable) of each that has words and an id, as minhash.near_duplicates has them."""
    found = Families(docs.select("row", F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shingle, percent)
    labels = found.labels()
    named = cut(found.classes.join(labels, "v", "left").select("set", F.coalesce("label", "v").alias("component_id")))
    return found.rows.select("row", "set").join(named, "set").select("row", "component_id")
