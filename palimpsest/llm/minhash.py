"""Near-duplicate groups by b-bit MinHash.

A text's set is that of its distinct word shingles. Documents with one set form a class, and only classes are compared. Each class
has BANDS * ROWS minima; a band's minima, hashed, name a bucket, and classes that share a bucket are candidates. Of each minimum the low
BITS bits are kept, packed into a signature; the share of equal bits, corrected for chance, estimates the similarity of a candidate
pair, and pairs whose estimate is more than SLACK under the threshold go. Two sets at the threshold of 0.85 share no bucket with probability
(1 - 0.85**4)**20 = 4e-7, at 0.8 with 2.6e-5; the estimate drops such pairs less often than that. What is left is confirmed on the full sets.

Only components are asked for, so the pairs of a bucket need not all be tried:

1. each bucket has a hub, another one in each bucket, and its members are tried against it;
2. where a bucket still holds members of different components, those outside its largest one meet all members in blocks, so many that
   one has BLOCK members and BLOCK_SHINGLES shingles a side on average. Estimates say whether a block has candidates; their full sets are then compared at once, as a product of matrices. A pair is
   tried in the first bucket that it shares, and of the links from one member to one component a block reports one.

After that no link between components is untried, and what leaves a task is links, not candidates.

Cases: a text of fewer words than a shingle has one, all its words. Null and empty texts, and texts without words, have no shingle and are
linked with nothing, as are rows without an id. Rows with one id count as one document whose sets all link it. Equal rows are in one
class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from palimpsest.llm.components import components
from palimpsest.llm.shared import Carried, cut
from palimpsest.llm.wordhash import Words, finish, pieces

BANDS, ROWS, BITS = 20, 4, 4
SLACK = 0.3
BLOCK, BLOCK_SHINGLES = 512, 1 << 19

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingle hashes, sorted within each text, and where each text's begin (and the end)."""
    words = Words(texts, lower=True)
    grams, doc = words.grams(words.hashes(), shingle)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            grams, first = _sets(batch.column("text"), shingle)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            minima = np.zeros((len(sizes), BANDS * ROWS), dtype=np.uint64)
            if len(full):
                for k, factor in enumerate(_FACTORS):
                    # multiplying mixes upwards: the shift brings the mixed half down
                    x = grams * factor
                    minima[full, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), first[:-1][full])
            low = (finish(minima) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
            packed = (low[:, ::2] << BITS) | low[:, 1::2]
            keys = [finish(sum((finish(minima[:, b * ROWS + r] + np.uint64(r)) for r in range(ROWS)), np.full(len(sizes), b, dtype=np.uint64))) for b in range(BANDS)]
            raw = [grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            digests = [xxhash.xxh3_128_digest(x) for x in raw]
            stacked = np.stack(keys, axis=1).view(np.int64)
            band_lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sizes) + 1, BANDS, dtype=np.int32)), pa.array(stacked.reshape(-1)))
            columns = [pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), band_lists, pa.array([p.tobytes() for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("doc_id"), *columns], names=["own", "doc_id", "n_shingles", "set", "bands", "signature"])

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            grams, first = _sets(batch.column("text"), shingle)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["v", "grams"])

    return run


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of each row of a with each of b (uint8 signatures), corrected for bits that are equal by chance."""
    chance = 0.5**BITS
    differ = a[:, None, :] ^ b[None, :, :]
    equal = ((differ >> BITS) == 0).sum(axis=2) + ((differ & ((1 << BITS) - 1)) == 0).sum(axis=2)
    return (equal / (2 * a.shape[1]) - chance) / (1 - chance)


def _likely(threshold: float):
    """Pairs with signatures sa, sb whose estimate may pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            differ = x ^ y
            equal = ((differ >> BITS) == 0).sum(axis=1) + ((differ & ((1 << BITS) - 1)) == 0).sum(axis=1)
            chance = 0.5**BITS
            good = (equal / (2 * x.shape[1]) - chance) / (1 - chance) >= threshold - SLACK
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return run


def _blocks(percent: int):
    """One block of members outside the largest component against one of all members: links (a, b) between components."""

    def run(table: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        outer, v, label, size, band = (table.column(c).to_numpy() for c in ("outer", "v", "label", "size", "band"))
        left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
        if not len(left) or not len(right):
            return none
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(len(v), -1)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(v), -1)
        grams = table.column("grams").combine_chunks()
        flat, ends = grams.flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(grams.offsets.to_numpy()))]
        a, b = [], []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            small, large = np.minimum.outer(size[rows], size[right]), np.maximum.outer(size[rows], size[right])
            good = (label[rows][:, None] != label[right][None, :]) & (100 * small >= percent * large)
            for k in range(int(band[0])):  # another bucket tries pairs that share an earlier one
                good &= keys[rows, k][:, None] != keys[right, k][None, :]
            if not good.any():
                continue
            good &= estimate(signature[rows], signature[right]) >= percent / 100 - SLACK
            if not good.any():
                continue
            mine, theirs = good.any(axis=1), good.any(axis=0)
            x, y, good = rows[mine], right[theirs], good[mine][:, theirs]
            listed = np.concatenate([flat[ends[i] : ends[i + 1]] for i in x])
            known, place = np.unique(listed, return_inverse=True)
            common = np.zeros(good.shape, dtype=np.float32)
            one = np.zeros((len(x), len(known)), dtype=np.float32)
            one[np.repeat(np.arange(len(x)), size[x]), place] = 1
            for part in range(0, len(y), 64):
                own = y[part : part + 64]
                other = np.concatenate([flat[ends[i] : ends[i + 1]] for i in own])
                place = np.minimum(np.searchsorted(known, other), len(known) - 1)
                hit = known[place] == other
                two = np.zeros((len(own), len(known)), dtype=np.float32)
                two[np.repeat(np.arange(len(own)), size[own])[hit], place[hit]] = 1
                common[:, part : part + 64] = one @ two.T
            total = size[x][:, None] + size[y][None, :] - common
            i, j = np.nonzero(good & (100 * common.astype(np.int64) >= percent * total.astype(np.int64)))
            _, first = np.unique(np.stack([i, label[y[j]]], axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, dtype=np.int64))
            a.append(v[x[i[first]]])
            b.append(v[y[j[first]]])
        if not a:
            return none
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


class NearDuplicates:
    """Steps of the join; work.rows: doc_id (bigint), text and own."""

    def __init__(self, work: Carried, shingle: int, percent: int) -> None:
        docs, self.percent = work.rows, percent
        schema = work.schema("doc_id", n_shingles=LongType(), set=BinaryType(), bands=ArrayType(LongType()), signature=BinaryType())
        self.rows = cut(docs.mapInArrow(_signatures(shingle), schema))
        some = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = cut(some.groupBy("set").agg(F.min("doc_id").alias("v")))
        first = some.join(self.classes, "set").where("doc_id = v")
        members = first.select("v", "set", F.col("n_shingles").alias("size"), "signature", "bands").dropDuplicates(["set"])
        self.members = cut(members)
        banded = cut(self.members.select("v", "size", F.posexplode("bands").alias("band", "key")))
        shared = cut(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", F.xxhash64("v", "band")).alias("hub")).where("n > 1"))
        self.banded = cut(banded.join(shared, ["band", "key"]))
        near = cut(self.banded.select("v").distinct())
        self.sketch = cut(self.members.join(near, "v", "left_semi").select("v", "size", "signature", "bands"))
        texts = docs.select("doc_id", "text").join(near.select(F.col("v").alias("doc_id")), "doc_id", "left_semi")
        self.sets = cut(texts.mapInArrow(_full_sets(shingle), "v bigint, grams array<bigint>").dropDuplicates(["v", "grams"]))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are similar enough."""
        one = cut(pairs).join(self.sets.select(F.col("v").alias("b"), F.col("grams").alias("y")), "b")
        both = one.join(self.sets.select(F.col("v").alias("a"), F.col("grams").alias("x")), "a")
        common = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
        return cut(common.where(100 * F.col("common") >= self.percent * (F.col("m") + F.col("n") - F.col("common"))).select("a", "b").distinct())

    def hub_pairs(self) -> DataFrame:
        pairs = self.banded.where("v <> hub").select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
        named = lambda c: self.sketch.select(F.col("v").alias(c), F.col("size").alias(f"size_{c}"), F.col("signature").alias(f"s{c}"))
        pairs = cut(pairs).join(named("a"), "a").join(named("b"), "b")
        alike = pairs.where(100 * F.least("size_a", "size_b") >= self.percent * F.greatest("size_a", "size_b"))
        return alike.select("a", "b", "sa", "sb").mapInArrow(_likely(self.percent / 100), "a bigint, b bigint")

    def other_links(self, labels: DataFrame) -> DataFrame:
        """Links between different components, from buckets that hold more than one."""
        named = self.banded.join(labels, "v", "left").select("band", "key", "v", "size", F.coalesce("label", "v").alias("label"))
        named = cut(named)
        sizes = cut(named.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("size")))
        # how much of a bucket, in blocks, all its members are, and those of its largest component
        sizes = sizes.withColumn("load", F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES))
        mixed = sizes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", "load").alias("main"), F.sum("load").alias("load"), F.max("load").alias("most")).where("parts > 1")
        mixed = cut(mixed.select("band", "key", "main", F.greatest(F.ceil(F.col("load") - F.col("most")), F.lit(1)).alias("outer_blocks"), F.ceil("load").alias("blocks")))
        inside = cut(named.join(mixed, ["band", "key"]))
        deal = lambda n: F.pmod(F.xxhash64("v", F.lit("deal")), F.col(n))
        columns = ["band", "key", "i", "j", "v", "label"]
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        outer = inside.where("label <> main").withColumn("i", deal("outer_blocks")).withColumn("j", spread("blocks")).select(*columns, F.lit(True).alias("outer"))
        every = inside.withColumn("j", deal("blocks")).withColumn("i", spread("outer_blocks")).select(*columns, F.lit(False).alias("outer"))
        # rows that share an id can have several sets; each goes with its own sketch
        full = self.sketch.join(self.sets.withColumn("size", F.size("grams").cast("bigint")), ["v", "size"])
        return self.block_links(cut(outer.unionByName(every)).join(full, "v"))

    def block_links(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("band", "key", "i", "j").applyInArrow(_blocks(self.percent), "a bigint, b bigint").distinct()

    def labels(self) -> DataFrame:
        labels = components(self.confirmed(self.hub_pairs()))
        more = cut(self.other_links(labels))
        return components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).where("a <> b").union(more))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, but for the text, with n_shingles, component_id and kept. Documents are linked if 100 * shared shingles >= percent *
    all shingles of both."""
    made = ["n_shingles", "component_id", "kept"]
    work = Carried(docs, ["text", *made], {"doc_id": "doc_id"}, doc_id=F.col("doc_id").cast("bigint"), text=F.col("text"))
    found = NearDuplicates(work, shingle, percent)
    labels = found.labels()
    named = cut(found.classes.join(labels, "v", "left").select("set", F.coalesce("label", "v").alias("label")))
    rows = found.rows.select("own", "doc_id", "n_shingles", "set").join(named, "set", "left")
    rows = rows.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id")))
    return work.back(rows, "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS v FROM c GROUP BY k),
z AS (SELECT s.doc_id, g FROM s JOIN r ON s.doc_id = r.v),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM z a JOIN z b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT v AS a, v AS b FROM r UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
m AS (SELECT a, min(b) AS label FROM t GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.label, d.doc_id) AS component_id, coalesce(m.label, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN r ON r.k = c.k LEFT JOIN m ON m.a = r.v
"""
