"""Alignment of two versions' chunks: anchors, similarities with clause bonus, global alignment of the gaps, classification.

Anchors are found for a pair of documents at once, by keys alone; what lies between two anchors is aligned as a group of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.sequences import opcodes
from palimpsest.functions.tables import cut
from palimpsest.rules import Settings

# Of each chunk on either side: pair_id, i (place in its document), key (anchor_form of the content), clause (anchor_form of the clause id),
# content, and vec, its embedding.


def cosine(a: Column, b: Column) -> Column:
    """In double, with 1e-9 added to the norms, so that zero vectors have similarity 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def clause_bonus(a: Column, b: Column) -> Column:
    """a, b: clause keys in anchor form."""
    x, y = T.clause_anchor(a), T.clause_anchor(b)
    return F.when((T.text(a) == "") | (T.text(b) == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when((x != "") & (x == y), F.lit(0.6)).otherwise(F.lit(0.0))


def with_bonus(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Similarity cells (sim, clause_a, clause_b, n_a, n_b of their gap) with the bonus where the gap is large enough."""
    on = F.greatest("n_a", "n_b") >= settings.hint_min_gap
    bonus = clause_bonus(F.col("clause_a"), F.col("clause_b"))
    return cells.withColumn("sim", F.when(on & F.lit(settings.hint_alpha > 0), F.col("sim") + settings.hint_alpha * bonus).otherwise(F.col("sim")))


def global_alignment(sim: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of the best alignment, -1 for a gap; on ties a match before a deletion before an insertion."""
    return aligned_cells(lambda i, j: sim[i, j], *sim.shape, gap)


def aligned_cells(cells: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, m: int, gap: float, leaf: int = 256) -> list[tuple[int, int]]:
    """The same for similarities that are computed when they are asked for, cells(i, j).

    By anti-diagonals, of which two at a time are kept. The way back needs the moves of a stretch of diagonals only: a long stretch is gone through once to its middle, whose two diagonals are kept while
    the way back through the second half is found, then that through the first half. So memory is linear (`leaf` diagonals of moves, two diagonals a halving), and since
    every value comes from the same sums in the same order, so do ties."""

    def on(d: int) -> tuple[int, int]:
        return max(0, d - m), min(n, d)

    def forward(before: np.ndarray, last: np.ndarray, low: int, high: int, moves: list | None) -> tuple[np.ndarray, np.ndarray]:
        """From diagonals low - 1 and low, each from its first row on, to high - 1 and high."""
        for d in range(low + 1, high + 1):
            first, end = on(d)
            (first_1, end_1), (first_2, _) = on(d - 1), on(d - 2) if d > 1 else (0, 0)
            i = np.arange(first, end + 1)
            new, move = np.full(len(i), -gap * d), np.where(i == 0, 2, 1).astype(np.int8)
            inside = slice(int(first == 0), len(i) - int(end == d))
            r = i[inside]
            if len(r):
                options = np.stack([before[r - 1 - first_2] + cells(r - 1, d - r - 1), last[r - 1 - first_1] - gap, last[r - first_1] - gap])
                move[inside], new[inside] = options.argmax(axis=0), options.max(axis=0)
            if moves is not None:
                moves.append((first, move))
            before, last = last, new
        return before, last

    out: list[tuple[int, int]] = []
    todo = [(np.zeros(0), np.zeros(1), 0, n + m)]
    row, diagonal = n, n + m
    while todo:
        before, last, low, high = todo.pop()
        if high - low > leaf:
            middle = (low + high) // 2
            half = forward(before, last, low, middle, None)
            todo += [(before, last, low, middle), (*half, middle, high)]
            continue
        high = min(high, diagonal)
        moves: list = []
        forward(before, last, low, high, moves)
        while diagonal > low:
            first, move = moves[diagonal - low - 1]
            step, column = move[row - first], diagonal - row
            out.append((row - 1 if step != 2 else -1, column - 1 if step != 1 else -1))
            row, diagonal = row - (step != 2), diagonal - (2 if step == 0 else 1)
    return out[::-1]


class Similarities:
    """Of the chunks of a gap: cosines of their vectors, with the clause bonus where the gap is large enough."""

    def __init__(self, x: np.ndarray, y: np.ndarray, clauses_a: list[str], clauses_b: list[str], settings: Settings) -> None:
        self.x, self.y = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9) for v in (x, y))
        self.alpha = settings.hint_alpha if max(len(x), len(y)) >= settings.hint_min_gap else 0.0
        numbers: dict[str, int] = {}
        code = lambda values: np.array([numbers.setdefault(v, len(numbers)) if v else -1 for v in values], dtype=np.int64)
        self.clauses = code(clauses_a), code(clauses_b)
        self.anchors = code(map(_anchor, clauses_a)), code(map(_anchor, clauses_b))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sim = np.einsum("kd,kd->k", self.x[i], self.y[j])
        if self.alpha <= 0:
            return sim
        (a, b), (c, d) = ((left[i], right[j]) for left, right in (self.clauses, self.anchors))
        known = (a >= 0) & (b >= 0)
        return sim + self.alpha * np.where(known & (a == b), 1.0, np.where(known & (c >= 0) & (c == d), 0.6, 0.0))


def _anchor(clause: str) -> str:
    found = re.search(r"(dieu\s+\d+|phu\s+luc\s+[a-z0-9]+)", clause)
    return found[1] if found else ""


def runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: pair_id, i, key. Runs of equal and unequal chunks in order: pair_id, run, tag, and left and right, the chunks' places."""

    def one(pair: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("i"), right.sort_values("i")
        x, y = left["i"].tolist(), right["i"].tolist()
        rows = [(pair[0], n, tag, x[i1:i2], y[j1:j2]) for n, (tag, i1, i2, j1, j2) in enumerate(opcodes(left["key"].tolist(), right["key"].tolist()))]
        return pd.DataFrame(rows, columns=["pair_id", "run", "tag", "left", "right"])

    columns = [F.col(c).alias(c) for c in ("pair_id", "i", "key")]
    return a.select(*columns).groupBy("pair_id").cogroup(b.select(*columns).groupBy("pair_id")).applyInPandas(one, "pair_id string, run int, tag string, left array<int>, right array<int>")


def in_gaps(found: DataFrame) -> DataFrame:
    """found: runs. The chunks (pair_id, run, side, i) whose similarity the alignment asks for: those between anchors that have chunks of the other side to be compared with."""
    gaps = found.where("tag = 'replace'")
    side = lambda name, column: gaps.select("pair_id", "run", F.lit(name).alias("side"), F.explode(column).alias("i"))
    return side("a", "left").unionByName(side("b", "right"))


def align(a: DataFrame, b: DataFrame, settings: Settings = Settings(), found: DataFrame | None = None) -> DataFrame:
    """a, b: pair_id, i, key, clause, vec. Rows in the order of the alignment: i and j (null on one side), sim, anchored. found: runs(a, b), if they are known.

    Anchored chunks and those without a counterpart come from the runs alone; a gap with chunks on both sides is a group of its own."""
    found = cut(runs(a, b)) if found is None else found

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("i"), right.sort_values("i")
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["pair_id", "run", "at", "i", "j", "sim"])
        x, y = (np.stack(side["vec"].to_list()).astype(np.float64) for side in (left, right))
        cells = Similarities(x, y, left["clause"].fillna("").tolist(), right["clause"].fillna("").tolist(), settings)
        pairs = np.array(aligned_cells(cells, len(x), len(y), settings.gap_penalty), dtype=np.int64)
        both = (pairs >= 0).all(axis=1)
        sim = np.zeros(len(pairs))
        sim[both] = cells(pairs[both, 0], pairs[both, 1])
        place = lambda side, k: pd.array(side["i"].to_numpy()[k], dtype="Int32")
        i, j = place(left, pairs[:, 0]), place(right, pairs[:, 1])
        i[pairs[:, 0] < 0], j[pairs[:, 1] < 0] = pd.NA, pd.NA
        return pd.DataFrame({"pair_id": key[0], "run": key[1], "at": np.arange(len(pairs), dtype=np.int32), "i": i, "j": j, "sim": sim})

    asked = in_gaps(found)

    def of(rows: DataFrame, name: str) -> GroupedData:
        own = asked.where(F.col("side") == name).select("pair_id", "i", "run")
        # new names for the same columns, as both sides may come from one table
        columns = [F.col(c).alias(c) for c in ("pair_id", "run", "i", "clause", "vec")]
        return rows.select("pair_id", "i", "clause", "vec").join(own, ["pair_id", "i"]).select(*columns).groupBy("pair_id", "run")

    gaps = of(a, "a").cogroup(of(b, "b")).applyInPandas(one, "pair_id string, run int, at int, i int, j int, sim double").withColumn("anchored", F.lit(False))
    equal = F.col("tag") == "equal"
    steps = F.when(equal, F.arrays_zip(F.col("left").alias("i"), F.col("right").alias("j"))).otherwise(
        F.concat(F.transform("left", lambda i: F.struct(i.alias("i"), F.lit(None).cast("int").alias("j"))), F.transform("right", lambda j: F.struct(F.lit(None).cast("int").alias("i"), j.alias("j"))))
    )
    rest = found.where("tag <> 'replace'").select("pair_id", "run", F.posexplode(steps).alias("at", "step"), F.when(equal, 1.0).otherwise(0.0).alias("sim"), equal.alias("anchored"))
    rows = rest.select("pair_id", "run", "at", "step.i", "step.j", "sim", "anchored").unionByName(gaps)
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy("run", "at")) - 1
    return rows.select("pair_id", order.alias("pair_ord"), "i", "j", "sim", "anchored")


def classify(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Aligned pairs (sim, anchored, text_a, text_b, ratio; also source_a and source_b, if they have them) to match_type, similarity and near_threshold; a pair that is too unlike
    becomes a deletion and an addition. part is 0, or 1 for the addition of such a pair."""
    s, same = F.col("sim"), F.col("ratio") >= settings.text_unchanged_ratio
    floor, ceiling = max(settings.modified, settings.unchanged - settings.near_band), settings.unchanged + settings.near_band

    def of(kind: str, sim: Column, near: Column | bool = False) -> Column:
        return F.struct(F.lit(kind).alias("match_type"), sim.alias("similarity"), (F.lit(near) if isinstance(near, bool) else near).alias("near_threshold"))

    kinds = (
        F.when(F.col("text_b").isNull(), F.array(of("DELETED", F.lit(0.0))))
        .when(F.col("text_a").isNull(), F.array(of("ADDED", F.lit(0.0))))
        .when(F.col("anchored"), F.when(same, F.array(of("UNCHANGED", F.lit(1.0)))).otherwise(F.array(of("MODIFIED", F.lit(1.0)))))
        .when(s >= settings.unchanged, F.when(~same, F.array(of("MODIFIED", s))).when(s < ceiling, F.array(of("MODIFIED", s, True))).otherwise(F.array(of("UNCHANGED", s))))
        .when(s >= floor, F.array(of("MODIFIED", s, True)))
        .when(s >= settings.modified, F.array(of("MODIFIED", s)))
        .otherwise(F.array(of("DELETED", s), of("ADDED", F.lit(0.0))))
    )
    rows = pairs.select("*", F.posexplode(kinds).alias("part", "_k")).select("*", "_k.*").drop("_k")
    split = F.col("anchored").isNotNull() & F.col("text_a").isNotNull() & F.col("text_b").isNotNull()
    sides = {"text_a": "ADDED", "text_b": "DELETED", "source_a": "ADDED", "source_b": "DELETED"}
    return rows.withColumns({c: F.when(split & (F.col("match_type") == kind), F.lit(None)).otherwise(F.col(c)) for c, kind in sides.items() if c in rows.columns})


def line_changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of texts a and b by lines: opcodes, one row each with the lines of both sides."""
    for batch in batches:
        rows = []
        for key, a, b in zip(batch["pair_id"], batch["a"], batch["b"], strict=True):
            for n, (tag, i1, i2, j1, j2) in enumerate(opcodes(list(a), list(b))):
                rows.append((key, n, tag, i1, i2, j1, j2))
        yield pd.DataFrame(rows, columns=["pair_id", "n", "tag", "i1", "i2", "j1", "j2"])


def line_opcodes(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, a and b (arrays of lines)."""
    return pairs.select("pair_id", "a", "b").mapInPandas(line_changes, "pair_id string, n int, tag string, i1 int, i2 int, j1 int, j2 int")
