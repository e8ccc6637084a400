"""SentencePiece encoding and decoding with n-best segmentations.

The lattice of a text has an edge for each piece of the model that spells a stretch of it, and one for each character without a piece,
which is spelled in byte pieces and scores UNKNOWN below the worst piece. A segmentation's score is the sum of its pieces' scores.

Forward Viterbi gives each place the best score of a path from the start. Going backwards from the end, that is exactly what is missing to a
full path, so A-star with it as heuristic yields segmentations best first and expands no path that isn't part of one.

No piece crosses into a new run of spaces or holds a line end, so the lattice of a text is a chain of lattices, one for each unit (spaces and the
word after them). Viterbi runs over many units of one length at once, forwards and backwards, which also tells by how much a unit's second
best falls behind. The n best of a text differ from its best one in the n - 1 units of the smallest gaps only, and A-star runs on those.

Units of more than LONG characters (text without spaces, encoded data) have a lattice of their own that is linear in memory: it keeps the best score and the best edge of each
place, and makes the edges of a stretch when they are asked for. As the heuristic is exact, an entry of the queue is worth the best path that it can become, so the queue
needs no more entries than there are paths still wanted, and paths share what they have in common through the path that they leave.

Cases: a null or empty text has one segmentation, without pieces, of score 0. A text with fewer than n segmentations has fewer rows. Very long texts are encoded whole.
Ties are broken by the order of the search, which is fixed. Repeated rows are encoded each. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType

from palimpsest.llm.shared import Carried, quoted
from palimpsest.llm.wordhash import Spans

N_BEST, UNKNOWN, KNOWN_UNITS, KNOWN_CHARS, BITMAP = 3, 10.0, 500_000, 8_000_000, 20
LONG, STRETCH = 64, 1 << 15

SPACE = "▁"
_UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

#: A unit's best ids (bytes), its score, and by how much the second best falls behind.
Best = tuple[bytes, float, float]

#: Numbers of units, pieces and scores.
Edge = tuple[np.ndarray, np.ndarray, np.ndarray]


class PieceModel:
    """The pieces and scores of a SentencePiece model with byte pieces and neither normalisation nor removal of spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "\u00c5\ufb01  b "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("this model normalises texts, or puts no space before them")
        self.bytes_of: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.scores = np.array([model.get_score(i) for i in range(model.get_piece_size())])
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any("\n" in p or SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model crosses units")
        self.longest = max(map(len, self.ids), default=1)
        usual = self.scores[list(self.ids.values())]
        self.unknown = float(usual[usual > -1e8].min()) - UNKNOWN if len(usual) else -UNKNOWN
        points, ends = np.frombuffer("".join(self.ids).encode("utf-32-le"), dtype="<u4"), np.cumsum([len(p) for p in self.ids])
        hashes = self._spans(points).raw(np.r_[0, ends[:-1]], ends) if len(points) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], np.array(list(self.ids.values()), dtype=np.int64)[order]
        self.bitmap = np.zeros(1 << BITMAP, dtype=bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITMAP)] = True
        self.units: dict[str, Best] = {}
        self.alternatives: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.chars = 0
        self.lattice: Lattice | None = None

    @staticmethod
    def _spans(points: np.ndarray) -> Spans:
        return Spans(points.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15)

    def spell(self, char: str) -> list[int]:
        found = self.ids.get(char)
        return [found] if found is not None else [self.byte_ids.get(b, 0) for b in char.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded; the space before its first word isn't part of it."""
        return b"".join([self.bytes_of[i] for i in ids]).decode(errors="replace")[1:]

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The units of some texts, after Viterbi over new ones, those of one length at once. What is remembered stays bounded: if it
        grows too much, only the units of these texts stay."""
        listed = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set().union(*listed)
        new = wanted - self.units.keys()
        self.chars += sum(map(len, new))
        if len(self.units) > KNOWN_UNITS or self.chars > KNOWN_CHARS:
            self.units = {u: self.units[u] for u in wanted if u in self.units}
            self.chars = sum(map(len, wanted))
            self.alternatives.clear()
        by_length: dict[int, list[str]] = {}
        for u in new:
            if len(u) > LONG:
                best, *second = self.search(u, 2)
                self.units[u] = (best[1], best[0], best[0] - second[0][0] if second else np.inf)
            else:
                by_length.setdefault(len(u), []).append(u)
        for length, same in by_length.items():
            for at in range(0, len(same), max(1, 400_000 // length)):
                self._viterbi(same[at : at + max(1, 400_000 // length)], length)
        return listed

    def _edges(self, units: list[str], n: int) -> dict[tuple[int, int], Edge]:
        """By start and end, the units of length n that have an edge there, with its piece (-1: none) and score. All stretches of one width are
        looked up at once; a bitmap over the hashes' first bits turns most of those away that are no piece."""
        m = len(units)
        spans = self._spans(np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4"))
        edges: dict[tuple[int, int], Edge] = {}
        for width in range(1, min(n, self.longest) + 1):
            starts = n - width + 1
            at = (np.arange(starts)[:, None] + np.arange(m)[None, :] * n).reshape(-1)
            hashes = spans.raw(at, at + width)
            maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - BITMAP)])
            hashes = hashes[maybe]
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes
            found, ids = maybe[hit], self.by_hash[place[hit]]
            scores = self.scores[ids]
            if width == 1:
                every, score = np.full(m * n, -1, dtype=np.int64), np.full(m * n, self.unknown)
                every[found], score[found] = ids, scores
                found, ids, scores = np.arange(m * n), every, score
            cuts = np.searchsorted(found, np.arange(starts + 1) * m).tolist()
            for start, (low, high) in enumerate(itertools.pairwise(cuts)):
                if high > low:
                    edges[start, start + width] = (found[low:high] - start * m, ids[low:high], scores[low:high])
        return edges

    def _viterbi(self, units: list[str], n: int) -> None:
        m, rows = len(units), np.arange(len(units))
        edges = self._edges(units, n)
        forward, backward = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        came = np.zeros((n + 1, m), dtype=np.int32)
        forward[0], backward[n] = 0, 0
        for (start, end), (own, _, score) in sorted(edges.items(), key=lambda e: (e[0][1], e[0][0])):
            total = forward[start, own] + score
            better = total > forward[end, own]
            own = own[better]
            forward[end, own] = total[better]
            came[end, own] = start
        for (start, end), (own, _, score) in sorted(edges.items(), key=lambda e: -e[0][0]):
            backward[start, own] = np.maximum(backward[start, own], backward[end, own] + score)
        # which edges the best paths take; the best path through any other is the second best
        ends_at, chosen = np.full(m, n), np.full((n + 1, m), -1, dtype=np.int32)
        for _ in range(n):
            on = ends_at > 0
            if not on.any():
                break
            start = came[ends_at, rows]
            chosen[ends_at[on], rows[on]] = start[on]
            ends_at = np.where(on, start, 0)
        second, ids_at = np.full(m, -np.inf), np.zeros((n + 1, m), dtype=np.int64)
        for (start, end), (own, ids, score) in edges.items():
            taken = chosen[end, own] == start
            ids_at[end, own[taken]] = ids[taken]
            other = own[~taken]
            second[other] = np.maximum(second[other], forward[start, other] + score[~taken] + backward[end, other])
        row, end = np.nonzero(chosen.T >= 0)
        ids = ids_at[end, row]
        raw, stops = ids.astype("<i4").tobytes(), (4 * np.cumsum(np.bincount(row, minlength=m))).tolist()
        at = 0
        for unit, stop, best, gap in zip(units, stops, forward[n].tolist(), (forward[n] - second).tolist(), strict=True):
            self.units[unit] = (raw[at:stop], best, gap)
            at = stop
        for k in np.unique(row[ids < 0]).tolist():
            low, high = np.searchsorted(row, (k, k + 1))
            parts = [[i] if i >= 0 else self.spell(units[k][e - 1]) for i, e in zip(ids[low:high].tolist(), end[low:high].tolist(), strict=True)]
            self.units[units[k]] = (np.array(list(itertools.chain(*parts)), dtype="<i4").tobytes(), *self.units[units[k]][1:])

    def search(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The unit's n best segmentations: score and ids. A-star from the end to the start."""
        if len(unit) > LONG:
            if self.lattice is None or self.lattice.unit != unit:
                self.lattice = Lattice(self, unit)
            return self.lattice.search(n)
        found = self.alternatives.get((unit, n))
        if found is not None:
            return found
        edges: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(len(unit) + 1)]
        forward = [0.0] + [-np.inf] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(unit[start:end])
                if i is not None or end == start + 1:
                    score = float(self.scores[i]) if i is not None else self.unknown
                    edges[end].append((start, score, [i] if i is not None else self.spell(unit[start])))
                    forward[end] = max(forward[end], forward[start] + score)
        # among equals the one nearest to the start goes on, so ties don't widen the search
        heap: list[tuple[float, int, tuple[int, ...], float]] = [(-forward[-1], len(unit), (), 0.0)]
        out: list[tuple[float, bytes]] = []
        while heap and len(out) < n:
            _, at, ids, behind = heapq.heappop(heap)
            if not at:
                out.append((behind, np.array(ids, dtype="<i4").tobytes()))
                continue
            for start, score, own in edges[at]:
                if forward[start] > -np.inf:
                    heapq.heappush(heap, (-(forward[start] + score + behind), start, (*own, *ids), behind + score))
        self.alternatives[unit, n] = out
        return out

    def _bytes(self, ids: bytes) -> bytes:
        return b"".join([self.bytes_of[i] for i in np.frombuffer(ids, dtype="<i4").tolist()])

    def segment(self, units: list[str], n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text, given as its learnt units: score and ids (32-bit little-endian)."""
        return [(score, ids) for score, ids, _ in self.segment_and_compare(units, n)]

    def segment_and_compare(self, units: list[str], n: int) -> list[tuple[float, bytes, bool]]:
        """Also whether the ids decode to what those of the best one do; only the units that differ are decoded for that."""
        known = self.units
        best = [known[u] for u in units]
        parts, scores, gaps = map(list, zip(*best, strict=True)) if best else ([], [], [])
        total, places = sum(scores), []
        while gaps and len(places) < n - 1 and (least := min(gaps)) < np.inf:
            places.append(gaps.index(least))
            gaps[places[-1]] = np.inf
        places.sort()
        # the n best of some units and one more are among the n best of those units with the n best of the other
        mixed: list[tuple[float, tuple[bytes, ...]]] = [(0.0, ())]
        for i in places:
            more = [(behind + score - best[i][1], (*chosen, ids)) for behind, chosen in mixed for score, ids in self.search(units[i], n)]
            mixed = sorted(more, key=lambda x: (-x[0], x[1]))[:n]
        out = []
        for behind, chosen in mixed:
            own = parts.copy()
            for i, ids in zip(places, chosen, strict=True):
                own[i] = ids
            same = all(ids == parts[i] or self._bytes(ids) == self._bytes(parts[i]) for i, ids in zip(places, chosen, strict=True))
            out.append((total + behind, b"".join(own), same))
        return out


class Lattice:
    """One long unit."""

    def __init__(self, model: PieceModel, unit: str) -> None:
        self.model, self.unit = model, unit
        self.points = np.frombuffer(unit.encode("utf-32-le"), dtype="<u4")
        n = len(unit)
        self.stretch: tuple[int, list[list[tuple[int, int, float]]]] = (-1, [])
        #: Of each place the score of the best path from the start, where its last edge begins, and that edge's piece.
        self.forward = array("d", [0.0]) + array("d", [-math.inf]) * n
        self.start, self.piece = array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        forward = self.forward
        for low in range(0, n, STRETCH):
            for end, edges in enumerate(self._into(low // STRETCH), low + 1):
                for start, piece, score in edges:
                    total = forward[start] + score
                    if total > forward[end]:
                        forward[end], self.start[end], self.piece[end] = total, start, piece

    def _into(self, number: int) -> list[list[tuple[int, int, float]]]:
        """For each place of a stretch the edges that end there: start, piece (-1: none) and score, longest first."""
        if self.stretch[0] == number:
            return self.stretch[1]
        model, low = self.model, number * STRETCH
        high = min(low + STRETCH, len(self.points))
        before = max(0, low - model.longest)
        spans = model._spans(self.points[before:high])
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(high - low)]
        for width in range(min(model.longest, high), 0, -1):
            ends = np.arange(max(low, width - 1) + 1, high + 1)
            hashes = spans.raw(ends - width - before, ends - before)
            place = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
            hit = model.hashes[place] == hashes if len(model.hashes) else np.zeros(len(ends), dtype=bool)
            for end, piece in zip(ends[hit].tolist(), model.by_hash[place[hit]].tolist(), strict=True):
                out[end - low - 1].append((end - width, piece, float(model.scores[piece])))
            if width == 1:
                for end in ends[~hit].tolist():
                    out[end - low - 1].append((end - 1, -1, model.unknown))
        self.stretch = (number, out)
        return out

    def search(self, n: int) -> list[tuple[float, bytes]]:
        """The n best paths: score and ids. A-star from the end to the start; what leaves a path waits in the queue, the best n there."""
        forward, out, walked = self.forward, [], []
        # worth, when it was met, the path that it leaves and after how many pieces, the piece it takes instead, from where on, and the score behind
        queue: list[tuple] = [(-forward[-1], 0, -1, 0, None, len(self.points), 0.0)]
        met = itertools.count(1)
        while queue and len(out) < n:
            _, _, path, depth, taken, at, behind = queue.pop(0)
            ends, pieces_ = (walked[path][0][:depth], walked[path][1][:depth]) if path >= 0 else (array("q"), array("i"))
            if taken is not None:
                ends.append(taken[0])
                pieces_.append(taken[1])
            room = n - len(out) - 1
            while at:
                best = self.start[at]
                for start, piece, score in self._into((at - 1) // STRETCH)[(at - 1) % STRETCH]:
                    if start == best:
                        ahead = score
                    else:
                        worth = forward[start] + score + behind
                        if len(queue) < room or room and worth > -queue[-1][0]:
                            bisect.insort(queue, (-worth, next(met), len(walked), len(ends), (at, piece), start, behind + score))
                            del queue[room:]
                ends.append(at)
                pieces_.append(self.piece[at])
                at, behind = best, behind + ahead
            walked.append((ends, pieces_))
            ids = np.array(pieces_[::-1], dtype="<i4")
            if (ids < 0).any():
                places = ends[::-1]
                ids = np.array(list(itertools.chain(*[[i] if i >= 0 else self.model.spell(self.unit[e - 1]) for i, e in zip(ids.tolist(), places, strict=True)])), dtype="<i4")
            out.append((behind, ids.tobytes()))
        return out


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    return _models.get(path) or _models.setdefault(path, PieceModel(path))


def segment(docs: DataFrame, path: str, text: str = "text", n: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """A row for each of the n best segmentations: docs' other columns, rank (from 1), score, n_pieces, ids_crc32, decoded_sha256 (of what
    the ids decode to, UTF-8), and with with_ids the ids. path: a model file, at the same place on all executors."""
    made = {"rank": IntegerType(), "score": DoubleType(), "n_pieces": LongType(), "ids_crc32": LongType(), "decoded_sha256": StringType()}
    if with_ids:
        made["ids"] = ArrayType(IntegerType())
    work = Carried(docs, [text, "ids", *made], text=F.col(quoted(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[tuple] = []
                texts = batch.column("text").to_pylist()
                for k, units in enumerate(model.learn(texts)):
                    digest = ""
                    for rank, (score, ids, same) in enumerate(model.segment_and_compare(units, n), 1):
                        if rank == 1 or not same:
                            digest = hashlib.sha256(model.decode(np.frombuffer(ids, dtype="<i4").tolist()).encode()).hexdigest()
                        rows.append((k, rank, score, len(ids) // 4, zlib.crc32(ids), digest, np.frombuffer(ids, dtype="<i4").tolist() if with_ids else None))
                columns = {"own": batch.column("own").take(pa.array([r[0] for r in rows], pa.int64()))}
                for i, (name, kind) in enumerate(made.items(), 1):
                    columns[name] = pa.array([r[i] for r in rows], to_arrow_type(kind))
                yield pa.RecordBatch.from_pydict(columns)

    return work.back(work.rows.mapInArrow(run, work.schema(**made)), *made)
