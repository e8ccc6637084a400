"""BPE encoding and decoding with a vocabulary file of the library tokenizers.

Encoding one pre-token: its symbols form a doubly linked list, and a priority queue holds the merges that neighbours allow, least rank first and
among equal ranks the leftmost. A popped entry whose symbols have changed meanwhile is stale and skipped; else its two symbols become one, and the
merges with its neighbours on both sides join the queue. A pre-token of n characters takes O(n log n), so unbroken text of any length does.
Short pre-tokens of a batch are merged side by side in numpy: the queue of each is one entry a symbol, the merge with its right neighbour, so that a
change overwrites what would be stale; each round pops the least entry of every queue.

The library normalises and splits (both are tables of Unicode, read from the file); merges and decoding are done here. Where a vocabulary's pre-tokens never
hold white space, words are encoded apart; words and pre-tokens are remembered, up to `most` of them: when half as many are known, they become the older half, and those
that recur come back from there.

Decoding concatenates the vocabulary's strings: those of all ids of a batch are taken from one Arrow array, so a text is a slice of what
lies there. A file without a decoder joins them by a space, as the library does; byte-level ones give bytes, and bytes that are no UTF-8 give U+FFFD.

Cases: a null or empty text has no ids and decodes to an empty text. Ids out of the vocabulary, and null ids, decode to nothing. Ties of rank
go to the left. Repeated rows are encoded each; very long texts are encoded whole, word by word. An empty table gives an empty result. Other columns pass through; those with
the result's name are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from palimpsest.llm.shared import Carried, quoted
from palimpsest.llm.wordhash import pieces

MOST = 200_000

#: Pre-tokens up to so many characters are merged side by side: a pop looks at a whole queue there.
SHORT = 40

_NONE = np.int64(1) << np.int64(62)

#: Words that normalisers at most lower-case: ASCII, and the letters of Latin-1.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SIMPLE_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ \t-\r]*")

#: The known way to split, and what it comes to over lower-cased simple words; its alternatives begin with different characters, but for the apostrophe's, so their order is free otherwise.
_SPLITS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": "[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\\sa-zß-öø-ÿ0-9]+"}


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


_BYTE_CHARS = dict(enumerate(_byte_chars()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class WordMemory:
    """Ids of words of a vocabulary whose pre-tokens never hold white space, each found out once as long as it is remembered.

    `simple` splits words that are only lower-cased, where the file says so; their new pre-tokens go to `_ids_of` together, other words to `_learn`."""

    def __init__(self, simple: regex.Pattern | re.Pattern | None, most: int) -> None:
        self.simple, self.most = simple, most
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[str, bytes]] = ({}, {})

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Of pre-tokens in byte characters."""
        raise NotImplementedError

    def _learn(self, word: str) -> bytes:
        raise NotImplementedError

    @staticmethod
    def simple_pattern(spec: dict) -> regex.Pattern | re.Pattern | None:
        """What splits simple words, once lower-cased, where the file says that nothing else happens to them."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            return None
        plain = parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        pattern = parts[0]["pattern"]["Regex"]
        return (re.compile(_SPLITS[pattern]) if pattern in _SPLITS else regex.compile(pattern)) if plain else None

    def _split(self, simple: str) -> list[str]:
        return self.simple.findall(simple.lower())

    def _remember_parts(self, parts: set[str]) -> None:
        new, older = parts - self.parts.keys(), self.older[1]
        back = new & older.keys()
        self.parts.update([(p, older[p]) for p in back])
        fresh = list(new - back)
        by_bytes = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_CHARS) for p in fresh]
        self.parts.update(zip(fresh, self._ids_of(by_bytes), strict=True))

    def _remember_words(self, words: set[bytes]) -> None:
        new, older = words - self.known.keys(), self.older[0]
        back = new & older.keys()
        self.known.update([(w, older[w]) for w in back])
        simple = {}
        for raw in new - back:
            word = raw.decode()
            if self.simple and _SIMPLE.fullmatch(word) and "<|" not in word:
                simple[raw] = self._split(word)
            else:
                self.known[raw] = self._learn(word)
        self._remember_parts(set().union(*simple.values()))
        self.known.update([(raw, b"".join([self.parts[p] for p in parts])) for raw, parts in simple.items()])

    def by_word(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes. Texts of simple words only are split as they are."""
        if 2 * (len(self.known) + len(self.parts)) > self.most:
            self.older, self.known, self.parts = (self.known, self.parts), {}, {}
        simple = [bool(self.simple and _SIMPLE_TEXT.fullmatch(t) and "<|" not in t) for t in texts]
        listed = [self._split(t) if s else t.encode().split() for t, s in zip(texts, simple, strict=True)]
        self._remember_parts(set().union(*[x for x, s in zip(listed, simple, strict=True) if s]))
        self._remember_words(set().union(*[x for x, s in zip(listed, simple, strict=True) if not s]))
        parts, known = self.parts, self.known
        return [b"".join([parts[p] for p in x] if s else [known[w] for w in x]) for x, s in zip(listed, simple, strict=True)]


class Encoder(WordMemory):
    def __init__(self, path: str, most: int = MOST) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE vocabularies are known")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        #: Of a pair, left * size + right, its rank; of a rank, what the pair becomes.
        self.size = max(self.vocabulary.values()) + 1
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocabulary[left] * self.size + self.vocabulary[right]] = rank
            self.made.append(self.vocabulary[left + right])
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that are matched as they are, are known")
        listed = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.added = re.compile(f"({listed})") if listed else None
        probe = "a b's\n12  c"
        self.by_words = [p for w in probe.split() for p in self._parts(w)] == self._parts(probe) and not any(re.search(r"\s", x) for x in self.special)
        super().__init__(self.simple_pattern(spec), most)
        # as arrays: keys of pairs in order, with one more id for what lies beyond a pre-token's ends; ids of single characters within and at the end of a pre-token
        keys = np.array([left * (self.size + 1) + right for left, right in (divmod(k, self.size) for k in self.ranks)], dtype=np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), dtype=np.int64)[order]
        self.made_ids = np.array(self.made, dtype=np.int64)
        self.inner, self.final = (np.array([self.vocabulary.get(chr(c) + end, -1) for c in range(512)], dtype=np.int64) for end in ("", self.suffix))

    def _parts(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [p for p, _ in self.split.pre_tokenize_str(text)] if self.split else [text] if text else []

    def merge(self, part: str) -> list[int]:
        """The ids of one pre-token. Entries of the queue are rank << 32 | place."""
        vocabulary, size, rank_of = self.vocabulary, self.size, self.ranks.get
        ids = [vocabulary[s] for s in (*part[:-1], part[-1] + self.suffix) if s in vocabulary]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [rank << 32 | at for at in range(n - 1) if (rank := rank_of(ids[at] * size + ids[at + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, at = entry >> 32, entry & 0xFFFFFFFF
            right = after[at]
            if ids[at] < 0 or right >= n or rank_of(ids[at] * size + ids[right]) != rank:
                continue
            made = self.made[rank]
            ids[at], ids[right] = made, -1
            after[at] = further = after[right]
            if further < n:
                before[further] = at
                if (rank := rank_of(made * size + ids[further])) is not None:
                    heapq.heappush(queue, rank << 32 | at)
            left = before[at]
            if left >= 0 and (rank := rank_of(ids[left] * size + made)) is not None:
                heapq.heappush(queue, rank << 32 | left)
        return [i for i in ids if i >= 0]

    def _entries(self, left: np.ndarray, right: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Queue entries of the merges of two symbols: rank << 32 | place, or _NONE."""
        keys = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at] << 32 | places, _NONE)

    def merge_all(self, parts: list[str]) -> list[bytes]:
        """The packed ids of short pre-tokens (not empty, characters below U+0200)."""
        if not parts or not len(self.pairs):
            return [_packed(self.merge(p)) for p in parts]
        order = sorted(range(len(parts)), key=lambda n: len(parts[n]))
        sizes = np.array([len(parts[n]) for n in order], dtype=np.int64)
        codes = np.frombuffer("".join([parts[n] for n in order]).encode("utf-16-le"), dtype="<u2")
        ids, last = self.inner[codes], np.cumsum(sizes) - 1
        ids[last] = self.final[codes[last]]
        if (ids < 0).any():  # characters that the vocabulary lacks are left out
            return [_packed(self.merge(p)) for p in parts]
        n, first = len(ids), last - sizes + 1
        # place n is beyond all ends
        ids = np.r_[ids, self.size]
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        before[first], after[last] = n, n
        queue = np.full(n + 1, _NONE)
        places = np.arange(n)
        queue[:n] = self._entries(ids[:n], ids[after[:n]], places)
        busy = first
        while len(busy):
            # queues in between that have run empty hold _NONE only
            least = np.minimum.reduceat(queue[busy[0] : n], busy - busy[0])
            some = least < _NONE
            busy, least = busy[some], least[some]
            at, made = least & 0xFFFFFFFF, self.made_ids[least >> 32]
            right, left = after[at], before[at]
            further = after[right]
            ids[at], ids[right], queue[right] = made, -1, _NONE
            after[at], before[further] = further, at
            queue[at] = self._entries(made, ids[further], at)
            queue[left] = self._entries(ids[left], made, left)
        stay = ids[:n] >= 0
        raw = ids[:n][stay].astype("<i4").tobytes()
        stops = (4 * np.r_[0, np.cumsum(np.add.reduceat(stay.astype(np.int64), first))]).tolist()
        out = [b""] * len(parts)
        for k, a, b in zip(order, stops, stops[1:], strict=False):
            out[k] = raw[a:b]
        return out

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        short = iter(self.merge_all([p for p in parts if len(p) <= SHORT]))
        return [next(short) if len(p) <= SHORT else _packed(self.merge(p)) for p in parts]

    def _learn(self, word: str) -> bytes:
        out = []
        for segment in self.added.split(word) if self.added else [word]:
            if segment in self.special:
                out.append(_packed([self.special[segment]]))
            elif segment:
                out += [self._part(p) for p in self._parts(segment)]
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = self.older[1].get(part) or _packed(self.merge(part))
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        return self.by_word(texts) if self.by_words else [self._encode(t) for t in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _encode(self, text: str) -> bytes:
        out = []
        for segment in self.added.split(text) if self.added else [text]:
            if segment in self.special:
                out.append(_packed([self.special[segment]]))
            elif segment:
                if len(self.parts) > self.most:
                    self.parts.clear()
                out += [self._part(p) for p in self._parts(segment)]
        return b"".join(out)


class Decoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError("only byte-level decoders, and none, are known")
        strings = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.between = "" if kind else " "
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        plain = lambda s: bytes([byte_of[c] for c in s]) if kind and all(c in byte_of for c in s) else s.encode()
        # ids that the vocabulary doesn't have, and at its end one for all beyond it, have no string
        self.strings = pa.array([plain(strings[i]) + self.between.encode() if i in strings else b"" for i in range(max(strings) + 2)], pa.large_binary())

    def decode(self, lists: pa.Array) -> list[str]:
        lists = pc.if_else(pc.is_null(lists), pa.scalar([], lists.type), lists)
        ids, last = lists.flatten().fill_null(-1).to_numpy(), len(self.strings) - 1
        found = self.strings.take(pa.array(np.where((ids < 0) | (ids > last), last, ids)))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1]
        raw = memoryview(found.buffers()[2] or b"")
        stops = ends[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]].tolist()
        return [str(raw[a : max(a, b - len(self.between))], "utf-8", "replace") for a, b in zip(stops, stops[1:], strict=False)]


_encoders: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' other columns and ids. path: a vocabulary file, at the same place on all executors."""
    work = Carried(docs, [text, "ids"], text=F.col(quoted(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for batch in pieces(batches, "text"):
            ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            ends = np.r_[0, np.cumsum([len(i) // 4 for i in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("own"), lists], names=["own", "ids"])

    return work.back(work.rows.mapInArrow(run, work.schema(ids=ArrayType(IntegerType()))), "ids")


def decode(rows: DataFrame, path: str, ids: str = "ids", keep_ids: bool = False) -> DataFrame:
    """rows' other columns and decoded; with keep_ids the ids stay too."""
    work = Carried(rows, ["decoded"] if keep_ids else [ids, "decoded"], ids=F.col(quoted(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoders.get(path) or _decoders.setdefault(path, Decoder(path))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(decoder.decode(batch.column("ids")), pa.string())], names=["own", "decoded"])

    return work.back(work.rows.mapInArrow(run, work.schema(decoded=StringType())), "decoded")
