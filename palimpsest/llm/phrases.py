"""Phrase collocations by vertical positional inverted lists.

Texts become blocks of one language each, of some megabytes. A block numbers its words in order, with a gap between pieces, so that p + 1 is the next word of the
same piece or no word at all, and keeps an inverted list for each word: the positions where it stands, ascending. Lists of words that are not frequent over the whole corpus
go. Lists of longer phrases come from shorter ones: the positions of a frequent phrase of k words are merge-joined with the postings of the words that may come next,
and what meets is split by word into the lists of phrases of k + 1 words. A word may come next only where it ends a frequent phrase of k words itself, so its postings
are the lists of those phrases: a position meets the one after it. A list's length is the phrase's exact frequency in the block, and the sum of lengths over blocks its frequency.

How blocks learn what is frequent: a block sends, by hash, its words or phrases with their list lengths, packed into one row for each bucket of hashes. A bucket's rows are
added up in one task, which numbers what is frequent and sends every block the numbers of what it has. Buckets are as many as keep each
small, a phrase has one entry a block there however often it occurs, and nothing of it passes the driver. Blocks are read one at a time and travel
to meet their answers as packed binary columns: differences, byte by byte, which compress well. Tables of a step go when the next is written.

A phrase's score is that of its worst cut: its first and last parts are phrases of the same tables, so their frequencies come from joins. Products are decimals of 38 digits.

Cases: a null text is empty; a null language is `und`. Other columns are not looked at; repeated rows and texts count each. Very long texts are blocks of their own,
and whole. Ties of score go to the shortest first part; equal ranks are ordered by a, then by the phrase's bytes. An empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import batches_of, cut, drop, quoted
from palimpsest.llm.wordhash import finish

LEAST, LONGEST, MOST_LISTED = 100, 5, 2000
BLOCK_BYTES, BUCKET_ENTRIES = 8 << 20, 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: 1: parts words, 2: parts pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

_BLOCK = "block bigint, lang string, n bigint, words binary, sizes binary, ends binary, positions binary"
#: ids and lasts: of each list the phrase's number and that of its last word.
_LISTS = "block bigint, ids binary, lasts binary, ends binary, positions binary"
#: What a block sends: places or keys of what it has, and the lengths of their lists.
_SENT = "bucket bigint, block bigint, lang string, words binary, sizes binary, keys binary, lengths binary"
#: What a bucket answers: without block all that is frequent and how often, else what of it the block has, and its place there.
_ANSWERS = "bucket bigint, block bigint, lang string, words binary, sizes binary, keys binary, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Differences of 64-bit integers, all first bytes, then all second ones, and so on."""
    return np.diff(x.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1))


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = dict(x.split() for x in schema.split(", "))
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in columns.items()})


def _lists(codes: np.ndarray, positions: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverted lists of n codes: where each one's ends, and the positions, ascending within each list if they come so."""
    order = np.argsort(codes, kind="stable")
    return np.cumsum(np.bincount(codes, minlength=n)), positions[order]


def _strings(words: bytes, sizes: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(words))


def _block(texts: list[str], lang: str, number: int) -> dict | None:
    """Words and their lists. Texts are pieces of their own."""
    raw = _LOWER[np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)]
    kind = _KIND[raw]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return None
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    ends = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw[inside].tobytes())).dictionary_encode()
    stops, positions = _lists(words.indices.to_numpy(), np.arange(len(start)) + piece, len(words.dictionary))
    known = [w.encode() for w in words.dictionary.to_pylist()]
    return {"block": number, "lang": lang, "n": len(start), "words": b"".join(known), "sizes": _packed(np.array(list(map(len, known)))), "ends": _packed(stops), "positions": _packed(positions)}


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 32, {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            found = _block(waiting.pop(lang)[1], lang, number)
            number += 1
            if found:
                yield from _table(_BLOCK, [found]).to_batches()

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                text, lang = text.as_py() or "", lang.as_py()
                held = waiting.setdefault(lang, [0, []])
                held[0] += len(text)
                held[1].append(text)
                if held[0] >= most:
                    yield from flush(lang)
                elif sum(h[0] for h in waiting.values()) >= 4 * most:
                    yield from flush(max(waiting, key=lambda k: waiting[k][0]))
        for lang in list(waiting):
            yield from flush(lang)

    return run


def _dealt(row: dict, bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray], words: list[bytes] | None = None) -> list[dict]:
    """One row for each bucket that has something of the block."""
    order, out = np.argsort(bucket, kind="stable"), []
    stops = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
    for b, (low, high) in enumerate(zip([0, *stops], stops, strict=False)):
        if high > low:
            own = order[low:high]
            sent = {"bucket": b, "block": row["block"], **{name: _packed(x[own]) for name, x in columns.items()}}
            if words is not None:
                listed = [words[i] for i in own.tolist()]
                sent |= {"lang": row["lang"], "words": b"".join(listed), "sizes": _packed(np.array(list(map(len, listed))))}
            out.append(sent)
    return out


def _words_of(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = [w.encode() for w in _strings(r["words"], _unpacked(r["sizes"])).to_pylist()]
                bucket = np.array([zlib.crc32(w) for w in words], dtype=np.int64) % buckets
                lengths = np.diff(_unpacked(r["ends"]), prepend=0)
                yield from _table(_SENT, _dealt(r, bucket, buckets, {"keys": np.arange(len(words)), "lengths": lengths}, words)).to_batches()

    return run


def _phrases_of(n_words: int, buckets: int):
    """Phrases of one more word, as phrase * n_words + last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, phrase, word = _extended(r)
                keys, lengths = np.unique(phrase * n_words + word, return_counts=True)
                bucket = (finish(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield from _table(_SENT, _dealt(r, bucket, buckets, {"keys": keys, "lengths": lengths})).to_batches()

    return run


def _frequent_words(least: int):
    def run(key: tuple, given: pa.Table) -> pa.Table:
        rows, out = given.to_pylist(), []
        number = 0
        for lang in sorted({r["lang"] for r in rows}):
            own = [r for r in rows if r["lang"] == lang]
            parts = [_strings(r["words"], _unpacked(r["sizes"])) for r in own]
            coded = pa.concat_arrays(parts).dictionary_encode()
            codes = coded.indices.to_numpy()
            sums = np.zeros(len(coded.dictionary), dtype=np.int64)
            np.add.at(sums, codes, np.concatenate([_unpacked(r["lengths"]) for r in own]))
            often = np.flatnonzero(sums >= least)
            number_of = np.full(len(sums), -1, dtype=np.int64)
            number_of[often] = number + np.arange(len(often))
            number += len(often)
            words = [w.encode() for w in coded.dictionary.take(pa.array(often)).to_pylist()]
            if words:
                out.append({"bucket": key[0].as_py(), "lang": lang, "words": b"".join(words), "sizes": _packed(np.array(list(map(len, words)))), "keys": _packed(number_of[often]), "counts": _packed(sums[often])})
            at = 0
            for r, part in zip(own, parts, strict=True):
                numbers = number_of[codes[at : at + len(part)]]
                at += len(part)
                if (numbers >= 0).any():
                    out.append({"bucket": key[0].as_py(), "block": r["block"], "keys": _packed(_unpacked(r["keys"])[numbers >= 0]), "counts": _packed(numbers[numbers >= 0])})
        return _table(_ANSWERS, out)

    return run


def _frequent(least: int):
    def run(key: tuple, given: pa.Table) -> pa.Table:
        blocks = given.column("block").to_pylist()
        lists = [_unpacked(x) for x in given.column("keys").to_pylist()]
        every, counts = np.concatenate(lists), np.concatenate([_unpacked(x) for x in given.column("lengths").to_pylist()])
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        sums = np.add.reduceat(counts[order], starts)
        keys, out = every[starts][sums >= least], []
        if len(keys):
            out.append({"bucket": key[0].as_py(), "keys": _packed(keys), "counts": _packed(sums[sums >= least])})
            for block, own in zip(blocks, lists, strict=True):
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                has = keys[place] == own
                if has.any():
                    out.append({"bucket": key[0].as_py(), "block": block, "keys": _packed(own[has]), "counts": _packed(place[has])})
        return _table(_ANSWERS, out)

    return run


def _flat(ends: np.ndarray) -> np.ndarray:
    """Of each position the number of its list."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _extended(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, phrase and next word, for each place where a phrase of one more word may be frequent: the merge join of all lists, by
    position, with the postings of the words that end one of them."""
    positions, own = _unpacked(row["positions"]), _flat(_unpacked(row["ends"]))
    order = np.argsort(positions, kind="stable")
    at, own = positions[order], own[order]
    after = np.searchsorted(at, at + 1)
    met = np.flatnonzero(at[np.minimum(after, len(at) - 1)] == at + 1)
    return at[met], _unpacked(row["ids"])[own[met]], _unpacked(row["lasts"])[own[after[met]]]


def _kept(most: int):
    """A block's lists of frequent words, from all its lists and the answers to it."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_LISTS, [])
        r = left.to_pylist()[0]
        ends, positions = _unpacked(r["ends"]), _unpacked(r["positions"])
        id_of = np.full(len(ends), -1, dtype=np.int64)
        for x in right.to_pylist():
            id_of[_unpacked(x["keys"])] = x["bucket"] * most + _unpacked(x["counts"])
        keep = id_of >= 0
        stops = np.cumsum(np.diff(ends, prepend=0)[keep])
        ids = _packed(id_of[keep])
        return _table(_LISTS, [{"block": r["block"], "ids": ids, "lasts": ids, "ends": _packed(stops), "positions": _packed(positions[keep[_flat(ends)]])}])

    return run


def _grown(n_words: int, most: int):
    """A block's lists of phrases of one more word, from its lists and the answers to it."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(_LISTS, [])
        r, answers = left.to_pylist()[0], right.to_pylist()
        keys = np.concatenate([_unpacked(x["keys"]) for x in answers])
        ids = np.concatenate([_unpacked(x["counts"]) + x["bucket"] * most for x in answers])
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        at, phrase, word = _extended(r)
        own = phrase * n_words + word
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        has = keys[place] == own
        ends, positions = _lists(place[has], at[has], len(keys))
        return _table(_LISTS, [{"block": r["block"], "ids": _packed(ids), "lasts": _packed(keys % n_words), "ends": _packed(ends), "positions": _packed(positions)}])

    return run


def _numbered_words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = _strings(r["words"], _unpacked(r["sizes"])).cast(pa.string()), _unpacked(r["counts"])
                columns = [pa.array(r["bucket"] * most + _unpacked(r["keys"])), pa.array([r["lang"]] * len(words), pa.string()), words, pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "phrase", "a"])

    return run


def _numbered(n_words: int, most: int):
    """Frequent phrases as rows: number, phrase before, last word, frequency. A bucket has `most` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = _unpacked(r["keys"]), _unpacked(r["counts"])
                yield pa.RecordBatch.from_arrays([pa.array(r["bucket"] * most + np.arange(len(keys))), pa.array(keys // n_words), pa.array(keys % n_words), pa.array(counts)], names=["id", "before", "last", "a"])

    return run


def _asked(sent: DataFrame, answer) -> tuple[DataFrame, DataFrame, int]:
    """The answers to blocks, what is frequent, and how many numbers a bucket needs."""
    answers = cut(sent.groupBy("bucket").applyInArrow(answer, _ANSWERS))
    frequent = answers.where("block IS NULL")
    each = frequent.groupBy("bucket").agg(F.sum(F.octet_length("keys") / 8).cast("bigint").alias("n"))
    return answers.where("block IS NOT NULL").select("bucket", "block", "keys", "counts"), frequent, each.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _found(blocks: DataFrame, least: int, longest: int, bucket_entries: int) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length, and lang and n."""
    total = cut(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    entries = blocks.agg(F.coalesce(F.sum(F.octet_length("sizes")), F.lit(0))).first()[0] // 8
    buckets = max(1, math.ceil(entries / bucket_entries))
    sent = blocks.select("block", "lang", "words", "sizes", "ends").mapInArrow(_words_of(buckets), _SENT)
    answers, frequent, most = _asked(sent, _frequent_words(least))
    words = cut(frequent.mapInArrow(_numbered_words(most), "id bigint, lang string, phrase string, a bigint"))
    found, n_words, numbers = [words], buckets * most, buckets * most
    if numbers:
        lists = cut(blocks.select("block", "ends", "positions").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_kept(most), _LISTS), large_rows=True)
    drop(answers)
    drop(blocks)
    for k in range(1, longest):
        if not numbers:
            break
        if numbers * n_words >= 1 << 63:
            raise ValueError("phrases and words are too many to be numbered together in 64 bits")
        buckets = max(1, math.ceil(found[-1].agg(F.sum("a")).first()[0] / bucket_entries))
        answers, frequent, most = _asked(lists.mapInArrow(_phrases_of(n_words, buckets), _SENT), _frequent(least))
        numbers = buckets * most
        if numbers:
            rows = frequent.mapInArrow(_numbered(n_words, most), "id bigint, before bigint, last bigint, a bigint")
            head, last = found[-1].select(F.col("id").alias("before"), "lang", F.col("phrase").alias("head")), words.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
            found.append(cut(rows.join(head, "before").join(last, "last").select("id", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "a")))
            if k + 1 < longest:
                grown = cut(lists.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_grown(n_words, most), _LISTS), large_rows=True)
                drop(lists)
                lists = grown
        drop(answers)
    if n_words:
        drop(lists)
    return found, total


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words with their frequency a of at least `least`: lang, k, phrase, a; and lang and n, the number of words.

    `least` is a threshold over the corpus; the other two bound a task's memory and change no result.
    """
    body, name = F.coalesce(F.col(quoted(text)), F.lit("")), F.coalesce(F.col(quoted(lang)), F.lit("und"))
    blocks = cut(docs.select(body.alias("text"), name.alias("lang")).mapInArrow(_blocks(block_bytes), _BLOCK), large_rows=True)
    # a block is a row of megabytes, and a task may read many
    with batches_of(docs.sparkSession, 1):
        found, total = _found(blocks, least, longest, bucket_entries)
    out = None
    for k, rows in enumerate(found, 1):
        rows = rows.select("lang", F.lit(k).alias("k"), "phrase", "a")
        out = rows if out is None else out.unionByName(rows)
    return out, total


def _exact(*factors: Column | int) -> Column:
    out = F.lit(1).cast("decimal(38,0)")
    for x in factors:
        out = (out * (F.lit(x) if isinstance(x, int) else x).cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, most: int | None = MOST_LISTED, **bounds: int) -> DataFrame:
    """lang, rank (from 1), phrase, k (words), a, l, r, n, score and cut (words of the first part) of each language's first `most` phrases
    of 2 to `longest` words; None: of all."""
    every, total = frequent_phrases(docs, text, lang, least, longest, **bounds)
    every = cut(every)
    candidates = every.where("k > 1").withColumn("words", F.split("phrase", " ", -1))
    # a phrase that a longer one holds as often as it occurs is also held so by the one with one word more
    inner = F.array(*[F.array_join(F.expr(f"slice(words, {at}, k - 1)"), " ") for at in (1, 2)])
    held = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    cuts = left.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "words")
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.expr("slice(words, 1, cut)"), " ").alias("head"), F.array_join(F.expr("slice(words, cut + 1, k)"), " ").alias("tail"))
    heads, tails = every.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), every.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    score = F.expr("top div bottom")
    scored = scored.withColumn("top", _exact(1000, F.col("a"), F.col("n"))).withColumn("bottom", _exact(F.col("l"), F.col("r"))).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    ranked = worst.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("k").cast("long").alias("k"), "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))


def _oracle(least: int = LEAST, longest: int = LONGEST, most: int = MOST_LISTED) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i + 1:i + {k}], ' ') AS phrase FROM pieces, unnest(range(len(w) - {k - 1})) AS t(i)" for k in range(1, longest + 1))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
split AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM split),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
phrases AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1),
inner_ AS (SELECT s.lang, array_to_string(s.w[i + 1:i + j], ' ') AS phrase, max(s.a) AS longer
 FROM candidates s, range(2, {longest}) AS u(j), range({longest - 1}) AS t(i) WHERE j < s.k AND i + j <= s.k GROUP BY ALL),
left_ AS (SELECT c.* FROM candidates c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT c.lang, c.phrase, c.a, j AS cut, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
 FROM left_ c, range(1, {longest}) AS u(j), phrases l, phrases r, total
 WHERE j < c.k AND l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:c.k], ' ') AND total.lang = c.lang),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM worst QUALIFY rank <= {most}
"""


ORACLE_SQL = _oracle()
