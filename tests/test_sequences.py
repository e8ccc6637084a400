"""Matching blocks against difflib, alignment against the whole matrix, and their cost on long inputs."""

import difflib
import random
import time
import tracemalloc

import numpy as np
import pytest

from palimpsest.functions import sequences
from palimpsest.operators import align


@pytest.mark.parametrize("letters", ["ab", "abcd ", "abcdefghijklmnopqrstuvwxyzđ "])
def test_equal_to_difflib(letters):
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        b = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) if rng.random() < 0.5 else "".join(c if rng.random() < 0.8 else rng.choice(letters) for c in a)
        for x, y in ((a, b), (a.split(" "), b.split(" "))):
            known = difflib.SequenceMatcher(None, x, y, autojunk=False)
            assert sequences.opcodes(x, y) == known.get_opcodes()
            assert sequences.ratio(x, y) == known.ratio()
            assert sequences.longest_block(x, y, 0, len(x), 0, len(y)) == tuple(known.find_longest_match(0, len(x), 0, len(y)))


def test_long_texts_take_seconds():
    """A pair of 10000 words, for which comparing all pairs of equal letters takes minutes."""
    rng = random.Random(2)

    def seconds(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
        edited = [w if rng.random() < 0.99 else "edit" for w in words]
        began = time.process_time()
        assert sequences.ratio(" ".join(words), " ".join(edited)) > 0.9
        return time.process_time() - began

    assert seconds(10_000) < 20


def whole_matrix(sim, gap):
    """The alignment with all cells kept: the move of each cell is the first best of match, deletion and insertion."""
    n, m = sim.shape
    best, move = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), dtype=int)
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                best[i, j], move[i, j] = -gap * (i + j), 1 if i else 2
            else:
                options = [best[i - 1, j - 1] + sim[i - 1, j - 1], best[i - 1, j] - gap, best[i, j - 1] - gap]
                move[i, j] = int(np.argmax(options))
                best[i, j] = options[move[i, j]]
    i, j, out = n, m, []
    while i or j:
        step = move[i, j]
        out.append((i - 1 if step != 2 else -1, j - 1 if step != 1 else -1))
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


def test_halved_alignment_takes_the_same_path():
    rng = np.random.default_rng(3)
    for _ in range(150):
        sim = np.round(rng.random((rng.integers(0, 15), rng.integers(0, 15))) * 4) / 4  # many ties
        expected = whole_matrix(sim, 0.25)
        for leaf in (1, 2, 5, 256):
            assert align.aligned_cells(lambda i, j: sim[i, j], *sim.shape, 0.25, leaf) == expected


def test_alignment_in_linear_memory():
    n = 1500
    x = np.random.default_rng(4).normal(size=(n, 3))
    cells = lambda i, j: (x[i] * x[j]).sum(axis=1)
    tracemalloc.start()
    try:
        found = align.aligned_cells(cells, n, n, 0.4)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [i for i, _ in found if i >= 0] == list(range(n)) and most < n * n  # bytes; the whole matrix would be 9 of them a cell
