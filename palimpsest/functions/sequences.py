"""Matching blocks of two sequences, as Ratcliff and Obershelp define them: the longest common block, then the same on both sides of it.

Among the longest blocks the one that starts first in a counts, and of its places in b the first. A suffix automaton of b's stretch finds that in one pass over a's stretch: reading a, it
keeps the longest ending that b has; each state knows where its strings end first in b. That is linear in both stretches, where comparing all pairs of equal elements is
quadratic; the stretches of one depth of the recursion together are no longer than the sequences.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

Block = tuple[int, int, int]


def longest_block(a: Sequence[Hashable], b: Sequence[Hashable], a_low: int, a_high: int, b_low: int, b_high: int) -> Block:
    """Where it starts in a and in b, and its length, 0 if nothing is common."""
    follow: list[dict] = [{}]
    shorter, length, ends = [-1], [0], [-1]
    last = 0
    for at in range(b_low, b_high):
        x, new = b[at], len(follow)
        follow.append({})
        length.append(length[last] + 1)
        ends.append(at)
        shorter.append(0)
        state, last = last, new
        while state >= 0 and x not in follow[state]:
            follow[state][x] = new
            state = shorter[state]
        if state < 0:
            continue
        other = follow[state][x]
        if length[other] == length[state] + 1:
            shorter[new] = other
            continue
        split = len(follow)
        follow.append(follow[other].copy())
        length.append(length[state] + 1)
        ends.append(ends[other])
        shorter.append(shorter[other])
        shorter[other] = shorter[new] = split
        while state >= 0 and follow[state].get(x) == other:
            follow[state][x] = split
            state = shorter[state]
    best, start, end_in_b = 0, a_low, b_low
    state = have = 0
    for at in range(a_low, a_high):
        x = a[at]
        while state and x not in follow[state]:
            state = shorter[state]
            have = length[state]
        if x in follow[state]:
            state = follow[state][x]
            have += 1
            if have > best:
                best, start, end_in_b = have, at - have + 1, ends[state]
    return start, end_in_b - best + 1 if best else b_low, best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[Block]:
    """All blocks in order; blocks that touch in both sequences are one."""
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        a_low, a_high, b_low, b_high = todo.pop()
        i, j, n = longest_block(a, b, a_low, a_high, b_low, b_high)
        if n:
            found.append((i, j, n))
            if a_low < i and b_low < j:
                todo.append((a_low, i, b_low, j))
            if i + n < a_high and j + n < b_high:
                todo.append((i + n, a_high, j + n, b_high))
    out: list[Block] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """Twice the length of all blocks by the length of both sequences; 1 for two empty ones."""
    if not len(a) + len(b) or a == b:
        return 1.0
    return 2 * sum(n for _, _, n in matching_blocks(a, b)) / (len(a) + len(b))


def opcodes(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """What turns a into b: equal, replace, delete or insert, and the stretches of a and b that it is about."""
    out, i, j = [], 0, 0
    for x, y, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out
