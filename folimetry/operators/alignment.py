"""Metrics that need an alignment: edit operations, optimal assignment, matched tables, text diff. Python inside UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np

from folimetry.operators.trees import table_similarities


def edit_counts(reference: str, predicted: str) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of one shortest alignment.

    Columns of the distance matrix are bit vectors of their vertical steps, so a pair of n and m characters costs m
    big-integer steps of n bits. One column in some sqrt(m) is kept; going back, those between are made again, once. A match
    or substitution is preferred to a deletion, that to an insertion.
    """
    a = 0
    while a < min(len(reference), len(predicted)) and reference[a] == predicted[a]:
        a += 1
    z = 0
    while z < min(len(reference), len(predicted)) - a and reference[-1 - z] == predicted[-1 - z]:
        z += 1
    ref, hyp = reference[a : len(reference) - z], predicted[a : len(predicted) - z]
    hits = a + z
    if not ref or not hyp:
        return hits, 0, len(ref), len(hyp)
    at: dict[str, int] = {}
    for i, c in enumerate(ref):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(ref)) - 1

    def following(state: tuple[int, int], chars: str) -> Iterator[tuple[int, int]]:
        """Steps up and down of the columns after one."""
        up, down = state
        for c in chars:
            equal = at.get(c, 0)
            vertical = equal | down
            across = (((equal & up) + up) ^ up) | equal
            plus, minus = down | ~(across | up) & full, up & across
            plus, minus = plus << 1 | 1, minus << 1
            up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
            yield up, down

    stride = isqrt(len(hyp)) + 1
    kept, state = [(full, 0)], (full, 0)
    for a in range(0, len(hyp), stride):
        for state in following(state, hyp[a : a + stride]):
            pass
        kept.append(state)
    held: dict[int, list[tuple[int, int]]] = {}

    def column(c: int) -> tuple[int, int]:
        """Column c of the matrix, from 1."""
        block = (c - 1) // stride
        if block not in held:
            if len(held) > 1:
                held.pop(max(held))
            held[block] = list(following(kept[block], hyp[block * stride : (block + 1) * stride]))
        return held[block][(c - 1) % stride]

    i, j, subs, dels, ins = len(ref), len(hyp), 0, 0, 0

    def step(row: int, c: int) -> int:
        """Distance at (row, c) less that at (row - 1, c)."""
        if c == 0:
            return 1
        u, d = column(c)
        return (u >> row - 1 & 1) - (d >> row - 1 & 1)

    here = len(hyp) + column(len(hyp))[0].bit_count() - column(len(hyp))[1].bit_count()
    while i and j:
        above = here - step(i, j)
        left_above = _distance_left(column, i, j)
        left = left_above + step(i, j - 1)
        if ref[i - 1] == hyp[j - 1] and left_above == here:
            hits, i, j, here = hits + 1, i - 1, j - 1, left_above
        elif left_above + 1 == here:
            subs, i, j, here = subs + 1, i - 1, j - 1, left_above
        elif above + 1 == here:
            dels, i, here = dels + 1, i - 1, above
        else:
            ins, j, here = ins + 1, j - 1, left
    return hits, subs, dels + i, ins + j


def _distance_left(column: Callable[[int], tuple[int, int]], i: int, j: int) -> int:
    """Distance at (i - 1, j - 1): the top row of column j - 1 is j - 1, and each bit below adds its step."""
    if j == 1:
        return i - 1
    up, down = column(j - 1)
    mask = (1 << i - 1) - 1
    return j - 1 + (up & mask).bit_count() - (down & mask).bit_count()


def edit_distance(reference: list | str, predicted: list | str) -> int:
    """Length of a shortest alignment of two texts or lists, by the same bit vectors but without keeping them."""
    a = 0
    while a < min(len(reference), len(predicted)) and reference[a] == predicted[a]:
        a += 1
    z = 0
    while z < min(len(reference), len(predicted)) - a and reference[-1 - z] == predicted[-1 - z]:
        z += 1
    ref, hyp = reference[a : len(reference) - z], predicted[a : len(predicted) - z]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    at: dict = {}
    for i, c in enumerate(ref):
        at[c] = at.get(c, 0) | 1 << i
    full, last, distance = (1 << len(ref)) - 1, 1 << len(ref) - 1, len(ref)
    up, down = full, 0
    for c in hyp:
        equal = at.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(across | up) & full, up & across
        distance += bool(plus & last) - bool(minus & last)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return distance


def char_f1(reference: str, predicted: str) -> tuple[float, float, float]:
    """Precision, recall and F1 over aligned equal characters."""
    if not reference and not predicted:
        return 1.0, 1.0, 1.0
    if not reference or not predicted:
        return 0.0, 0.0, 0.0
    hits = edit_counts(reference, predicted)[0]
    p, r = hits / len(predicted), hits / len(reference)
    return p, r, 2 * p * r / (p + r) if hits else 0.0


#: Columns up to which an assignment is found in lists; arrays cost more than they save there.
FEW = 12


def _assign_few(cost: list[list[float]], columns: int) -> list[int]:
    """assign()'s steps in lists: the row of each column, -1 for none."""
    u, v, match = [0.0] * len(cost), [0.0] * columns, [-1] * columns
    inf = float("inf")
    for row in range(len(cost)):
        least, origin, used = [inf] * columns, [-1] * columns, [False] * columns
        i, at = row, -1
        while True:
            if at >= 0:
                used[at] = True
                i = match[at]
            here, own, nxt = cost[i], u[i], -1
            for j in range(columns):
                if not used[j]:
                    reduced = here[j] - own - v[j]
                    if reduced < least[j]:
                        least[j], origin[j] = reduced, at
                    if nxt < 0 or least[j] < least[nxt]:
                        nxt = j
            delta = least[nxt]
            u[row] += delta
            for j in range(columns):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = nxt
            if match[at] < 0:
                break
        while at >= 0:
            before = origin[at]
            match[at] = match[before] if before >= 0 else row
            at = before
    return match


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of largest total score, min(rows, columns) of them: shortest augmenting paths with
    potentials."""
    rows, columns = scores.shape
    if not rows or not columns:
        return []
    if rows > columns:
        return sorted((i, j) for j, i in assign(scores.T))
    cost = -scores
    if columns <= FEW and np.isfinite(cost).all():
        return sorted((i, j) for j, i in enumerate(_assign_few(cost.tolist(), columns)) if i >= 0)
    u, v, match = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for row in range(rows):
        least, origin, used = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        i, at = row, -1
        while True:
            if at >= 0:
                used[at] = True
                i = match[at]
            reduced = cost[i] - u[i] - v
            better = ~used & (reduced < least)
            least[better], origin[better] = reduced[better], at
            nxt = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[nxt]
            u[row] += delta
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = nxt
            if match[at] < 0:
                break
        while at >= 0:
            before = origin[at]
            match[at] = match[before] if before >= 0 else row
            at = before
    return sorted((int(match[j]), j) for j in range(columns) if match[j] >= 0)


def teds(reference: list[str], predicted: list[str]) -> float:
    """Mean similarity of the best matched tables over the reference's tables; no reference NaN, no prediction 0."""
    if not reference:
        return float("nan")
    if not predicted:
        return 0.0
    scores = table_similarities(reference, predicted)
    return float(sum(scores[i, j] for i, j in assign(scores)) / len(reference))


class _Substrings:
    """All substrings of a text as states: those that end at the same places are one. Made in time linear in the text."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]  # shorter ends, longest member, where it first ends
        last = 0
        for k, c in enumerate(text):
            here = self._state(self.size[last] + 1, k, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = here
                p = self.link[p]
            if p < 0:
                self.link[here] = 0
            else:
                q = self.next[p][c]
                if self.size[q] > self.size[p] + 1:
                    part = self._state(self.size[p] + 1, self.end[q], dict(self.next[q]))
                    self.link[part], self.link[q] = self.link[q], part
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = part
                        p = self.link[p]
                    q = part
                self.link[here] = q
            last = here

    def _state(self, size: int, end: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def longest_in(self, text: str) -> tuple[int, int, int]:
        """(place in `text`, place in the own text, length) of the longest common substring: of several the first in
        `text`, then the first in the own text."""
        state = length = 0
        best = (0, 0, 0)
        for k, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            if length > best[2]:
                best = (k - length + 1, self.end[state] - length + 1, length)
        return best


def common_blocks(reference: str, predicted: str) -> list[tuple[int, int, int]]:
    """(place, place, length) of the longest common substring, and of those before it and after it in the same way, in order;
    neighbours are one. The time is linear in the texts for each depth of halving."""
    out, todo = [], [(0, len(reference), 0, len(predicted))]
    while todo:
        a, z, c, e = todo.pop()
        if a == z or c == e:
            continue
        if reference[a:z] == predicted[c:e]:
            out.append((a, c, z - a))
            continue
        i, j, n = _Substrings(predicted[c:e]).longest_in(reference[a:z])
        if n:
            i, j = a + i, c + j
            out.append((i, j, n))
            todo += [(a, i, c, j), (i + n, z, j + n, e)]
    merged: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    return merged


def diff_ops(reference: str, predicted: str) -> list[tuple[str, str, str]]:
    """Runs that are equal, replaced, deleted or inserted, between common_blocks()."""
    out, a, c = [], 0, 0
    for i, j, n in [*common_blocks(reference, predicted), (len(reference), len(predicted), 0)]:
        if a < i or c < j:
            kind = "replace" if a < i and c < j else "delete" if a < i else "insert"
            out.append((kind, reference[a:i], predicted[c:j]))
        if n:
            out.append(("equal", reference[i : i + n], predicted[j : j + n]))
        a, c = i + n, j + n
    return out
