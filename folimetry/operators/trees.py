"""Table trees as flat arrays: parsing, sizes and ordered edit distance without recursion. Python inside UDFs.

A fragment is read leniently. An end tag closes everything up to its nearest open namesake and is ignored without one;
void and self-closing elements stay open, so what follows nests below them. An element outside all others becomes the root
in place of the one before, unless it closes itself: then both go below a new element `root`. Attributes don't matter, and
an element's text is its own pieces of text, stripped and joined by spaces.

Equal subtrees of either tree are one number. Two trees are compared level by level: going down, pairs of different
subtrees give pairs of their children, without the equal ones that both lists begin and end with; going up, all pairs of a
level with as many children are aligned at once in arrays. Equal beginnings and ends may be left out because the distance
is a metric: an alignment that pairs them is never longer.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np


class Tree:
    """Elements below a root in order of level: tag and text, number of elements below and including, children as a range."""

    def __init__(self, tags: list[str], texts: list[str], parents: list[int], root: int) -> None:
        below: list[list[int]] = [[] for _ in tags]
        for k, parent in enumerate(parents):
            if parent >= 0:
                below[parent].append(k)
        order, first = [root], []
        for k in order:  # grows while it is read
            first.append(len(order))
            order += below[k]
        self.tags, self.texts = [tags[k] for k in order], [texts[k] for k in order]
        first.append(len(order))
        size, depth = [1] * len(order), [0] * len(order)
        for k in range(len(order) - 1, -1, -1):  # lists: most trees are too small for arrays
            if first[k] < first[k + 1]:
                size[k] += sum(size[first[k] : first[k + 1]])
        for k, d in enumerate(depth):
            for child in range(first[k], first[k + 1]):
                depth[child] = d + 1
        self.first, self.size, self.depth = (np.array(v, np.int64) for v in (first, size, depth))
        self.levels = np.searchsorted(self.depth, np.arange(depth[-1] + 2))

    def __len__(self) -> int:
        return len(self.tags)


class _Reader(HTMLParser):
    """Elements in order of appearance with the element that each lies in, -1 for none."""

    def __init__(self) -> None:
        super().__init__()
        self.tags: list[str] = []
        self.words: list[list[str]] = []
        self.parents: list[int] = []
        self.path: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.root = -1

    def _element(self, tag: str) -> int:
        self.tags.append(tag)
        self.words.append([])
        self.parents.append(self.path[-1] if self.path else -1)
        self.places.setdefault(tag, []).append(len(self.path))
        self.path.append(len(self.tags) - 1)
        return self.path[-1]

    def handle_starttag(self, tag, attrs) -> None:
        outside = not self.path
        here = self._element(tag)
        if outside:
            self.root = here

    def handle_startendtag(self, tag, attrs) -> None:
        if not self.path and self.root >= 0:
            before, self.root = self.root, self._element("root")
            self.parents[before] = self.root
            self._element(tag)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if self.places.get(tag):
            keep = self.places[tag][-1]
            while len(self.path) > keep:
                self.places[self.tags[self.path.pop()]].pop()

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted: nothing asks where an element is."""
        return j

    def handle_data(self, data) -> None:
        if self.path and data.strip():
            self.words[self.path[-1]].append(data.strip())


def parse_tree(html: str) -> Tree | None:
    """The tree of a fragment; None if it has no element or can't be read."""
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except AssertionError:  # the standard parser's answer to some declarations
        return None
    return None if reader.root < 0 else Tree(reader.tags, [" ".join(w) for w in reader.words], reader.parents, reader.root)


#: Entries of child distances that are aligned at once.
CELLS = 1 << 21
#: Product of two trees' elements up to which arrays cost more than they save, and levels of such trees at most.
FEW, SHALLOW = 1200, 30


class _Subtrees:
    """Different subtrees of some trees, by number: tag and text as numbers, size, children by number."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.names: dict[str, int] = {}
        self.tags: list[int] = []
        self.texts: list[int] = []
        self.sizes: list[int] = []
        self.below: list[tuple[int, ...]] = []

    def add(self, tree: Tree) -> int:
        """The number of the whole tree."""
        number, first, sizes = [0] * len(tree), tree.first.tolist(), tree.size.tolist()
        for k in range(len(tree) - 1, -1, -1):
            tag, text = (self.names.setdefault(x, len(self.names)) for x in (tree.tags[k], tree.texts[k]))
            key = (tag, text, tuple(number[first[k] : first[k + 1]]))
            if key not in self.known:
                self.known[key] = len(self.known)
                self.tags.append(tag)
                self.texts.append(text)
                self.sizes.append(sizes[k])
                self.below.append(key[2])
            number[k] = self.known[key]
        return number[0]


def _parted(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Both lists without the equal members that they begin and end with."""
    least, a, z = min(len(x), len(y)), 0, 0
    while a < least and x[a] == y[a]:
        a += 1
    while z < least - a and x[-1 - z] == y[-1 - z]:
        z += 1
    return x[a : len(x) - z], y[a : len(y) - z]


def _aligned(costs: np.ndarray, delete: np.ndarray, insert: np.ndarray) -> np.ndarray:
    """Least cost of aligning children in order, for each of many pairs: matched at costs[:, i, j], left out or put in at
    their sizes."""
    added = np.concatenate([np.zeros((len(costs), 1)), np.cumsum(insert, axis=1)], axis=1)
    row = added
    for i in range(costs.shape[1]):
        best = row + delete[:, i, None]
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + costs[:, i])
        row = np.minimum.accumulate(best - added, axis=1) + added
    return row[:, -1]


def _few(of: _Subtrees, x: int, y: int) -> int:
    """Distance of two small subtrees, pair by pair."""
    if x == y:
        return 0
    apart = (of.tags[x] != of.tags[y]) + (of.texts[x] != of.texts[y])
    left, right = _parted(of.below[x], of.below[y])
    sizes = of.sizes
    if not left or not right:
        return apart + sum(sizes[i] for i in left) + sum(sizes[j] for j in right)
    row = [0]
    for j in right:
        row.append(row[-1] + sizes[j])
    for i in left:
        above, row = row, [row[0] + sizes[i]]
        for k, j in enumerate(right):
            row.append(min(above[k] + _few(of, i, j), above[k + 1] + sizes[i], row[k] + sizes[j]))
    return apart + row[-1]


def tree_distance(a: Tree, b: Tree) -> float:
    """Ordered edit distance of two roots: another tag costs one, another text one, and children that have no partner
    cost the size of their subtrees."""
    found = _Subtrees()
    roots = found.add(a), found.add(b)
    if len(a) * len(b) <= FEW and len(a.levels) <= SHALLOW:
        return float(_few(found, *roots))
    count = len(found.known)
    tags, texts, sizes = (np.array(v, np.int64) for v in (found.tags, found.texts, found.sizes))
    bare = np.array([not children for children in found.below])

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of pairs of which one has no children: those of the other are left over."""
        return (sizes[x] - 1.0) + (sizes[y] - 1.0) + (tags[x] != tags[y]) + (texts[x] != texts[y])

    if roots[0] == roots[1]:
        return 0.0
    if bare[roots[0]] or bare[roots[1]]:
        return float(apart(*np.array(roots)))
    levels, pairs = [], np.array([roots[0] * count + roots[1]], np.int64)
    while len(pairs):
        groups: dict[tuple[int, int], list] = {}
        for k, code in enumerate(pairs.tolist()):
            x, y = _parted(found.below[code // count], found.below[code % count])
            groups.setdefault((len(x), len(y)), []).append((k, x, y))
        level, wanted = [], [np.empty(0, np.int64)]
        for (p, q), members in groups.items():
            at, x, y = (np.array([m[i] for m in members], np.int64).reshape(len(members), *shape) for i, shape in ((0, ()), (1, (p,)), (2, (q,))))
            level.append((at, x, y))
            step = max(1, CELLS // max(p * q, 1))
            for k in range(0, len(at) if p and q else 0, step):
                left, right = x[k : k + step, :, None], y[k : k + step, None, :]
                wanted.append(np.unique((left * count + right)[(left != right) & ~bare[left] & ~bare[right]]))
        levels.append((pairs, level))
        pairs = np.unique(np.concatenate(wanted))
    known, values = np.empty(0, np.int64), np.empty(0)
    for pairs, level in reversed(levels):
        x, y = np.divmod(pairs, count)
        made = (tags[x] != tags[y]).astype(np.float64) + (texts[x] != texts[y])
        for at, x, y in level:
            p, q = x.shape[1], y.shape[1]
            if not p or not q:
                made[at] += sizes[x].sum(axis=1) + sizes[y].sum(axis=1)
                continue
            step = max(1, CELLS // (p * q))
            for k in range(0, len(at), step):
                left, right = np.broadcast_arrays(x[k : k + step, :, None], y[k : k + step, None, :])
                costs = np.where(left == right, 0.0, apart(left, right))
                deep = (left != right) & ~bare[left] & ~bare[right]
                if deep.any():
                    costs[deep] = values[np.searchsorted(known, left[deep] * count + right[deep])]
                made[at[k : k + step]] += _aligned(costs, sizes[x[k : k + step]], sizes[y[k : k + step]])
        known, values = pairs, made
    return float(values[0])


def _similarity(x: Tree | None, y: Tree | None) -> float:
    if x is None or y is None:
        return float(x is None and y is None)
    if x is y:
        return 1.0
    return max(0.0, 1 - tree_distance(x, y) / max(len(x), len(y)))


def table_similarity(a: str, b: str) -> float:
    """1 less distance over the larger tree; both unreadable 1, one 0."""
    x = parse_tree(a)
    return _similarity(x, x if a == b else parse_tree(b))


def table_similarities(a: list[str], b: list[str]) -> np.ndarray:
    """table_similarity() of each of `a` and each of `b`; each text is read once."""
    read = {t: parse_tree(t) for t in {*a, *b}}
    return np.array([[_similarity(read[x], read[y]) for y in b] for x in a])
