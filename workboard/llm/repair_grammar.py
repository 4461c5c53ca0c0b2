"""Cheapest edits that make role sequences legal, by a grammar shared across sequences.

A row is one symbol: the class of its role's initial (s, u, a or o for any other; upper
case if the text is truncated), or x for a row that has to go. Legal are the initials
``(s?(ua)+)?``, that is, the paths of a four-state automaton. A symbol's transfer matrix
has, from state to state, the cheapest edits of that row and of insertions behind it:
their cost and their initials, of equal costs the smaller by ASCII. The matrix of a
sequence is the min-plus product of its symbols' matrices.

The cost follows from the edits' initials, so that of two equally cheap edits of the same
rows neither begins with the other; the smaller one stays smaller whatever stands before
or behind, and products may be taken in any grouping. Re-Pair replaces pairs of symbols
that recur in a batch of sequences by new symbols; each new symbol's matrix is one product
of two known ones, evaluated once, from the bottom up, for all sequences that have it.
Edits are ropes: a rule's edits refer to those of its parts.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: Next state by kept initial; a reroled or inserted row becomes what the state calls for.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
CALLED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: Longer strings are ropes of two.
FLAT = 512
_PRIME, _BASE = 1_000_000_000_000_000_003, 256


class Rope:
    """Two strings or ropes, one after the other, with the hash of their text."""
    __slots__ = ("left", "right", "size", "digest")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, _size(left) + _size(right)
        self.digest = (_digest(left) * pow(_BASE, _size(right), _PRIME) + _digest(right)) % _PRIME


def _size(x) -> int:
    return len(x) if isinstance(x, str) else x.size


def _digest(x) -> int:
    return int.from_bytes(x.encode()) % _PRIME if isinstance(x, str) else x.digest


def joined(a, b):
    if not _size(a):
        return b
    if not _size(b):
        return a
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= FLAT else Rope(a, b)


def text_of(x) -> str:
    out, stack = [], [x]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += [x.right, x.left]
    return "".join(out)


def less(a, b) -> bool:
    """Whether the text of ``a`` is the smaller one. Equal parts at equal places are passed over by their hash."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q or (_size(p) == _size(q) and not (isinstance(p, str) and isinstance(q, str)) and _digest(p) == _digest(q)):
            continue
        if isinstance(p, str) and isinstance(q, str):
            n = min(len(p), len(q))
            if p[:n] != q[:n]:
                return p[:n] < q[:n]
            x += [p[n:]] if len(p) > n else []
            y += [q[n:]] if len(q) > n else []
        elif isinstance(q, str) or (not isinstance(p, str) and p.size >= q.size):
            x += [p.right, p.left]
            y.append(q)
        else:
            x.append(p)
            y += [q.right, q.left]
    return not x and bool(y)


#: A matrix maps (from, to) to (cost, edits); a missing pair can't be reached.
Matrix = dict[tuple[int, int], tuple[int, object]]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost_a, edits_a) in a.items():
        for j in range(4):
            end = b.get((k, j))
            if end is None:
                continue
            old, cost = out.get((i, j)), cost_a + end[0]
            if old is None or cost < old[0]:
                out[i, j] = (cost, joined(edits_a, end[1]))
            elif cost == old[0] and less(new := joined(edits_a, end[1]), old[1]):
                out[i, j] = (cost, new)
    return out


def _inserting() -> Matrix:
    """No insertion, or those on the shortest way to another state."""
    out: Matrix = {}
    for i in range(4):
        state, edits = i, ""
        while (i, state) not in out:
            out[i, state] = (COSTS[INSERT] * len(edits), edits)
            state, edits = CALLED[state], edits + INSERT
    return out


INSERTING = _inserting()


def symbol_matrix(symbol: str) -> Matrix:
    """Of one row and of insertions behind it."""
    row: Matrix = {(i, i): (COSTS[DELETE], DELETE) for i in range(4)}
    if symbol != "x":
        late = 1 if symbol.isupper() else 0
        for i in range(4):
            row[i, CALLED[i]] = (COSTS[REROLE] + late, REROLE)
            kept = KEPT.get((i, symbol.lower()))
            if kept is not None:  # never dearer than the same step by another edit
                row[i, kept] = (COSTS[KEEP] + late, KEEP)
    return product(row, INSERTING)


SYMBOLS = "suaoSUAOx"
SYMBOL_MATRICES = [symbol_matrix(x) for x in SYMBOLS]


def re_pair(sequences: list[np.ndarray], n_symbols: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (left, right) of the symbols from ``n_symbols`` on, and the sequences in them, in
    which no pair of neighbours occurs twice (pairs of one symbol may overlap). Each round
    replaces the most frequent pairs that share no symbol."""
    rules: list[tuple[int, int]] = []
    edges = np.cumsum([0, *map(len, sequences)])
    of = np.repeat(np.arange(len(sequences)), np.diff(edges))
    line = np.concatenate([np.zeros(0, dtype=np.int64), *sequences]).astype(np.int64)
    while True:
        base = n_symbols + len(rules)
        inside = of[1:] == of[:-1]
        pair = np.where(inside, line[:-1] * base + line[1:], -1)
        # in a run of one symbol every second neighbour pair counts
        twin = inside & (line[:-1] == line[1:])
        at = np.arange(len(pair))
        odd = twin & ((at - np.maximum.accumulate(np.where(twin & ~np.concatenate([[False], twin[:-1]]), at, 0))) % 2 == 1) \
            if len(pair) else twin
        usable = inside & ~odd
        kinds, counts = np.unique(pair[usable], return_counts=True)
        kinds = kinds[counts >= 2][np.argsort(-counts[counts >= 2], kind="stable")]
        if not len(kinds):
            break
        new, taken = np.full(base, -1, dtype=np.int64), np.zeros(base, dtype=bool)
        partner = np.full(base, -1, dtype=np.int64)
        for code in kinds.tolist():
            left, right = divmod(code, base)
            if not taken[left] and not taken[right]:
                taken[left] = taken[right] = True
                new[left], partner[left] = n_symbols + len(rules), right
                rules.append((left, right))
        hit = np.flatnonzero(usable & (partner[line[:-1]] == line[1:]) & (partner[line[:-1]] >= 0))
        line[hit] = new[line[hit]]
        keep = np.ones(len(line), dtype=bool)
        keep[hit + 1] = False
        line, of = line[keep], of[keep]
    cuts = np.searchsorted(of, np.arange(len(sequences) + 1))
    return rules, [line[a:b] for a, b in pairwise(cuts.tolist())]


def sequence_matrices(sequences: list[str]) -> list[Matrix]:
    """The matrix of each sequence of symbols, by one grammar of the different ones."""
    place = {x: k for k, x in enumerate(SYMBOLS)}
    different = list(dict.fromkeys(sequences))
    rules, short = re_pair([np.array([place[c] for c in x], dtype=np.int64) for x in different], len(SYMBOLS))
    known = list(SYMBOL_MATRICES)
    for left, right in rules:
        known.append(product(known[left], known[right]))
    found = {}
    for text, symbols in zip(different, short):
        parts = [known[k] for k in symbols.tolist()] or [{(i, i): (0, "") for i in range(4)}]
        while len(parts) > 1:  # by halves: ropes stay shallow
            parts = [product(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        found[text] = parts[0]
    return [found[x] for x in sequences]


def best(matrix: Matrix) -> tuple[int, str]:
    """Cost and edits of a whole conversation, from the matrix of its rows."""
    whole, found = product({(START, j): INSERTING[START, j] for j in range(4) if (START, j) in INSERTING}, matrix), None
    for state in ACCEPTING:
        end = whole.get((START, state))
        if end and (found is None or end[0] < found[0] or (end[0] == found[0] and less(end[1], found[1]))):
            found = end
    return found[0], text_of(found[1])
