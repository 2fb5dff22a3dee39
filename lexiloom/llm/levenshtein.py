"""A universal Levenshtein automaton for one edit, with transposition states, and a trie to run it over.

The automaton reads one name's code points and knows the other name only by characteristic vectors: the bits that say
where the code point read stands in the window of three around the present place. So one table of transitions, worked out
from the rules below, serves all names. A state is a set of positions (offset, errors, swapping): offset is how far the other
name's place is ahead of the place read, and swapping says that its next two code points are being read in exchanged order.

At one edit, exchanging two code points and editing between them never pays, so the automaton's distances are those of the
unrestricted rule; damerau() is that rule, for verification.
"""

from __future__ import annotations

import numpy as np

EDITS = 1
SPAN = range(-EDITS, EDITS + 1)  # the window's offsets
DEAD = 0


def _read(position: tuple[int, int, bool], bits: int) -> set[tuple[int, int, bool]]:
    """Where a position leads when the code point read stands in the window where bits say."""
    o, e, swapping = position
    here = lambda k: k in SPAN and bool(bits >> (k + EDITS) & 1)
    if swapping:
        return {(o + 1, e, False)} if here(o) else set()
    out = {(o, e, False)} if here(o) else set()
    if e < EDITS:
        out |= {(o - 1, e + 1, False), (o, e + 1, False)}  # read one too many; read another one
        if here(o + 1):
            out |= {(o + 1, e + 1, False), (o - 1, e + 1, True)}  # one was left out; two are exchanged
    return {p for p in out if p[0] in SPAN}


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(transitions, ends): the state after each state and vector, state 0 dead and 1 the first; and for each state the
    least errors of a position at each offset (a large number where there is none)."""
    number: dict[frozenset, int] = {frozenset(): DEAD, frozenset({(0, 0, False)}): 1}
    todo, rows = [frozenset(), frozenset({(0, 0, False)})], []
    while len(rows) < len(todo):
        state, row = todo[len(rows)], []
        for bits in range(1 << len(SPAN)):
            after = frozenset(q for p in state for q in _read(p, bits))
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    ends = [[min((e for o, e, s in state if o == k and not s), default=99) for k in SPAN] for state in todo]
    return np.array(rows, np.int16), np.array(ends, np.int16)


def points(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of names in a row, and where each one's begin (one more entry than names)."""
    at = np.concatenate([[0], np.cumsum([len(n) for n in names], dtype=np.int64)])
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), at


class Trie:
    """The trie of different names in order of code points, made level by level as searches get there."""

    def __init__(self, names: list[str]) -> None:
        self.names = sorted(set(names))  # Python orders strings by code points
        self.data, self.at = points(self.names)
        self.size = np.diff(self.at)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._inside, self._node = np.arange(len(self.names)), np.zeros(len(self.names), np.int64)
        self.root_name = 0 if len(self.names) and not self.names[0] else -1

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, letter, name): the children at depth + 1 of node k of depth are first[k] to first[k + 1]; their letters, and
        the name that ends at each, or -1."""
        while len(self.levels) <= depth:
            d = len(self.levels)
            nodes = len(self.levels[-1][1]) if d else 1
            more = self.size[self._inside] > d
            inside, parent = self._inside[more], self._node[more]
            letter = self.data[self.at[inside] + d]
            new = np.ones(len(inside), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            node = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            name = np.full(len(starts), -1, np.int64)
            over = self.size[inside] == d + 1
            name[node[over]] = inside[over]
            self.levels.append((np.searchsorted(parent[starts], np.arange(nodes + 1)), letter[starts], name))
            self._inside, self._node = inside, node
        return self.levels[depth]


class Search:
    """Names of a trie at most one edit away."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie
        self.step, self.ends = automaton()

    def near(self, wanted: list[str], block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in wanted, place in trie.names, distance) of all pairs, `block` wanted names at a time."""
        found = [self._block(wanted[k : k + block], k) for k in range(0, len(wanted), block)]
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))

    def _block(self, wanted: list[str], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, at = points(wanted)
        size = np.diff(at)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who = np.arange(len(wanted))
        node, state, depth = np.zeros(len(wanted), np.int64), np.ones(len(wanted), np.int16), 0

        def ended(who: np.ndarray, name: np.ndarray, state: np.ndarray, read: int) -> None:
            best = np.full(len(who), 99, np.int64)
            for k in SPAN:
                left = size[who] - (read + k)
                best = np.where(left >= 0, np.minimum(best, self.ends[state, k + EDITS] + left), best)
            good = best <= EDITS
            out.append((who[good] + first, name[good], best[good]))

        if self.trie.root_name >= 0:
            ended(who, np.full(len(who), self.trie.root_name), state, 0)
        while len(who):
            start, letter, name = self.trie.level(depth)
            count = start[node + 1] - start[node]
            who, state = np.repeat(who, count), np.repeat(state, count)
            child = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[node], count)
            bits = np.zeros(len(who), np.int64)
            for k in SPAN:
                place = depth + k
                inside = (place >= 0) & (place < size[who])
                there = data[np.where(inside, at[who] + place, 0)] if len(data) else np.zeros(len(who), np.int64)
                bits |= (inside & (there == letter[child])).astype(np.int64) << (k + EDITS)
            state = self.step[state, bits]
            alive = state != DEAD
            who, state, node = who[alive], state[alive], child[alive]
            depth += 1
            over = name[node] >= 0
            ended(who[over], name[node[over]], state[over], depth)
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def damerau(a: str, b: str, most: int) -> int:
    """The fewest insertions, deletions, substitutions and exchanges of adjacent code points that turn a into b, parts edited
    again where that is shorter; any number above `most` stands for more. Work is in the band that `most` allows."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b) + 1
    rows: list[dict[int, int]] = [{j: j for j in range(min(len(b), most) + 1)}]
    last: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        row: dict[int, int] = {}
        low, high = max(0, i - most), min(len(b), i + most)
        # the last place in b that holds a's present letter; further before the band it would cost too much
        match = b.rfind(a[i - 1], max(0, low - most - 2), max(0, low - 1)) + 1
        for j in range(low, high + 1):
            if j == 0:
                row[0] = i
                continue
            same = a[i - 1] == b[j - 1]
            best = min(row.get(j - 1, far) + 1, rows[i - 1].get(j, far) + 1, rows[i - 1].get(j - 1, far) + (not same))
            k, m = last.get(b[j - 1], 0), match
            if k and m and j > m:
                best = min(best, rows[k - 1].get(m - 1, far) + (i - k - 1) + 1 + (j - m - 1))
            if same:
                match = j
            row[j] = best
        rows.append(row)
        last[a[i - 1]] = i
    return min(rows[len(a)].get(len(b), far), most + 1)
