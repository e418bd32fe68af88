"""Deterministic byte automata: regex parsing, subset construction, minimisation, and scanning of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BYTES = 256


# --- patterns ------------------------------------------------------------------------------------------------
# A small regular language over bytes: literals, classes [..], groups (..), alternation |, and the repeats
# ? * + {n} {n,} {n,m}.  Escapes: \xHH and any punctuation character.


@dataclass
class Nfa:
    """Thompson automaton; ``marks`` gives the rule that a state accepts."""

    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    marks: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1


class _Parser:
    def __init__(self, nfa: Nfa, pattern: str, fold: bool):
        self.nfa, self.text, self.at, self.fold = nfa, pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = self.text[self.at: self.text.index("}", self.at)]
                self.at += len(body) + 1
                a, comma, b = body.partition(",")
                low, high = int(a), int(b) if b else (None if comma else int(a))
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.choice()
            self.take()
            return node
        if c == "[":
            return ("set", self.class_())
        return ("set", self.folded({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            value = int(self.text[self.at: self.at + 2], 16)
            self.at += 2
            return value
        return ord(c)

    def class_(self) -> frozenset[int]:
        chars: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                chars |= set(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                chars.add(low)
        self.take()
        return self.folded(chars)

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(chars)

    def build(self, node, start: int) -> int:
        """Add ``node`` behind ``start``; returns the state behind it."""
        nfa = self.nfa
        if node[0] == "set":
            end = nfa.state()
            nfa.moves[start].append((node[1], end))
            return end
        if node[0] == "seq":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if node[0] == "or":
            end = nfa.state()
            for part in node[1]:
                head = nfa.state()
                nfa.empty[start].append(head)
                nfa.empty[self.build(part, head)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.build(part, start)
        if high is None:
            loop = nfa.state()
            nfa.empty[start].append(loop)
            nfa.empty[self.build(part, loop)].append(loop)
            return loop
        end = nfa.state()
        nfa.empty[start].append(end)
        for _ in range(high - low):
            start = self.build(part, start)
            nfa.empty[start].append(end)
        return end


def add_pattern(nfa: Nfa, start: int, pattern: str, rule: int, fold: bool = False) -> None:
    p = _Parser(nfa, pattern, fold)
    nfa.marks[p.build(p.choice(), start)] = rule


# --- automata ------------------------------------------------------------------------------------------------


@dataclass
class Dfa:
    """``table[state, class_of[byte]]`` is the next state, ``accepts[state]`` a bit per rule; state 0 is dead, 1 the start."""

    table: np.ndarray
    class_of: np.ndarray
    accepts: np.ndarray

    def resets(self) -> np.ndarray:
        """Bytes that lead from every state to the start (of a searching automaton)."""
        to_start = (self.table[1:] == 1).all(axis=0)
        return to_start[self.class_of]

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """End of the longest match that begins at ``start``; -1 if there is none."""
        state, end, rows, classes, accepts = 1, -1, self.table, self.class_of, self.accepts
        for i in range(start, stop):
            state = rows[state, classes[data[i]]]
            if not state:
                break
            if accepts[state]:
                end = i + 1
        return end


def determinise(nfa: Nfa, start: int, searching: bool = False) -> Dfa:
    """Subset construction, then minimisation.  ``searching`` lets a match begin at every byte."""
    classes: dict[tuple[int, ...], int] = {}
    class_of = np.zeros(BYTES, dtype=np.uint8)
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    for b in range(BYTES):
        class_of[b] = classes.setdefault(tuple(i for i, s in enumerate(sets) if b in s), len(classes))
    sample = {c: int(np.flatnonzero(class_of == c)[0]) for c in classes.values()}

    def closure(states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = closure(frozenset([start]))
    number, order, rows = {frozenset(): 0, first: 1}, [frozenset(), first], []
    at = 0
    while at < len(order):
        here, row = order[at], []
        for c in range(len(classes)):
            b = sample[c]
            to = {t for s in here for chars, t in nfa.moves[s] if b in chars}
            goal = closure(frozenset(to | ({start} if searching and at else set())))
            if goal not in number:
                number[goal] = len(order)
                order.append(goal)
            row.append(number[goal])
        rows.append(row)
        at += 1
    accepts = np.array([sum({1 << nfa.marks[s] for s in states if s in nfa.marks}) for states in order], dtype=np.uint32)
    return _minimise(Dfa(np.array(rows, dtype=np.int32), class_of, accepts))


def _minimise(d: Dfa) -> Dfa:
    """Split state blocks until all states of a block lead to the same blocks; dead and start keep their numbers."""
    block = np.unique(np.column_stack((d.accepts,)), axis=0, return_inverse=True)[1].ravel()
    while True:
        key = np.column_stack((block, block[d.table]))
        finer = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    names: dict[int, int] = {}
    for state in range(len(block)):
        names.setdefault(int(block[state]), len(names))
    to = np.array([names[int(b)] for b in block])
    table = np.zeros((len(names), d.table.shape[1]), dtype=np.int32)
    accepts = np.zeros(len(names), dtype=np.uint32)
    table[to], accepts[to] = to[d.table], d.accepts
    if to[0] != 0 or (len(to) > 1 and to[1] != 1):
        raise ValueError("a pattern matches nothing at all")
    return Dfa(table, d.class_of, accepts)


# --- scanning ------------------------------------------------------------------------------------------------

LANE = 192  # a lane ends at the first reset byte after so many bytes


def accepting(dfa: Dfa, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rule bits) of all bytes at which a searching automaton accepts, for texts laid end to end.

    Texts are cut into lanes behind bytes after which the automaton is in its start state whatever came before,
    so a lane needs nothing from the one before it.  All lanes then take one byte per step together.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    resets = np.flatnonzero(dfa.resets()[buf]) + 1
    # at most one cut per LANE bytes: the first reset behind each grid point
    grid = np.arange(LANE, len(buf), LANE)
    nxt = np.searchsorted(resets, grid)
    cuts = resets[nxt[nxt < len(resets)]]
    starts = np.unique(np.concatenate((offsets[:-1], cuts)))
    starts = starts[starts < len(buf)]
    length = np.diff(np.append(starts, len(buf)))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    flat, width = dfa.table.ravel(), dfa.table.shape[1]
    flat = (flat * width).astype(np.int32)  # states are kept as row offsets
    hit = np.zeros(len(dfa.accepts) * width, dtype=bool)
    hit[np.flatnonzero(dfa.accepts) * width] = True
    any_hit = bool(hit.any())
    codes = dfa.class_of[buf]
    state = np.full(len(starts), width, dtype=np.int32)
    found_at, found_state = [], []
    alive, last = len(starts), int(length[0])
    ends = np.searchsorted(-length, -np.arange(last), "left")  # lanes longer than step t come first
    for t in range(last):
        n = int(ends[t])
        if n != alive:
            state, starts, alive = state[:n], starts[:n], n
        at = starts + t
        state = flat[state + codes[at]]
        if any_hit:
            h = hit[state]
            if h.any():
                i = np.flatnonzero(h)
                found_at.append(at[i])
                found_state.append(state[i])
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    at, st = np.concatenate(found_at), np.concatenate(found_state)
    order = np.argsort(at, kind="stable")
    return at[order], dfa.accepts[st[order] // width]
