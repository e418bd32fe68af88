"""Secrets in whole texts: all rules compiled into one automaton that reads every byte once.

The searching automaton tells where some rule ends a match.  Only there, between the nearest byte that resets
the automaton and that end, the rule's own automaton finds where the leftmost match begins and how far it goes.
Matches of one rule never overlap; a match that fails its length is dropped and still uses up its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .automata import Dfa, Nfa, accepting, add_pattern, determinise

_SLICE = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``head``: part of the pattern in front of the value; a match counts if at least ``least`` characters follow it.

    ``probe``: what every match begins with, ending before a counted or open run.  It stands for the rule in the
    combined automaton, where counts that can begin anew inside one another would multiply the states; the rule's
    own automaton settles the whole pattern.
    """

    kind: str
    pattern: str
    fold: bool = False
    head: str = ""
    least: int = 0
    probe: str = ""


# fixed values: the three base rules
_KEYWORD = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
BASE = (
    Rule("assign", _KEYWORD + "[A-Za-z0-9+/_.=\\-]+", True, _KEYWORD, 12),
    # a run that is too short holds no longer one, so the least lengths can stand in the patterns
    Rule("access", "AKIA[A-Z0-9]{14,}", probe="AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", probe="gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", "xox[abprs]\\-[A-Za-z0-9\\-]{10,}", probe="xox[abprs]\\-"),
    Rule("google", "AIza[A-Za-z0-9_\\-]{35,}", probe="AIza"),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]{16,}", probe="[rs]k_(live|test)_"),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]{8,}\\.eyJ[A-Za-z0-9_\\-]{8,}\\.[A-Za-z0-9_\\-]{8,}", probe="eyJ[A-Za-z0-9_\\-]"),
    Rule("pem", "\\-\\-\\-\\-\\-BEGIN[A-Z\\x20]+PRIVATE\\x20KEY\\-\\-\\-\\-\\-", probe="\\-\\-\\-\\-\\-BEGIN"),
    Rule("login", "://[A-Za-z0-9._%\\-]+:[A-Za-z0-9._%!$&*+=\\-]+@", probe="://[A-Za-z0-9._%\\-]"),
)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    all: Dfa
    single: list[Dfa]
    heads: list[Dfa | None]
    firsts: list[np.ndarray]  # bytes a match of the rule can begin with


def compile_rules(rules: tuple[Rule, ...] = BASE + MORE) -> Scanner:
    """The combined automaton and, for settling spans, each rule's own."""
    both = Nfa()
    start = both.state()
    single, heads = [], []
    for i, rule in enumerate(rules):
        add_pattern(both, start, rule.probe or rule.pattern, i, rule.fold)
        own = Nfa()
        add_pattern(own, own.state(), rule.pattern, 0, rule.fold)
        single.append(determinise(own, 0))
        if rule.head:
            own = Nfa()
            add_pattern(own, own.state(), rule.head, 0, rule.fold)
        heads.append(determinise(own, 0) if rule.head else None)
    firsts = [d.table[1][d.class_of] > 0 for d in single]
    return Scanner(rules, determinise(both, start, searching=True), single, heads, firsts)


def _settle(scanner: Scanner, rule: int, data: bytes, ends: list[int], resets: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of one rule in a text, given where it ends matches."""
    own, head, first = scanner.single[rule], scanner.heads[rule], scanner.firsts[rule]
    out, at = [], 0
    for end in ends:
        if end < at:
            continue
        before = int(np.searchsorted(resets, end)) - 1
        i = max(at, int(resets[before]) + 1 if before >= 0 else 0)
        while i <= end:
            if first[data[i]]:
                stop = own.longest(data, i, len(data))
                if stop > end:
                    value = head.longest(data, i, stop) if head else i
                    if stop - value >= scanner.rules[rule].least:
                        out.append((i, stop))
                    at = stop
                    break
            i += 1
    return out


def scan(scanner: Scanner, buf: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """text number -> [(start, end, rule)] in bytes, for texts with any span."""
    at, bits = accepting(scanner.all, buf, offsets)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(at):
        return out
    owner = np.searchsorted(offsets, at, "right") - 1
    reset_bytes = scanner.all.resets()
    for d in np.unique(owner):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        rows = slice(*np.searchsorted(owner, [d, d + 1]))
        ends, flags = at[rows] - lo, bits[rows]
        data, resets = buf[lo:hi].tobytes(), np.flatnonzero(reset_bytes[buf[lo:hi]])
        spans = []
        for rule in range(len(scanner.rules)):
            mine = ends[(flags >> np.uint32(rule)) & np.uint32(1) > 0]
            spans += [(a, b, rule) for a, b in _settle(scanner, rule, data, mine.tolist(), resets)]
        if spans:
            chars = np.cumsum(np.concatenate(([0], (buf[lo:hi] & 0xC0) != 0x80)))  # code points before each byte
            out[int(d)] = sorted((int(chars[a]), int(chars[b]), r) for a, b, r in spans)
            out[int(d)].sort(key=lambda s: (s[0], s[2]))
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, spans array<struct<kind, start, end>>) in code points, by start, then rule order.

    A null text is an empty text.  Every row gives a row, those without an id and those that repeat one too.
    Other columns are ignored.  The compiled tables are of fixed size, whatever the corpus.
    """
    scanner = compile_rules(rules)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.array(kinds)
        for b in batches:
            buf, offs = ta.text_bytes(b.column(1))
            for s, e in ta.slices(offs, _SLICE):
                found = scan(scanner, buf[offs[s]: offs[e]], offs[s: e + 1] - offs[s])
                sizes = np.zeros(e - s + 1, np.int32)
                for d, spans in found.items():
                    sizes[d + 1] = len(spans)
                flat = [x for d in sorted(found) for x in found[d]]
                a, z, r = (np.array(c, np.int64) for c in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
                struct = pa.StructArray.from_arrays(
                    [kind_of.take(pa.array(r)), pa.array(a), pa.array(z)], names=["kind", "start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), spans], names=["id", "spans"])

    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)


def digest(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Replace ``spans`` by n_<kind> for the base kinds, base_sha256 of the base spans, and all spans as text."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    basic = F.filter("spans", lambda s: s["kind"].isin(*base))
    keep = [c for c in spans.columns if c != "spans"]
    return spans.select(
        *keep,
        *map(count, base),
        F.sha2(joined(basic), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
