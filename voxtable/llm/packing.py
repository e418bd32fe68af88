"""Packing token pieces into sequences of fixed capacity by bin completion.

What has to be decided depends on piece lengths alone, and there are at most ``capacity`` of those however
large the corpus: the solver sees how many pieces of each length exist.  It completes bins around the longest
piece left, tries undominated fillings in order of waste, applies each as often as the counts allow, and cuts
branches by the waste that the best solution so far leaves over.  Best-fit decreasing gives the first solution.
Pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
BACKTRACKS = 400  # branches the search may try beyond its first descent
CHOICES = 4  # fillings tried per node
GROUP_ROWS = 100_000  # pieces of one length ranked in one task

Pattern = tuple[tuple[int, int], ...]  # (length, pieces) of one sequence


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts per length; bins with the same content are kept as one entry."""
    open_bins: dict[int, dict[Pattern, int]] = {0: {}}
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, pattern: Pattern, n: int) -> None:
        have = open_bins.setdefault(room, {})
        have[pattern] = have.get(pattern, 0) + n
        rooms[room] = room > 0

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                per = capacity // length
                if left >= per:
                    put(capacity - per * length, ((length, per),), left // per)
                if left % per:
                    put(capacity - (left % per) * length, ((length, left % per),), 1)
                break
            room = int(fit[0]) + length
            pattern, n = open_bins[room].popitem()
            # the fullest fitting bin takes pieces until they no longer fit
            per = min(room // length, max(1, left))
            m = min(n, left // per)
            if n > m:
                open_bins[room][pattern] = n - m
            if not open_bins[room]:
                rooms[room] = False
            put(room - per * length, (*pattern, (length, per)), m)
            left -= per * m
    return [(p, n) for by in open_bins.values() for p, n in by.items()]


def fillings(counts: np.ndarray, room: int, top: int, choices: int = CHOICES) -> list[tuple[int, ...]]:
    """Undominated sets of lengths for ``room``, least waste first; fewer and longer pieces before more and shorter.

    A piece that fills the room dominates every other filling.  Otherwise pairs and triples that fill it are
    tried, then the fullest ones that do not; each is completed downwards until nothing fits.
    """
    room_top = min(room, top)
    have = np.flatnonzero(counts[: room_top + 1])
    if not len(have):
        return [()]
    if room <= top and counts[room]:
        return [(room,)]
    found: list[tuple[int, ...]] = []

    def pairs(space: int, bound: int, taken: tuple[int, ...]) -> list[tuple[int, ...]]:
        a = have[have <= min(bound, space - 1)][::-1]
        b = space - a
        ok = (b <= a) & (b >= 1)
        a, b = a[ok], b[ok]
        left = counts[b] - (a == b) - sum((b == t).astype(int) for t in taken)
        enough = counts[a] - sum((a == t).astype(int) for t in taken)
        hit = np.flatnonzero((left > 0) & (enough > 0))[:choices]
        return [(*taken, int(a[i]), int(b[i])) for i in hit]

    found += pairs(room, room_top, ())
    if len(found) < choices:
        for first in have[::-1][:64]:
            if room - first >= 2:
                found += pairs(room - int(first), int(first), (int(first),))[:1]
            if len(found) >= choices:
                break
    if found:
        return found[:choices]

    def complete(first: int) -> tuple[int, ...]:
        out, space = [first], room - first
        used = {first: 1}
        while space > 0:
            fit = have[: np.searchsorted(have, space, "right")][::-1]
            nxt = next((int(x) for x in fit if counts[x] > used.get(int(x), 0)), 0)
            if not nxt:
                break
            out.append(nxt)
            used[nxt] = used.get(nxt, 0) + 1
            space -= nxt
        return tuple(out)

    heads = [int(x) for x in have[::-1][:64]]
    tried = sorted({complete(h) for h in heads}, key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))
    return tried[:choices]


def complete_bins(counts: np.ndarray, capacity: int, backtracks: int = BACKTRACKS) -> list[tuple[Pattern, int]]:
    """Sequences as (pattern, times) for ``counts[length]`` pieces of each length; as few as the search finds."""
    counts = counts.astype(np.int64).copy()
    total = int((counts * np.arange(capacity + 1)).sum())
    if not total:
        return []
    best = best_fit(counts, capacity)
    best_n, bound = sum(n for _, n in best), -(-total // capacity)
    path: list[list] = []  # [pattern as lengths, times, untried fillings, waste before, bins before]
    waste = bins = 0
    tries = 0
    while best_n > bound:
        longest = np.flatnonzero(counts)
        budget = (best_n - 1) * capacity - total
        options: list[tuple[int, ...]] = []
        if not len(longest):
            best, best_n = [(_pattern(p), t) for p, t, *_ in path], bins
        elif waste <= budget:
            top = int(longest[-1])
            counts[top] -= 1
            options = [(top, *f) for f in fillings(counts, capacity - top, top)]
            counts[top] += 1
        # take the next filling, or go back to a node that has one left
        while True:
            if options:
                lengths = options.pop(0)
                kinds, uses = np.unique(np.array(lengths), return_counts=True)
                loss = capacity - int(sum(lengths))
                times = int((counts[kinds] // uses).min())
                if loss and waste + loss * times > budget:
                    times = max(1, min(times, (budget - waste) // loss)) if waste + loss <= budget else 0
                if times:
                    path.append([lengths, times, options, waste, bins])
                    counts[kinds] -= uses * times
                    waste, bins = waste + loss * times, bins + times
                    break
                continue
            if not path or tries >= backtracks:
                return best
            tries += 1
            lengths, times, options, waste, bins = path.pop()
            kinds, uses = np.unique(np.array(lengths), return_counts=True)
            counts[kinds] += uses * times
    return best


def _pattern(lengths: tuple[int, ...]) -> Pattern:
    kinds, uses = np.unique(np.array(lengths), return_counts=True)
    return tuple((int(k), int(u)) for k, u in zip(kinds[::-1], uses[::-1]))


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset, pieces per sequence) in rank order."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, per in pattern:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset, per))
            ranks[length] = rank + per * times
            offset += per * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def cut_pieces(docs: DataFrame, path: str, blank_in_word: bool, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): ids of every text with the end id 0, cut only where longer than ``capacity``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    end = np.array([END_ID], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            keys = b.column(0).to_pylist()
            for at in range(0, len(keys), 500):
                for key, ids in zip(keys[at: at + 500], encoder(path, blank_in_word).ids(b.column(1).slice(at, 500).to_pylist())):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a: a + 4 * capacity]
                        out.append((key, piece, a // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return rows.mapInArrow(cut, "id long, piece long, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, path: str, blank_in_word: bool, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: (id, piece int, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is the end id alone.  Rows that repeat an id are packed one by one; rows without an id
    give no piece; an empty table gives no row.  Other columns are ignored.
    """
    pieces = materialize(cut_pieces(docs, path, blank_in_word, capacity, id_col, text_col), "pieces")
    # at most ``capacity`` rows, whatever the corpus
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sizes.items():
        counts[length] = n
    where = places(complete_bins(counts, capacity))

    # ranks within a length: rows of a common length are dealt into groups of bounded size
    deals = max(1, int(counts.max()) // GROUP_ROWS)
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "piece"), F.lit(deals)).cast("int"))
    per_deal = dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    before = per_deal.select("length", "deal", (F.sum("n").over(Window.partitionBy("length").orderBy("deal")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "deal").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                table = where[int(value)]
                row = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - row[:, 0]
                sequence[rows] = row[:, 1] + nth // row[:, 3]
                offset[rows] = row[:, 2] + nth % row[:, 3] * value
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("piece").cast(pa.int32()), b.column("start"), b.column("length"), b.column("ids_crc32"),
                 pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
