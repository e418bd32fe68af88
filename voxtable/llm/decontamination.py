"""Benchmark passages in documents, by greedy string tiling.

Runs of five words that an item and a document share are the seeds.  For each (document, item) with a seed the
longest common runs of unmarked words are marked, then the next shorter ones, down to five words; windows are
compared by a rolling hash.  An item counts as leaked into a document when the marked tiles cover half of its
words, in whatever order they stand.

Items come in blocks of a bounded number of words; each block goes to the tasks whole and meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta

LEAST = 5  # words of a seed and of the shortest tile
COVER = 0.5  # part of an item's words that tiles must cover
BLOCK_WORDS = 1_000_000
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.full(256, 0x20, np.uint8)  # letters and digits as they are in lower case, UTF-8 beyond ASCII too; else a blank
for _r in (range(48, 58), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = list(_r)
_WORD[65:91] = np.arange(97, 123)


def word_codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text): words are runs of letters and digits, A-Z lower-cased."""
    buf = _WORD[buf]
    starts, ends, owner = ta.words(buf, offsets)
    return ta.hash_spans(buf, starts, ends), np.searchsorted(owner, np.arange(len(offsets)))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every run of ``size`` codes."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * ta.powers(_BASE, n), out=total[1:])
    return ta.mix((total[size:] - total[:-size]) * ta.powers(_BACK, n)[: n - size + 1])


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` free places."""
    total = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(total[size:] - total[:-size] == size) if len(free) >= size else np.zeros(0, np.int64)


def tile(text: np.ndarray, item: np.ndarray, free: np.ndarray | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, words): longest first, none overlapping another on either side."""
    free = np.ones(len(text), bool) if free is None else free.copy()
    left = np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = _open(free, size), _open(left, size)
        ha, hb = windows(text, size)[a], windows(item, size)[b]
        here = np.isin(ha, hb)
        return a[here], ha[here], b, hb

    high = min(len(text), len(item))
    while high >= least:
        low, top = least - 1, high  # the longest size with a common open run; a longer run holds all shorter ones
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if len(common(mid)[0]) else (low, mid - 1)
        size = low
        if size < least:
            break
        a, ha, b, hb = common(size)
        order = np.lexsort((a, ha))
        a, ha = a[order], ha[order]
        for start, code in zip(b.tolist(), hb):
            if not left[start: start + size].all():
                continue
            for place in a[np.searchsorted(ha, code, "left"): np.searchsorted(ha, code, "right")].tolist():
                if free[place: place + size].all() and (text[place: place + size] == item[start: start + size]).all():
                    free[place: place + size] = False
                    left[start: start + size] = False
                    out.append((place, start, size))
                    break
        # runs of this size that are still open overlap what was marked, or stand only where hashes agreed by chance
        high = size - 1 if not len(common(size)[0]) else size
        if high == size and (not out or out[-1][2] != size):
            high = size - 1
        elif high == size and len(b) == 0:
            high = size - 1
    return out


class ItemBlock:
    """Some items with the index of their seeds."""

    def __init__(self, keys: list[int], texts: list[str], least: int = LEAST):
        buf, offs = ta.text_bytes(pa.array(texts, pa.string()))
        with np.errstate(over="ignore"):
            self.codes, self.first = word_codes(buf, offs)
            self.keys = np.array(keys, np.int64)
            seeds, owners = [], []
            for i in range(len(keys)):
                own = np.unique(windows(self.codes[self.first[i]: self.first[i + 1]], least))
                seeds.append(own)
                owners.append(np.full(len(own), i))
        flat, owner = np.concatenate(seeds or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]

    def item(self, i: int) -> np.ndarray:
        return self.codes[self.first[i]: self.first[i + 1]]


def leaks_in(block: ItemBlock, codes: np.ndarray, least: int = LEAST, cover: float = COVER) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(item, covered words, words of the item, tiles) of the items that leaked into one text."""
    seeds = windows(codes, least)
    if not len(seeds) or not len(block.seeds):
        return []
    at = np.flatnonzero(block.seeds[np.minimum(np.searchsorted(block.seeds, seeds), len(block.seeds) - 1)] == seeds)
    if not len(at):
        return []
    low, high = np.searchsorted(block.seeds, seeds[at], "left"), np.searchsorted(block.seeds, seeds[at], "right")
    places: dict[int, list[int]] = {}
    for p, lo, hi in zip(at.tolist(), low.tolist(), high.tolist()):
        for i in block.owner[lo:hi].tolist():
            places.setdefault(i, []).append(p)
    out = []
    for i, starts in places.items():
        item = block.item(i)
        # only words inside a seed can be in a tile: keep those, one closed place between separate stretches
        keep = np.unique((np.array(starts)[:, None] + np.arange(least)).ravel())
        if (np.isin(item, codes[keep]).sum()) < cover * len(item):
            continue
        gap = np.flatnonzero(np.diff(keep) > 1) + 1
        text, free = np.insert(codes[keep], gap, U(0)), np.insert(np.ones(len(keep), bool), gap, False)
        where = np.insert(keep, gap, -1)
        tiles = [(int(where[a]), b, n) for a, b, n in tile(text, item, free, least)]
        covered = sum(n for _, _, n in tiles)
        if covered >= cover * len(item):
            out.append((int(block.keys[i]), covered, len(item), sorted(tiles)))
    return out


_ROW = "doc_id long, item_id long, covered long, item_words long, tiles array<struct<text: long, item: long, words: long>>"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", least: int = LEAST, cover: float = COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per (document, item) where the item leaked: (doc_id, item_id, covered, item_words, tiles).

    ``tiles`` gives word positions in text and item.  Items of fewer than ``least`` words, null or empty, match
    nothing, as do null and empty texts.  Rows without an id give no row; repeated rows give repeated results.
    Without items the result is empty.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter(
        "item is not null and text is not null").distinct()
    total = wanted.agg(F.sum(F.size(F.split("text", r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    blocks = -(-total // block_words)
    out = spark.createDataFrame([], _ROW)
    for k in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # one block at a time
        block = ItemBlock([r["item"] for r in part], [r["text"] for r in part], least)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                buf, offs = ta.text_bytes(b.column(1))
                ids = b.column(0).to_pylist()
                for s, e in ta.slices(offs):
                    codes, first = word_codes(buf[offs[s]: offs[e]], offs[s: e + 1] - offs[s])
                    found = []
                    for d in range(e - s):
                        for item, covered, words, tiles in leaks_in(block, codes[first[d]: first[d + 1]], least, cover):
                            found.append({"doc_id": ids[s + d], "item_id": item, "covered": covered, "item_words": words, "tiles": [
                                {"text": a, "item": i, "words": n} for a, i, n in tiles]})
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema=_SCHEMA)

        out = out.unionByName(rows.mapInArrow(run, _ROW))
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()),
                     ("tiles", pa.list_(pa.struct([("text", pa.int64()), ("item", pa.int64()), ("words", pa.int64())])))])
