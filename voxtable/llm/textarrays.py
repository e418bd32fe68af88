"""Views of an Arrow text column as byte arrays, and whole-batch word and shingle hashing in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size, a longer text by itself

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_held: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What tasks of one operator keep in a Python worker.

    Workers outlive their stage; when a task of another operator starts in one, its predecessor's cache and tables go.
    """
    if operator not in _held:
        _held.clear()
        _powers.clear()
        give_back()
    return _held.setdefault(operator, {})


def give_back() -> None:
    """Return freed memory of this worker to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def row_slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text in column ``at``, a longer text by itself; nothing is copied."""
    for b in batches:
        _, offsets = text_bytes(b.column(at))
        for s, e in slices(offsets):
            yield b.slice(s, e - s)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
        if n > 8 * SLICE_BYTES:  # one giant text must not pin its table
            return _powers.pop(key)[:n]
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes come to about ``most``, at least one text each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n, a + 50_000)
        yield a, b
        a = b


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words ``[^\\x20\\x09-\\x0D]+``."""
    solid = ~_SPACES[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(buf) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(buf) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[buf]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span, equal for equal bytes wherever they stand."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_CODES[buf] * powers(_STEP, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_BACK, n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a text of fewer words is one shingle as a whole."""
    buf = lower(buf)
    starts, ends, owner = words(buf, offsets)
    n_docs = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    h = hash_spans(buf, starts, ends)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            acc = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                acc = acc * U(0xD6E8FEB86659FD93) + h[j: len(h) - k + 1 + j]
            acc = mix(acc)
        else:
            acc = h[:0]
        out = []
        for d in range(n_docs):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                s = np.sort(acc[a: b - k + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                x = U(int(b - a))
                for v in h[a:b]:
                    x = x * U(0xA0761D6478BD642F) + v
                out.append(mix(np.array([x], dtype=np.uint64)))
            else:
                out.append(h[:0])
    return out
