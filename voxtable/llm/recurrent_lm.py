"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Words live in the cells of a fixed K x K grid of classes and places: the end mark and the most frequent words own a
cell, all others share the remaining cells by hash.  The network gives P(class) P(place | class); within a shared cell
each word has its share of the cell's count, less an absolute discount that is left to words that no training
text holds.  So every counted word has its own probability, all of them sum to 1, and the network does not grow with
the vocabulary.  Counts of shared words come to the texts by a join, so no task and no driver holds a word list.

Texts run side by side in lanes, one after another in each lane, with the state set back where a text begins.  Tasks
train from common weights on their share of the texts, and the weights are averaged.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import textarrays as ta

HIDDEN = 16
SIDE = 64  # classes, and places of a class
OWNED = 48 * SIDE  # cells of one word: the end mark and the most frequent words
CELLS = SIDE * SIDE
WINDOW, LANES = 32, 256  # words per truncated step, and texts side by side
STRETCH = 64  # words between two looks at the outputs when texts are only scored
BLOCK = 1_024  # rows whose outputs are worked out together, so that they stay in the cache
CARRIED = (1 << 16) - 1  # most frequent words whose counts go to the tasks; the others' counts come by a join
CHUNK = 6 << 20  # bytes of text that are dealt to lanes together
LONG = 4_096  # longer texts wait for each other, so that they run side by side too; so many words are a training segment
POOL = 1_500_000  # words of waiting texts
RATE = 0.01
END = 0  # the cell of the end mark
SHAPES = {
    "e": (CELLS, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "oc": (HIDDEN, SIDE), "bc": (SIDE,), "op": (SIDE, HIDDEN, SIDE), "bp": (SIDE, SIDE),
}


def pack_weights(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unpack_weights(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at: at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def first_weights(mass: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the biases are log frequencies of the cells, so that the untrained model is the unigram."""
    rng = np.random.default_rng(7)
    grid = (mass / mass.sum()).reshape(SIDE, SIDE)
    w = {k: (rng.standard_normal(s) * (0.02 if k in ("oc", "op") else 0.2)).astype(np.float32) for k, s in SHAPES.items()}
    w["b"][:] = 0
    w["bc"] = np.log(grid.sum(1)).astype(np.float32)
    w["bp"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
    return w


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their sum per row, log softmax at one place of each row); ``x`` is used up."""
    if x.max() > 60:
        x -= x.max(axis=1, keepdims=True)
    got = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return x, total, got - np.log(total)


def _run(w: dict, inputs: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each step for inputs (steps, lanes); the state is 0 where a text starts."""
    table = w["e"] @ w["wx"] + w["b"] if inputs.size >= CELLS else None
    states, trace = np.empty((*inputs.shape, HIDDEN), np.float32), []
    fresh = starts.any(axis=1)
    for t, ids in enumerate(inputs):
        if fresh[t]:
            h = np.where(starts[t][:, None], np.float32(0), h)
        x, u = table[ids] if table is not None else w["e"][ids] @ w["wx"] + w["b"], h @ w["wh"]
        zr = np.tanh(0.5 * (x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])) * np.float32(0.5) + np.float32(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
        if keep:
            trace.append((h, z, r, n, u[:, 2 * HIDDEN:]))
        states[t] = h = n + z * (h - n)
    return states, trace


def _outputs(w: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target cell given its state; with ``grads`` also the loss gradient of the states."""
    order = np.argsort(targets, kind="stable")
    s, (kinds, places) = states[order], np.divmod(targets[order], SIDE)
    got, back = np.empty(len(s), s.dtype), None if grads is None else np.empty_like(s)
    for a in range(0, len(s), BLOCK):
        part = slice(a, a + BLOCK)
        e, total, got[part] = _softmax(s[part] @ w["oc"] + w["bc"], kinds[part])
        if grads is not None:
            e /= total[:, None]
            e[np.arange(len(e)), kinds[part]] -= 1
            grads["oc"] += s[part].T @ e
            grads["bc"] += e.sum(0)
            back[part] = e @ w["oc"].T
    cuts = np.searchsorted(kinds, np.arange(SIDE + 1))
    for k in np.flatnonzero(np.diff(cuts)):  # tokens of one class at a time
        part = slice(cuts[k], cuts[k + 1])
        e, total, more = _softmax(s[part] @ w["op"][k] + w["bp"][k], places[part])
        got[part] += more
        if grads is not None:
            e /= total[:, None]
            e[np.arange(len(e)), places[part]] -= 1
            grads["op"][k] = s[part].T @ e
            grads["bp"][k] = e.sum(0)
            back[part] += e @ w["op"][k].T
    out = np.empty(len(targets), np.float32)
    out[order] = got
    if back is not None:
        into = np.empty_like(back)
        into[order] = back
        back = into
    return out, back


@dataclass
class Lanes:
    """Texts dealt to lanes, longest lane first.  Behind a lane's end the cell is -1."""

    cells: np.ndarray  # (steps, lanes)
    owner: np.ndarray  # text number of each cell
    starts: np.ndarray  # whether a text starts there

    def windows(self, size: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(inputs, targets, starts, owner) window by window, of the lanes still open."""
        before = np.vstack((np.full((1, self.cells.shape[1]), END, np.int32), self.cells[:-1]))
        before[self.starts] = END
        for t in range(0, len(self.cells), size):
            live = int((self.cells[t] >= 0).sum())
            part = (slice(t, t + size), slice(0, live))
            yield np.maximum(before[part], END), self.cells[part], self.starts[part], self.owner[part]


def deal(texts: list[np.ndarray], lanes: int = LANES) -> Lanes:
    """Longest texts first, each to the lane that is shortest so far."""
    heap = [(0, k) for k in range(min(lanes, len(texts)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        load, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (load + len(texts[i]), k))
    load = {k: n for n, k in heap}
    order = sorted(range(len(held)), key=lambda k: -load[k])
    shape = (load[order[0]], len(order))
    out = Lanes(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool))
    for j, k in enumerate(order):
        at = 0
        for i in held[k]:
            n = len(texts[i])
            out.cells[at: at + n, j], out.owner[at: at + n, j], out.starts[at, j] = texts[i], i, True
            at += n
    return out


def log_likelihood(w: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of the cells of each whole text; the state runs from a text's start to its end."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    lanes = deal(texts)
    h = np.zeros((lanes.cells.shape[1], HIDDEN), np.float32)
    for inputs, targets, starts, owner in lanes.windows(STRETCH):
        states, _ = _run(w, inputs, starts, h[: inputs.shape[1]], False)
        h = states[-1]
        real = targets >= 0
        got, _ = _outputs(w, states[real], targets[real])
        total += np.bincount(owner[real], got, len(texts))
    return total


def gradients(w: dict, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, int]:
    """Gradients of the summed negative log probability in one window, the last state, and the number of targets."""
    g = {k: np.zeros_like(v) for k, v in w.items()}
    states, trace = _run(w, inputs, starts, h, True)
    real = targets >= 0
    _, back = _outputs(w, states[real], targets[real], g)
    into = np.zeros_like(states)
    into[real] = back
    dx = np.empty((*inputs.shape, 3 * HIDDEN), states.dtype)
    du, olds = np.empty_like(dx), np.empty_like(states)
    dh, wh = np.zeros_like(h), np.ascontiguousarray(w["wh"].T)
    for t in range(len(inputs) - 1, -1, -1):
        old, z, r, n, un = trace[t]
        dh = dh + into[t]
        dn = dh * (1 - z) * (1 - n * n)
        dx[t, :, :HIDDEN] = dh * (old - n) * z * (1 - z)
        dx[t, :, HIDDEN: 2 * HIDDEN] = dn * un * r * (1 - r)
        dx[t, :, 2 * HIDDEN:] = dn
        du[t, :, : 2 * HIDDEN] = dx[t, :, : 2 * HIDDEN]
        du[t, :, 2 * HIDDEN:] = dn * r
        olds[t] = old
        dh = dh * z + du[t] @ wh
        if starts[t].any():
            dh = np.where(starts[t][:, None], np.float32(0), dh)
    flat, ids = dx.reshape(-1, 3 * HIDDEN), inputs.ravel()
    g["wh"] = olds.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    g["b"] = flat.sum(0)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    touched = ids[order][first]
    sums = np.add.reduceat(flat[order], first)  # one row per cell that the window reads
    g["wx"] = w["e"][touched].T @ sums
    g["e"][touched] = sums @ w["wx"].T
    return g, states[-1], int(real.sum())


def train(w: dict, batches: Iterator[list[np.ndarray]], rate: float = RATE) -> tuple[dict, int]:
    """Truncated backpropagation with Adam over texts; (weights, words seen).  Few texts take fewer lanes, so more steps."""
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    seen, step = 0, 0
    for texts in batches:
        lanes = deal(texts, min(LANES, max(8, sum(map(len, texts)) // (100 * WINDOW))))
        h = np.zeros((lanes.cells.shape[1], HIDDEN), np.float32)
        for inputs, targets, starts, _ in lanes.windows():
            g, h, n = gradients(w, inputs, targets, starts, h[: inputs.shape[1]])
            seen, step = seen + n, step + 1
            scale = np.float32(1 / max(n, 1))
            speed = np.float32(rate / (1 - 0.9 ** step) * min(1.0, n / (WINDOW * 16)))  # few words move little
            level = np.float32(1 / (1 - 0.99 ** step))
            for k in w:
                d = g[k] * scale
                m[k] += np.float32(0.1) * (d - m[k])
                v[k] += np.float32(0.01) * (d * d - v[k])
                w[k] -= speed * m[k] / (np.sqrt(v[k] * level) + np.float32(1e-6))
    return w, seen


@dataclass
class Vocabulary:
    """What tasks need to know of the words; its size does not depend on the vocabulary."""

    tokens: int
    kinds: int
    heads: np.ndarray  # sorted hashes of the most frequent words
    cell_of_head: np.ndarray
    count_of_head: np.ndarray
    share_of_head: np.ndarray  # log10 of the word's part of its cell
    ends: int
    mass: np.ndarray  # tokens per cell

    def cells(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, place among ``heads``) of words; -1 for a word that is not carried."""
        if not len(self.heads):
            return shared_cell(hashes), np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1).astype(np.int32)
        own = self.heads[at] == hashes
        return np.where(own, self.cell_of_head[at], shared_cell(hashes)).astype(np.int32), np.where(own, at, np.int32(-1))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def shared_cell(hashes: np.ndarray) -> np.ndarray:
    return (OWNED + (hashes % np.uint64(CELLS - OWNED)).astype(np.int64)).astype(np.int32)


def hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text behind the last, word hashes, first word of each text and the number of all) slice by slice.

    Words are told apart by 64-bit hashes of their lower-cased bytes.
    """
    buf, offsets = ta.text_bytes(column)
    for a, b in ta.slices(offsets):
        low = ta.lower(buf[offsets[a]: offsets[b]])
        starts, ends, owner = ta.words(low, offsets[a: b + 1] - offsets[a])
        with np.errstate(over="ignore"):
            h = ta.hash_spans(low, starts, ends)
        yield a, b, h, np.searchsorted(owner, np.arange(b - a + 1))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    key, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(c[order], first) if len(first) else c


def count_words(rows: DataFrame, held: int = 1_000_000) -> DataFrame:
    """(word, c) over all texts, words as hashes; a task adds up before the shuffle and holds about ``held`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, c = _added(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], names=["word", "c"])

        for b in batches:
            for _, _, h, _ in hashed(b.column(0)):
                parts.append(_added([(h, np.ones(len(h), np.int64))]))
                if sum(len(p[0]) for p in parts) > 2 * held:
                    parts[:] = [_added(parts)]
                    if len(parts[0][0]) > held:
                        yield flush()
        if parts:
            yield flush()

    return rows.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _cell(word: Column) -> Column:
    """``shared_cell`` of a hash that is held as a signed long; the number of shared cells is a power of two."""
    return (F.lit(OWNED) + word.bitwiseAND(F.lit(CELLS - OWNED - 1))).cast("int")


def learn_vocabulary(counts: DataFrame, ends: int) -> tuple[Vocabulary, DataFrame, dict[int, float]]:
    """The vocabulary, (word, c, share) of the words it does not carry, and each shared cell's spare part; parts as log10.

    The spare part is what the discount leaves to words not counted.  The driver gets the words that are carried and
    one row per shared cell.
    """
    top = counts.orderBy(F.desc("c"), "word").limit(CARRIED).toArrow()
    heads, c = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    names = counts.sparkSession.createDataFrame(top.select(["word"])) if top.num_rows else counts.select("word").limit(0)
    # a cell's own word is left out of the shared cells; the carried words beyond those are in them
    own = counts.sparkSession.createDataFrame(top.select(["word"]).slice(0, OWNED - 1)) if top.num_rows else names
    cells = materialize(counts.join(own, "word", "left_anti").groupBy(_cell(F.col("word")).alias("cell")).agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"),
        F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum((F.col("c") == 2).cast("long")).alias("twice")), "word-cells")
    table = cells.toArrow()
    at, total, types, once, twice = (table[k].to_numpy() for k in ("cell", "total", "types", "once", "twice"))
    off = float(np.clip(once.sum() / max(once.sum() + 2 * twice.sum(), 1), 0.1, 0.9))
    mass = np.full(CELLS, 1e-3)
    mass[END] = max(ends, 1e-3)
    mass[1: 1 + min(len(c), OWNED - 1)] = c[: OWNED - 1]
    mass[OWNED:] = 0.5  # for words not counted
    mass[at] += total
    cell = np.where(np.arange(len(c)) < OWNED - 1, np.arange(1, len(c) + 1), shared_cell(heads)).astype(np.int32)
    share = np.where(cell < OWNED, 0.0, np.log10((c - off) / mass[cell]))
    order = np.argsort(heads)
    v = Vocabulary(int(c[: OWNED - 1].sum() + total.sum()) + ends, min(len(c), OWNED - 1) + int(types.sum()) + (ends > 0),
                   heads[order], cell[order], c[order], share[order], ends, mass)
    rest = counts.join(names, "word", "left_anti").withColumn("cell", _cell(F.col("word"))).join(cells, "cell")
    known = rest.select("word", "c", F.log10((F.col("c") - off) / (F.col("total") + 0.5)).alias("share"))
    return v, known, {int(k): float(np.log10((off * n + 0.5) / (t + 0.5))) for k, n, t in zip(at, types, total)}


def _texts(vocabulary: Vocabulary, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cells with the end mark, places among the carried words, hashes) of each text of a slice."""
    cells, places = vocabulary.cells(h)
    for a, b in zip(first[:-1], first[1:]):
        yield np.append(cells[a:b], np.int32(END)), places[a:b], h[a:b]


def learn_network(rows: DataFrame, vocabulary: Vocabulary, rounds: int = 1) -> dict:
    """Weights after training on all rows and averaging over tasks; the average is one row per weight."""
    weights = first_weights(vocabulary.mass)
    for _ in range(rounds):
        begin = pack_weights(weights)

        def work(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            def texts():
                held, n = [], 0
                for b in batches:
                    for _, _, h, first in hashed(b.column(0)):
                        for cells, _, _ in _texts(vocabulary, h, first):
                            held += [cells[a: a + LONG] for a in range(0, len(cells), LONG)]
                        n += len(h)
                        if n > POOL:
                            yield held
                            held, n = [], 0
                if held:
                    yield held

            w, seen = train(unpack_weights(begin), texts())
            if seen:
                flat = pack_weights(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), seen))],
                    names=["at", "value", "seen"])

        mean = rows.select("text").mapInArrow(work, "at int, value double, seen long").groupBy("at").agg(
            (F.sum("value") / F.sum("seen")).alias("value")).toArrow()
        if not mean.num_rows:
            break
        flat = np.empty(len(begin))
        flat[mean["at"].to_numpy()] = mean["value"].to_numpy()
        weights = unpack_weights(flat)
    return weights


def _scored(vocabulary: Vocabulary, weights: np.ndarray) -> Callable:
    """(key, text) -> what the network and the words with own cells give, and the other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = unpack_weights(weights)

        base, share = vocabulary.base(vocabulary.count_of_head), vocabulary.share_of_head
        end = float(vocabulary.base(np.array([vocabulary.ends]))[0])

        def rows_of(texts):
            keys, cells, places, hashes = zip(*texts)
            net = log_likelihood(w, list(cells)) / np.log(10)
            carried = [p[p >= 0] for p in places]
            tails = [_added([(h[p < 0], np.ones(int((p < 0).sum()), np.int64))]) for p, h in zip(places, hashes)]
            at = np.concatenate(([0], np.cumsum([len(t[0]) for t in tails]))).astype(np.int32)
            words, times = (np.concatenate([t[i] for t in tails]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([len(c) for c in cells], pa.int64()),
                pa.array([len(p) + (vocabulary.ends > 0) for p in carried], pa.int64()),
                pa.array([float(base[p].sum()) + end for p in carried], pa.float64()),
                pa.array(net + [float(share[p].sum()) for p in carried]),
                pa.ListArray.from_arrays(pa.array(at), pa.array(words.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32))),
            ], names=["key", "n_tokens", "n_carried", "base", "net", "words", "times"])

        long, held = [], 0
        for b in batches:
            keys, now, size = b.column(0).to_numpy(), [], 0
            for a, _, h, first in hashed(b.column(1)):
                for key, (cells, places, words) in zip(keys[a:], _texts(vocabulary, h, first)):
                    if len(cells) > LONG:
                        long.append((key, cells, places.copy(), words.copy()))
                        held += len(cells)
                    else:
                        now.append((key, cells, places, words))
                        size += len(cells)
                if size * 6 > CHUNK:
                    yield rows_of(now)
                    now, size = [], 0
                if held > POOL:
                    yield rows_of(long)
                    long, held = [], 0
            if now:
                yield rows_of(now)
        if long:
            yield rows_of(long)

    return run


def score_texts(docs: DataFrame, learning: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_tokens, n_known, train_tokens, base_score, score), log10 over whole texts.

    ``learning`` holds the training rows.  A null or empty text is the end mark alone.  Rows that repeat an id
    are scored one by one; rows without an id give no row.  Without training rows all counts are 0 and the
    model is the untrained one.  Other columns are ignored.
    """
    texts = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    training = texts(learning)
    counts = materialize(count_words(training), "word-counts")
    vocabulary, known, spare = learn_vocabulary(counts, training.count())
    weights = pack_weights(learn_network(training, vocabulary))

    rows = texts(docs).withColumn("key", F.monotonically_increasing_id())  # written below, so it cannot change
    scored = materialize(rows.select("id", "key", "text").mapInArrow(
        _with_id(_scored(vocabulary, weights)), "id long, key long, n_tokens long, n_carried long, base double, net double, words array<long>, times array<int>"),
        "scored-texts")
    # carried words are the frequent ones, so no word here has more than one token in CARRIED, and no key is hot
    words = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "key", F.col("x.words").alias("word"), F.col("x.times").alias("times"), _cell(F.col("x.words")).alias("cell"))
    table = counts.sparkSession.createDataFrame(list(spare.items()) or [(-1, 0.0)], "cell int, spare double")
    base = lambda c: F.log10((c + 0.5) / (vocabulary.tokens + 0.5 * (vocabulary.kinds + 1)))
    each = words.join(known, "word", "left").join(table, "cell", "left").select(
        "key", "times", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("share", "spare", F.lit(0.0)).alias("share"))
    sums = each.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n"), F.sum(F.col("times") * base(F.col("c"))).alias("b"),
        F.sum(F.col("times") * F.col("share")).alias("s"))
    zero = F.lit(0)
    return scored.drop("words", "times").join(sums, "key", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_carried") + F.coalesce("n", zero)).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("net") + F.coalesce("s", zero)).alias("score"))


def _with_id(run: Callable) -> Callable:
    """Ids come back by the keys of the rows, for long texts are given out late."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, int] = {}

        def texts():
            for b in batches:
                ids.update(zip(b.column(1).to_pylist(), b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays(b.columns[1:], names=["key", "text"])

        for out in run(texts()):
            got = pa.array([ids.pop(k) for k in out.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([got, *out.columns], names=["id", *out.schema.names])

    return both
