"""Text quality by regularised quadratic discriminant analysis over statistics of whole documents.

Counts of a text's bytes and words are turned into shares and put on scales on which a class is roughly normal.
Each class has its own mean and covariance; the covariance is shrunk towards the pooled one and towards its own
diagonal scale.  A score is the odds of the two normal densities: Mahalanobis distances by Cholesky factors, which are
computed once and sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import textarrays as ta

CUT = 0.3
TO_POOLED, TO_SCALE = 0.1, 0.05  # shares of the pooled covariance, and of its diagonal, in a class covariance
FLOOR = 1e-4  # least variance of a feature, added to every diagonal
FEATURES = ("words", "word_length", "letters", "capitals", "digits", "marks", "symbols", "beyond_ascii", "bare_marks",
            "marked_words", "sentence_ends", "doubled_words", "distinct_words", "distinct_pairs", "lines")

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _HIGH = 1, 2, 3, 4, 5, 6
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SYMBOL
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = _MARK
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = _DIGIT, _UPPER, _LOWER, _HIGH
_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])
U = np.uint64


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set places in each text."""
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per owner."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on the scale where its variance does not depend on it; 0 of 0 is 0."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def _features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kind = _KIND[buf]
    upper, lower, digit, mark, symbol, high = (_per_text(kind == k, offsets) for k in range(1, 7))
    solid = upper + lower + digit + mark + symbol + high
    starts, ends, owner = ta.words(buf, offsets)
    n_words = np.bincount(owner, minlength=n).astype(float)
    letter = np.concatenate(([0], np.cumsum((kind == _UPPER) | (kind == _LOWER) | (kind == _DIGIT) | (kind == _HIGH))))
    odd = np.concatenate(([0], np.cumsum(kind == _SYMBOL)))
    bare = letter[ends] == letter[starts]
    marked = ~bare & (odd[ends] > odd[starts])
    count = lambda hit: np.bincount(owner[hit], minlength=n).astype(float)
    with np.errstate(over="ignore"):
        h = ta.hash_spans(ta.lower(buf), starts, ends)
        pair = ta.mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else h[:0]
    inside = owner[1:] == owner[:-1]
    doubled = np.concatenate(([False], (h[1:] == h[:-1]) & inside)) if len(h) else np.zeros(0, bool)
    pairs = np.maximum(n_words - 1, 0)
    return np.column_stack((
        np.log1p(n_words), np.log1p(solid / np.maximum(n_words, 1)), _share(upper + lower + high, solid),
        _share(upper, upper + lower), _share(digit, solid), _share(mark, solid), _share(symbol, solid), _share(high, solid),
        _share(count(bare), n_words), _share(count(marked), n_words), _share(count(_END[buf[ends - 1]]), n_words),
        _share(count(doubled), pairs),
        # words recur more in longer texts, so their number is held against the length on a logarithmic scale
        np.log1p(_distinct(owner, h, n)) / np.log1p(np.maximum(n_words, 1)),
        np.log1p(_distinct(owner[1:][inside], pair[inside], n)) / np.log1p(np.maximum(pairs, 1)),
        _share(_per_text(buf == 10, offsets), n_words + 1),
    ))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES per text; null reads as empty, and a text without words has the same finite values."""
    buf, offsets = ta.text_bytes(column)
    out = [np.zeros((0, len(FEATURES)))]
    for a, b in ta.slices(offsets):
        out.append(_features(buf[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]))
    return np.vstack(out)


@dataclass
class Discriminant:
    """Per class (0, 1): log prior, mean, Cholesky factor of the covariance and half its log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    half_log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)  # of a triangular factor
            density.append(self.prior[k] - self.half_log_det[k] - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``measured`` (statistics in the order of FEATURES) and ``text_hash``.

    Texts are read once here; learning and scoring work on these short rows.  Null reads as empty.
    """
    kept = [c for c in docs.columns if c not in (text_col, "measured", "text_hash")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, F.sha2(text, 256).alias("text_hash"), text.alias("measured"))
    schema = rows.withColumn("measured", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        for b in batches:
            x = statistics(b.column(b.num_columns - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * len(x) + 1, d), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=b.schema.names)

    return materialize(rows.mapInArrow(run, schema), "text-statistics")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(labelled: DataFrame, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of products of the centred statistics per class; each task sends one table per class."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            x, y = _rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(int)
            x = np.column_stack((np.ones(len(x)), x - centre[y]))
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        k, i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(v.ravel(), pa.int32()) for v in (k, i, j)], pa.array(total.ravel())], names=["k", "i", "j", "v"])

    total = np.zeros((2, d + 1, d + 1))
    for r in labelled.mapInArrow(run, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["k"], r["i"], r["j"]] = r["v"]
    return total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:]


def discriminant(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> Discriminant:
    """From counts, means and centred sums of products per class; a class without rows takes the other's values."""
    d = mean.shape[1]
    mean = mean.copy()
    for k in (0, 1):
        if not n[k]:
            mean[k] = mean[1 - k]
    pooled = scatter.sum(axis=0) / max(n.sum(), 1)
    factor, half = [], []
    for k in (0, 1):
        own = scatter[k] / n[k] if n[k] else pooled
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_SCALE) * cov + TO_SCALE * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        factor.append(np.linalg.cholesky(cov))
        half.append(np.log(np.diag(factor[-1])).sum())
    prior = np.log((n + 0.5) / (n.sum() + 1))
    return Discriminant(prior, mean, np.array(factor), np.array(half))


def learn(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Discriminant from all labelled rows; without any, even odds for every text.

    Null labels and ids are left out; an id with several labels counts as 1 when any is; copies of a text count once
    per label, so a group of copies has no weight of its own.
    """
    ids = (
        labels.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("int") > 0).cast("int").alias("label"))
        .filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    )
    labelled = (
        measured.select(F.col(id_col).cast("long").alias("id"), "text_hash", "measured").join(ids, "id")
        .groupBy("text_hash", "label").agg(F.first("measured").alias("measured")).select("measured", "label")
    )
    d = len(FEATURES)
    n, sums, _ = _moments(labelled, np.zeros((2, d)))
    mean = sums / np.maximum(n, 1)[:, None]
    _, _, scatter = _moments(labelled, mean)
    return discriminant(n, mean, scatter)


def score_quality(measured: DataFrame, model: Discriminant, out: str = "score") -> DataFrame:
    """Rows of ``measure`` with a column ``out``: 0 to 1, higher when the text is likelier of quality.

    Null and empty texts are scored by the statistics of an empty text.  Rows that repeat are scored alike; an input
    column of the name ``out`` is replaced.
    """
    rows = measured.select(*[c for c in measured.columns if c not in (out, "measured", "text_hash")], F.col("measured").alias(out))
    schema = rows.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(_rows(b.columns[-1])))], names=b.schema.names)

    return rows.mapInArrow(run, schema)
