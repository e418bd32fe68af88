"""Repeated passages: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

A chunk ends where the gear hash of the last sixteen bytes falls under a threshold, so boundaries depend on
nothing but nearby bytes: a passage is cut alike wherever it stands, and an insertion moves no boundary beyond
its neighbourhood.  The first occurrence of a chunk, by (document id, place), stays.  Later occurrences are
removed where they stand in runs of some length; single short chunks may be alike by chance and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import textarrays as ta

MEAN = 32  # mean chunk in bytes
SPAN = 64  # fewest bytes a run of repeated chunks must have
_WIDTH = 16
_GEAR = np.random.default_rng(1729).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(buf: np.ndarray, offsets: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Sorted ends of all chunks; every text ends one, and none spans two texts."""
    h = np.zeros(len(buf), np.uint16)
    for k in range(min(_WIDTH, len(buf))):  # the shift drops bytes out of the hash after sixteen steps
        h[k:] += _GEAR[buf[: len(buf) - k]] << np.uint16(k)
    ends = np.flatnonzero(h < (1 << 16) // mean) + 1
    near = np.searchsorted(offsets, ends - 1, "right") - 1
    ends = ends[ends - offsets[near] >= _WIDTH]  # the hash has to lie inside the text
    return np.union1d(ends, offsets[1:][np.diff(offsets) > 0])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, offs = ta.text_bytes(b.column(1))
        ids = b.column(0).to_numpy()
        for s, e in ta.slices(offs):
            part, at = buf[offs[s]: offs[e]], offs[s: e + 1] - offs[s]
            ends = boundaries(part, at)
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            owner = np.searchsorted(at, starts, "right") - 1
            data = part.tobytes()
            digests = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(ids[s:e][owner]), pa.array(starts - at[owner]), pa.array((ends - starts).astype(np.int32))],
                names=["digest", "id", "start", "size"])


def _runs(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans: list[list[int]] = []
                for c in chunks:
                    if spans and spans[-1][1] == c["start"]:
                        spans[-1][1] += c["size"]
                        spans[-1][2].add(c["first"])
                    else:
                        spans.append([c["start"], c["start"] + c["size"], {c["first"]}])
                spans = [x for x in spans if x[1] - x[0] >= span]
                if spans:
                    out.append({"id": key, "removed": sum(z - a for a, z, _ in spans),
                                "spans": [{"start": a, "end": z} for a, z, _ in spans],
                                "first_docs": sorted(set().union(*(x[2] for x in spans)))})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return run


_OUT = pa.schema([("id", pa.int64()), ("removed", pa.int64()),
                  ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("first_docs", pa.list_(pa.int64()))])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document with repeats: (id, removed bytes, spans in UTF-8 bytes, first_docs that keep the passages).

    Null and empty texts have no chunks.  Rows without an id give no row; rows that repeat an id share
    their places, so an exact repeat of a row adds nothing.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text <> ''")
    chunks = materialize(rows.mapInArrow(_chunks, "digest binary, id long, start long, size int"), "chunks")
    # partial aggregates: a chunk that a third of the documents share is one row per task here
    firsts = materialize(
        chunks.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("digest", F.col("first.id").alias("first"), F.col("first.start").alias("first_start")), "repeats")
    later = chunks.join(firsts, "digest").filter("id <> first or start <> first_start")
    lists = later.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "size", "first"))).alias("chunks"))
    return lists.mapInArrow(
        _runs(span), "id long, removed long, spans array<struct<start: long, end: long>>, first_docs array<long>"
    ).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts; a cut inside a character takes the whole character."""
    wide = docs.join(spans.select(F.col(id_col), F.col("spans").alias("_cut")), id_col, "left")
    at, cut = wide.columns.index(text_col), wide.columns.index("_cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, c in zip(b.column(at).to_pylist(), b.column(cut).to_pylist()):
                if t and c:
                    raw, parts, last = t.encode(), [], 0
                    for x in c:
                        parts.append(raw[last: x["start"]])
                        last = x["end"]
                    t = b"".join([*parts, raw[last:]]).decode(errors="ignore")
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if i == at else x for i, x in enumerate(b.columns) if i != cut]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in b.schema.names if n != "_cut"])

    return wide.mapInArrow(run, wide.drop("_cut").schema)
