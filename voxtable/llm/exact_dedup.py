"""Exact duplicates by sorting contents.

Normalised texts are dealt by sampled splitters over (first bytes, hash of the text, id), so that one text with very
many copies is split over tasks like any other range, and what is sampled of a text is short; each task sorts its range externally, which puts equals next to each
other, and compares every text in full with its neighbour.  Runs that touch the edge of a range are joined
with the same text's runs of other ranges, again by the full text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import textarrays as ta

_ROW = "id long, text_sha256 string, run long, edge_text binary"
_ARROW = pa.schema([("id", pa.int64()), ("text_sha256", pa.string()), ("run", pa.int64()), ("edge_text", pa.binary())])


def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, body): the UTF-8 bytes with A-Z in lower case; null counts as empty."""
    ta.worker_cache("exact_dedup")
    for b in ta.row_slices(batches, 1):
        raw, offsets = ta.text_bytes(b.column(1))
        body = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ta.lower(raw))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), body], names=["id", "body"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in a sorted range; the first row of its first and last run carries the text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 40
    run, digest, open_text, ids, started = -1, "", None, [], False

    def close(text):
        nonlocal ids
        n, out = len(ids), ids
        ids = []
        return pa.RecordBatch.from_arrays(
            [pa.array(out, pa.int64()), pa.array([digest] * n), pa.array([part + run] * n, pa.int64()),
             pa.array([text] + [None] * (n - 1), pa.binary())], schema=_ARROW)

    done: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_pylist()
        for key, text in zip(keys, b.column(1)):
            text = text.as_py()
            if not started or text != open_text:
                if started:
                    done.append(close(open_text if run == 0 else None))
                run, open_text, started = run + 1, text, True
                digest = hashlib.sha256(text).hexdigest()
            ids.append(key)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if started:
        yield close(open_text)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after lower-casing A-Z; the largest id of a group stays.  A null
    text is an empty text, and all empty texts are equal.  Rows without an id cannot be named and give no row;
    rows that repeat an id count as copies and share its decision.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    bodies = rows.mapInArrow(normalise, "id long, body binary")
    # ranges are cut by the first bytes and a hash, so samples of splitters stay small; equal bodies agree in both
    order = [F.substring("body", 1, 32), F.xxhash64("body")]
    dealt = bodies.repartitionByRange(*order, "id").sortWithinPartitions(*order, "body", "id")
    runs = materialize(dealt.mapInArrow(_runs, _ROW), "content-runs")

    per_run = runs.groupBy("run").agg(
        F.max("id").alias("top"), F.count(F.lit(1)).alias("n"), F.max("edge_text").alias("edge_text"))
    whole = per_run.filter("edge_text is null").select("run", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    edges = per_run.filter("edge_text is not null")
    joined = edges.groupBy("edge_text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    across = edges.select("run", "edge_text").join(joined, "edge_text").select("run", "keep_id", "group_size")
    sizes = materialize(whole.unionByName(across).filter("group_size > 1"), "content-groups")
    out = runs.select("id", "text_sha256", "run").join(sizes, "run", "left")
    keep = F.coalesce("keep_id", "id")
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id") == keep).alias("kept"), "text_sha256")
