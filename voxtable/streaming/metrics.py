"""Streaming: metric logs, early-stop monitor and incremental calibration history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sweeps import recommend_all
from ..sources.metric_log import parse_lines

EPOCH_HEAD = r"Epoch (\d+) Summary:"  # fixed value
SCORE_LINE = r"Full-brain Dice:\s*([\d.]+)\s*\[MODEL SELECTION\]"  # fixed value

MONITOR = "run_id string, n_checkpoints long, best_value double, best_epoch int, checkpoints_since_best long, exceeded boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["run_id", "n_checkpoints", "best_value", "best_epoch", "checkpoints_since_best", "exceeded"]
CHUNK = 1 << 20  # lines of a run that are gathered before their blocks are changed
SUMMARY = "head int, n0 long, v0 double, e0 int, s0 long, n1 long, v1 double, e1 int, s1 long"


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files appended under ``path`` as they arrive; each line starts with its number and a tab."""
    t = spark.readStream.text(path).select(F.input_file_name().alias("_f"), "value")
    return t.select(
        F.regexp_extract("_f", r"([^/]+?)(?:\.\d+)?\.log$", 1).alias("run_id"),
        F.split("value", "\t", 2)[0].cast("long").alias("seq"),
        F.split("value", "\t", 2)[1].alias("line"),
    )


def stream_metrics(lines: DataFrame, fmt: str = "one_line") -> DataFrame:
    """(run_id, seq, epoch, value) for the one-line format; tagged heads and scores for the two-line one.

    A two-line record may be split over micro-batches, so its join of head and
    score is left to ``monitor``, whose state remembers the last head.
    """
    if fmt == "one_line":
        return parse_lines(lines)
    head = F.nullif(F.regexp_extract("line", EPOCH_HEAD, 1), F.lit("")).cast("int")
    score = F.nullif(F.regexp_extract("line", SCORE_LINE, 1), F.lit("")).cast("double")
    return lines.select("run_id", "seq", head.alias("epoch"), score.alias("value")).filter("epoch is not null or value is not null")


class _Monitor(StatefulProcessor):
    """Early stopping of one run whose log lines may come in any order.

    Lines are kept in state in blocks of ``seq``; a block holds its lines, as bytes of (seq, epoch, value), and, per block, a summary: the last head in
    it, and the best score and score counts under heads of its own.  A late line changes its own block only, and a
    pass over the block summaries gives the count behind the best checkpoint.
    """

    def __init__(self, patience: int, sign: float, block: int):
        self.patience, self.sign, self.block = patience, sign, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "block long", "data binary")
        self.blocks = handle.getMapState("blocks", "block long", SUMMARY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for part in rows:
            waiting.append(part[["seq", "epoch", "value"]].to_numpy("float64", na_value=np.nan))
            n += len(part)
            if n >= CHUNK:
                self.store(np.concatenate(waiting))
                waiting, n = [], 0
        if n:
            self.store(np.concatenate(waiting))
        out = self.verdict()
        if out is not None:
            yield pd.DataFrame([(key[0], *out)], columns=COLUMNS)

    def store(self, new: np.ndarray) -> None:
        """Rows (seq, epoch, value) into their blocks, each of which is read and written once."""
        new = new[np.argsort(new[:, 0], kind="stable")]
        number = new[:, 0] // self.block
        for part in np.split(new, np.nonzero(np.diff(number))[0] + 1):
            at = (int(part[0, 0] // self.block),)
            if self.lines.containsKey(at):
                old = np.frombuffer(self.lines.getValue(at)[0]).reshape(-1, 3)
                part = np.concatenate((old, part))
                part = part[np.argsort(part[:, 0], kind="stable")]
            first = np.nonzero(np.diff(part[:, 0], prepend=np.nan))[0]
            part = np.fmax.reduceat(part, first)
            self.lines.updateValue(at, (part.tobytes(),))
            self.blocks.updateValue(at, self.summary(part))

    def summary(self, part: np.ndarray) -> tuple:
        """(last head, scores before the block's first head, the best of those, scores under own heads, the best of those).

        A best is (score, epoch, scores of its kind behind it); scores before the first head belong to an earlier
        block's head, or to none.
        """
        _, epoch, value = part.T
        under = np.maximum.accumulate(np.where(np.isnan(epoch), -1, np.arange(len(epoch))))  # the row of the last head, -1 before any
        head = None if under[-1] < 0 else int(epoch[under[-1]])
        scored = ~np.isnan(value)
        loose, own = scored & (under < 0), scored & (under >= 0)
        return (head, *self.best(value[loose], None), *self.best(value[own], epoch[under[own]]))

    def best(self, scores: np.ndarray, heads: np.ndarray | None) -> tuple:
        if not len(scores):
            return 0, None, None, 0
        at = int(np.argmax(self.sign * scores))
        return len(scores), float(scores[at]), None if heads is None else int(heads[at]), len(scores) - 1 - at

    def verdict(self) -> tuple | None:
        """Blocks in order: a better score starts the count anew, any other adds what the block holds."""
        n, best, best_epoch, since, head = 0, None, None, 0, None
        for _, (last, n0, v0, _, s0, n1, v1, e1, s1) in sorted(self.blocks.iterator(), key=lambda x: x[0][0]):
            for count, top, epoch, behind, known in ((n0, v0, head, s0, head is not None), (n1, v1, e1, s1, True)):
                if not count or not known:
                    continue
                n += count
                if best is None or self.sign * top > self.sign * best:
                    best, best_epoch, since = top, epoch, behind
                else:
                    since += count
            head = head if last is None else last
        return (n, best, best_epoch, since, 0 < self.patience <= since) if n else None

    def close(self) -> None:
        pass


def monitor(metrics: DataFrame, patience: int, higher_is_better: bool, block: int = 1024) -> DataFrame:
    """Per run and micro-batch: best so far, its epoch, checkpoints since the first best, and whether patience ran out.

    Exact for lines that come late, in whatever batch: the result after a batch is that of all lines so far in
    ``seq`` order.  Lines that repeat a ``seq`` are one line, with the greatest values.  A score belongs to the last head
    before it; scores before any head are no checkpoints.  State holds the run's lines in blocks of ``block`` and one summary per block, so
    a batch reads the blocks that it touches and the summaries.  Map states live in the RocksDB state store, which this sets
    for the session.
    """
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    sign = 1.0 if higher_is_better else -1.0
    return metrics.groupBy("run_id").transformWithStateInPandas(
        _Monitor(patience, sign, block), outputStructType=MONITOR, outputMode="Update", timeMode="None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into a table and read it back (update mode keeps every emitted row with its batch)."""
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def latest_per_run(emitted: DataFrame) -> DataFrame:
    cols = [c for c in emitted.columns if c not in ("run_id", "batch_id")]
    return emitted.groupBy("run_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_r")).select("run_id", "_r.*")


def update_history(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Fold new verified results into a history kept per micro-batch, then recommend.

    Each batch writes its latest value per (key, sample) under its own id, so a
    replayed batch overwrites itself. The read side takes the newest row.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        newest = batch.filter("verified").groupBy("config_key", "fish_id").agg(
            F.max_by(F.struct("value", "ts"), F.struct("ts", "value")).alias("_r")
        )
        newest.select("config_key", "fish_id", "_r.value", "_r.ts").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "config_key string, fish_id string, value double, ts timestamp"
    return spark.read.schema(schema).parquet(f"{path}/batch=*").withColumn("verified", F.lit(True))


def recommend_stream(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    return recommend_all(update_history(stream, path, checkpoint))
