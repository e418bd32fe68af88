"""Training-log source: (epoch, value) pairs from two line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# fixed values: log patterns, groups 1 = epoch, 2 = value
ONE_LINE = r"(\d+), train_loss=[\d.]+, test_loss=([\d.]+)"
TWO_LINE = r"(?s)Epoch (\d+) Summary:.*?Full-brain Dice:\s*([\d.]+)\s*\[MODEL SELECTION\]"
FORMATS = {
    "one_line": {"pattern": ONE_LINE, "higher_is_better": False, "label": "test_loss"},
    "two_line": {"pattern": TWO_LINE, "higher_is_better": True, "label": "Full-brain Dice"},
}


def parse_lines(lines: DataFrame) -> DataFrame:
    """One-line format, one log line per row (run_id, seq, line)."""
    m = lines.withColumn("_e", F.regexp_extract("line", ONE_LINE, 1)).filter("_e <> ''")
    return m.select(
        "run_id", "seq", F.col("_e").cast("int").alias("epoch"), F.regexp_extract("line", ONE_LINE, 2).cast("double").alias("value")
    )


def parse_text(texts: DataFrame, fmt: str) -> DataFrame:
    """Whole log texts (run_id, value) in either format; seq is the match number."""
    pattern = FORMATS[fmt]["pattern"]
    both = F.arrays_zip(
        F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("e"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("v")
    )
    m = texts.select("run_id", F.posexplode(both).alias("_i", "_m"))
    return m.select(
        "run_id", (F.col("_i") + 1).cast("long").alias("seq"), F.col("_m.e").cast("int").alias("epoch"), F.col("_m.v").cast("double").alias("value")
    )


def read_metric_log(spark, path: str, fmt: str) -> DataFrame:
    """Log files under ``path``; the run is the file name."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("run_id"), "value")
    return parse_text(t, fmt)
