"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# How many times smaller than its rows a regular mask may be in a file and in a shuffle block.
PACKED_FILE, PACKED_BLOCK = 100, 10


def true_sizes(spark: SparkSession) -> SparkSession:
    """Let Spark choose broadcasts by the rows' size, not by their packed one, so that none outgrows the driver."""
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(PACKED_FILE))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(limit // PACKED_BLOCK))
    return spark


def get_spark(app: str = "voxtable", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return true_sizes(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private folder is made only when the cluster names none (local tests).
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="spark-voxtable-")
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/voxtable/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, survives lost executors, keeps column pruning and gives the
    optimizer sizes for its join choices; see ``true_sizes``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the tables this application wrote with ``materialize``; call it when a job's results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/voxtable/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0
