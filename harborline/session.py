"""Session set-up and the two places where a frame is written down mid-plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every analysis relies on. Skewed join keys are split at run time by AQE.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Shuffle partitions are merged by their compressed size, and narrow rows take 20 to 70 times that in a task's sorts and hash
# tables. Spark's own 64 MB is replaced, a size that the session names is kept.
MERGED_SIZE = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in SCALE_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(MERGED_SIZE[0], None) is None:
        spark.conf.set(*MERGED_SIZE)
    return spark


def local_session(app: str = "harborline", cores: str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SCALE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a single-machine session may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="harborline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{_checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Write a frame down once, as Parquet below the shared checkpoint folder, and read it back.

    Used before ranking on a computed double: a floating sum may differ in its last bit when a plan branch is run
    again, and a value on a bucket edge must land in one bucket only. The read-back also has a measured size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pinned_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`pinned`, and the number of rows, counted while they are written."""
    seen = Observation()
    frame = pinned(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return frame, seen.get["rows"]
