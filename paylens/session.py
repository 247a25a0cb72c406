"""Session settings the operators count on. Cluster sizing stays with the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Re-plan on real sizes: coalesce small partitions, split skewed ones in
    # joins, switch to a broadcast only where the measured side fits.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Division by zero is handled in the expressions; overflow must not pass silently.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Only a new session takes this one. It saves a stack walk per column expression.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session the caller already owns."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the one the cluster names, else one of the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there; executors may be lost without changing it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()
