"""Session settings and durable cuts of a plan's lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot segment may be split even where the aggregate above the join would have reused
    # the join's partitioning; the price is one more shuffle of partial sums.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot never compiles a method of more than 8000 bytes. A stage whose loop would be longer runs
    # faster operator by operator, each of them compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Tables laid out by segment meet on (segment, tile) without being laid out anew by both: a
    # segment lies in one tile.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time SQL settings the operators assume. Sizes stay the cluster's choice."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it from there from now on.

    The folder is the checkpoint folder of the context or the cluster's `spark.checkpoint.dir`.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            raise ValueError(
                "This operator checkpoints. Set spark.checkpoint.dir to a folder that "
                "every executor can reach.")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
