"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.store import written

COPIES = 16


def components(links: DataFrame, a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """`node` and `component`, the smallest node it reaches, for every node that has a link.

    Each round takes the smallest label of the neighbours, then the label of that label, which halves
    the distance to the smallest node. Every round is a written table, so a lost executor costs one
    round. Labels that many nodes share meet their own label in copies, so no task gets them all. Only
    the number of changed labels comes to the driver. No links give no rows.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = written(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
                   .distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("low"))
                     .select("node", F.least("node", "low").alias("label")), "labels")
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other") \
            .groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        roots = labels.join(labels.select(F.col("label").alias("node")).distinct(), "node") \
            .select(F.col("node").alias("label"), F.col("label").alias("root")).withColumn("copy", copies)
        jumped = lower.withColumn("copy", F.pmod(F.xxhash64("node"), F.lit(COPIES)).cast("int")) \
            .join(roots, ["label", "copy"], "left") \
            .select("node", "before", F.coalesce(F.least("label", "root"), "label").alias("label"))
        kept = written(jumped, "labels")
        changed = kept.filter("label <> before").limit(1).count()
        labels = kept.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"the labels still change after {most_rounds} rounds")
