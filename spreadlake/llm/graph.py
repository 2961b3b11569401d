"""Connected components of links, by smallest labels and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Each round takes the smallest label among the neighbours and then the label of one's label, so
    that the rounds needed grow with the logarithm of the longest chain. Minima combine in the
    tasks; joins on an id with many links are left to adaptive execution, which splits them. Every
    round is written to the shared folder; the driver learns whether a label has changed.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("to")))
    both = stored(both.filter("id <> to").distinct(), "components-links")
    labels = stored(both.groupBy("id").agg(F.least(F.min("to"), F.min("id")).alias("component")), "components-0")
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("_near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        target = labels.select(F.col("id").alias("_new"), F.col("component").alias("_jump"))
        jumped = lower.join(target, "_new", "left").select("id", "_old", F.least("_new", F.coalesce("_jump", "_new")).alias("component"))
        jumped = stored(jumped, "components-n")
        labels = jumped.select("id", "component")
        if jumped.filter("component <> _old").limit(1).count() == 0:
            return labels
