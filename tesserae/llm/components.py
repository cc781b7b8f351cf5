"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, label)`` for each id in a link; the label is the least id of its component.

    Each step takes the least label around an id and then its label's label, so chains halve and
    stars end at once. Labels stay in tables; steps are staged in the shared folder.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "id"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(around.withColumnRenamed("u", "id"), "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        after = least.join(jump, "next", "left").select("id", F.col("label").alias("before"), F.least("next", F.coalesce("beyond", "next")).alias("label"))
        after = staged(after, "labels")
        changed = after.where(F.col("label") != F.col("before")).limit(1).count()
        labels = after.select("id", "label")
        if not changed:
            return labels
