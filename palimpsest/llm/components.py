"""Connected components as DataFrame joins: smallest labels spread over links, with a jump to the label's own label each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import cut


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """links: a, b (bigint). Each linked v with the smallest id of its component as label. The rounds grow with the logarithm of the
    longest path; all tables stay in the shared folder, and one count a round comes to the driver."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        sent = both.join(labels, both.b == labels.v).select(F.col("a").alias("v"), "label")
        least = labels.union(sent).groupBy("v").agg(F.min("label").alias("label"))
        least = cut(least)
        target = least.select(F.col("v").alias("label"), F.col("label").alias("further"))
        jumped = least.join(target, "label").select("v", F.least("label", "further").alias("label"))
        jumped = cut(jumped)
        before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        after = jumped.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        labels = jumped
        if before == after:  # labels only fall
            return labels
    raise ValueError("components didn't settle")
