"""Connected components for the small graphs inside buckets: every node takes the smallest label of its neighbours until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillroom.operators.skew import join_values
from stillroom.sources.tables import cut


def smallest_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with label the smallest node reachable over edges (a, b), taken both ways.

    Each round takes the neighbours' smallest label, then the label of that label, so chains shorten by halves; only labels that changed are told again. Ends
    when none changes, however long the chains are. A node with very many edges tells them its label by broadcast. Lone nodes keep their own label; repeated
    edges and loops don't matter; empty tables give no rows.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    total = both.count()
    degree = cut(both.groupBy("b").agg(F.count("*").alias("n")))
    labels = cut(nodes.select("node").distinct().withColumn("label", F.col("node")))
    news = labels
    while total:
        told = degree.join(news.select(F.col("node").alias("b"), "label"), "b")
        heard = join_values(both, told, "b", total).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("above"))
        after = cut(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("above", "new")).alias("next"), "label"))
        labels = after.select("node", F.col("next").alias("label"))
        news = after.where("next <> label").select("node", F.col("next").alias("label"))
        if news.isEmpty():
            break
    return labels
