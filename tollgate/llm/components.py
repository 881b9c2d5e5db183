"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm import store


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links(a, b)`` is connected to.

    Each round takes the smallest label of the neighbours and then follows the label's
    own label, so chains shrink by half; labels are stored after every round. A node
    with very many links costs one partial aggregate, and the joins are between stored
    tables, so that adaptive execution can split a hot node.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store.written(both.distinct(), "links")
    labels = store.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = store.written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("changed")), "labels")
        if not lower.where("changed").limit(1).count():
            return labels
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = store.written(lower.join(above, "label").select("node", F.least("label", "above").alias("label")), "labels")
