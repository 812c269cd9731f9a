"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b); a component is named after its smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label, so a path of n
    nodes needs about log n rounds. A hub is folded by a grouped minimum, which combines before the shuffle. Rounds are
    written to the shared folder; the driver sees one count a round.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nearest = labels.join(seen, F.col("node") == F.col("a"), "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("near")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        jumped = nearest.join(jump, F.col("near") == F.col("at"), "left").select(
            "node", F.least("near", F.coalesce("further", "near")).alias("component"), F.col("component").alias("before")
        )
        result = stored(jumped, "labels")
        labels = result.select("node", "component")
        if result.where("component < before").isEmpty():
            return labels
