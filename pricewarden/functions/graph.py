"""Connected components of a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.session import cut_lineage


def pair_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, component): the component of every left node of a two-sided graph, named after its smallest left node.

    A round gives each right node the smallest name among its left ones, then each left node the smallest among its right
    ones, and last the name of that name, so a path of n nodes is done in about log n rounds. All steps are grouped
    minima, which combine before the shuffle; the driver sees whether a round changed anything.
    """
    edges = cut_lineage(pairs.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct())
    names = cut_lineage(edges.select("l").distinct().withColumn("name", F.col("l")))
    while True:
        heard = edges.join(names, "l").groupBy("r").agg(F.min("name").alias("name"))
        near = edges.join(heard, "r").groupBy("l").agg(F.min("name").alias("near"))
        further = names.select(F.col("l").alias("near"), F.col("name").alias("further"))
        told = names.join(near, "l").join(further, "near").select("l", F.least("near", "further").alias("name"), F.col("name").alias("before"))
        told = cut_lineage(told)
        names = told.select("l", "name")
        if told.where("name < before").isEmpty():
            return names.select(F.col("l").alias(left), F.col("name").alias("component"))
