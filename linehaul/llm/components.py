"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.llm.stage import staged


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in the links ``(a, b)``: the smallest id reachable.

    Every round an id takes the smallest label of its neighbours and then the label of
    that label, so that long paths shrink by jumps. Labels are written out every round;
    nothing but a count reaches the driver. Minima combine within each task, and a hub's
    links are split by Spark's skew handling, since its label is one row.
    """
    edges = staged(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges"
    )
    labels = staged(
        edges.groupBy(F.col("a").alias("id"))
        .agg(F.min("b").alias("m"))
        .select("id", F.least("id", "m").alias("component")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["id"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        least = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("least")
        )
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("jumped"))
        new = least.join(jump, F.col("least") == F.col("j"), "left").select(
            "id", "was", F.least("least", "jumped").alias("component")
        )
        new = staged(new, "labels")
        if new.where("was <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
