"""Connected components of links, by alternating star rounds on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import materialized


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does; one row to the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``class_id`` (smallest identifier it is linked to) of all ends of ``links`` (a, b).

    Each round first points the larger neighbours of a node to its smallest neighbour, then the smaller
    ones; edges only ever become stars, their number does not grow, and a hub's neighbours are reached
    by a join on the hub's smallest neighbour, which is one row per node.
    """
    edges = materialized(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.filter("b > a").join(least, "a").filter("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = materialized(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = materialized(small.filter("a != b").distinct())
        now = _state(edges)
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("class_id")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("class_id")).distinct()
            )
        state = now
