"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Tables


def connected_components(links: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that each linked id reaches; a link to itself or a repeated one changes nothing.

    Rounds of taking the least label among neighbours and then the label of one's label;
    the second step halves long paths, so rounds grow with the logarithm of a component's
    diameter.  Each round ends in a table of the shared folder, and the one before goes.
    Both joins put the row of a hub against many; these are sort-merge joins whose result is
    written or dealt anew, so adaptive execution may split the many and repeat the one.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = tables.keep(one.unionAll(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = tables.keep(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component"), F.col("x").alias("was")))
    while True:
        near = edges.join(labels, edges["y"] == labels["id"]).groupBy("x").agg(F.min("component").alias("m"))
        lower = tables.keep(labels.select("id", "component").join(near, F.col("id") == near["x"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("component")))
        tables.drop(labels)
        up = lower.select(F.col("id").alias("at"), F.col("component").alias("above"))
        labels = tables.keep(lower.join(up, lower["component"] == up["at"], "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component"), "was"))
        tables.drop(lower)
        if labels.where("component <> was").isEmpty():
            tables.drop(edges)
            return labels
