"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import Cut


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours' labels, then the label of
    that label (pointer jumping), so long chains shrink fast. A hot node costs one map-side
    combined row for each task. Every round is written to the shared folder. Labels only fall, so the
    rounds end. Empty links give an empty table; loops and repeated links change nothing."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    edges = Cut(both, "edges")
    first = edges.df.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("comp"), F.lit(True).alias("moved"))
    held = Cut(first, "components")
    while True:
        state = held.df.select("node", "comp")
        near = edges.df.join(state.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = state.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        jump = step.join(state.select(F.col("node").alias("low"), F.col("comp").alias("jump")), "low", "left")
        low = F.least("low", F.coalesce("jump", "low"))
        new = Cut(jump.select("node", low.alias("comp"), (low < F.col("comp")).alias("moved")), "components")
        held.drop()
        held = new
        if held.df.filter("moved").isEmpty():
            edges.drop()
            return held.df.select("node", "comp")
