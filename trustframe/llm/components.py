"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): component is the smallest id it reaches.

    Each round sends a node to the smallest of its neighbours' smallest, relabels the links, and
    drops those inside a node.  The image of a connected part is connected and the smallest id
    stays where it is, so what is left at the end is that id.  Links shrink fast; every round is
    written to the shared folder.  A node with very many links is summed map-side, and the joins
    on it are plain equi-joins, which the engine splits when they are skewed."""
    moves = []
    links = links.select("a", "b").filter("a != b")
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        p = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        q = cut(p.join(p.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        moves.append(q)
        to = lambda c: q.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        links = cut(links.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                    .filter("a != b").distinct())
    total = nodes.withColumn("component", F.col("id"))
    for q in moves:  # a few
        total = (total.join(q.select(F.col("id").alias("component"), "to"), "component", "left")
                 .select("id", F.coalesce("to", "component").alias("component")))
    return total
