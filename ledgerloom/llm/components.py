"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop, stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its smallest node.

    Large star: every node hands its larger neighbours to the smallest of its neighbourhood. Small star: every node joins
    its smaller neighbours with their smallest. Minima are combined before they are shuffled, so a node with very many
    links is no hot task; each round is a written table. It ends when a round changes nothing: all links are then stars.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = stored(edges, name)
    state = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state:
        state, old = now, edges
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(u AS u, m AS v), struct(v AS u, m AS v)))")
        edges = stored(small.where("u > v").distinct(), name)
        drop(old)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
