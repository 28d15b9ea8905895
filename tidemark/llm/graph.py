"""Connected components over links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.storage import discard, mark


#: Up to so many links are worked on in one partition, where steps need no shuffle.
FEW = 50_000


def _star(links: DataFrame, large: bool, few: bool) -> DataFrame:
    """Ties each neighbour of a node to the smallest of the node's neighbourhood.

    A large star does so for neighbours above the node, a small star for those below it and the node itself.  Minima
    are taken with map-side combining; the rest is a join that Spark may split where a node is hot.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if few:
        both = both.coalesce(1)
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        tied = tied.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        tied = tied.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    if few:
        tied = tied.coalesce(1)
    return tied.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node named by ``links`` (a, b): label is the smallest node of its component.

    Tables of earlier steps are deleted as soon as the next one is written.
    """
    since, spark = mark(links.sparkSession), links.sparkSession
    links, before = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    few = links.limit(FEW + 1).count() <= FEW  # steps never make more links
    while True:
        links = written(_star(written(_star(links, True, few)), False, few))
        state = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        discard(spark, since, keep=1)
        if state == before:
            break
        before = state
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
