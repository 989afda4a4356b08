"""Connected components of links by large-star and small-star rounds in Spark.

Each round sends every node's larger neighbours, then its smaller ones, to the
smallest node it knows, until the links are stars. Rounds are staged in the shared
folder; only a count and a checksum of the links reach the driver. Minima are
partial aggregates, joined back, so a node with very many links makes no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import stage, unstage


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """pairs with m, the smallest of u and its v."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(lowest, "u").withColumn("m", F.least("u", "m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """edges must have u > v."""
    star = _to_smallest(edges)
    return star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))


def stars(links: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for each node u that is linked to a smaller one."""
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == seen or not state[0]:
            return edges
        seen = tuple(state)
        old = edges
        edges = stage(_small(_large(edges).where("u <> v").distinct()).distinct(), "links")
        unstage(old)
