"""Connected components of links, in rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, below the least
    of them. Rounds grow with the logarithm of the longest path, not with its length,
    and rows never exceed twice the links. Every round is a written table.
    """
    edges = settle(_distinct(links), "links")
    state = None
    while (before := state) != (state := _fingerprint(edges)):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        hung = _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        least = hung.groupBy("a").agg(F.min("b").alias("least"))
        rest = hung.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = settle(_distinct(rest.unionAll(least.select("a", F.col("least").alias("b")))), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()


def _distinct(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger node a to its smaller node b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Alike for two sets of links if they are the same."""
    found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(found)
