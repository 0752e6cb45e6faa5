"""Connected components of an undirected graph in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (same type, non-null) -> node, root (the least node of its component), spooled; nodes that are roots are left out.

    Alternates large stars and small stars: every node links its larger (then smaller) neighbours to the least node it
    sees, until nothing changes, which takes a number of rounds like the square of the logarithm of the nodes. A hub's neighbours are never gathered in one row: the least one is an aggregate with
    partial sums, and the join with it can be split.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u")
        if larger:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))

    def tidy(e: DataFrame) -> DataFrame:
        return c.spool(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = tidy(edges)
    seen = mark(now)
    while True:
        last, now = now, tidy(star(tidy(star(now, True)), False))
        c.drop_spool(last)
        if (m := mark(now)) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = m
