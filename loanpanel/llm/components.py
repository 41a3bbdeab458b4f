"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.common import write_stage


def _minimum(pairs: DataFrame) -> DataFrame:
    """Smallest of each node and its neighbours; a stage of its own, so that the join with a hub's
    many links can be split."""
    return write_stage(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "star-min")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    joined = links.join(_minimum(links), "u")
    return joined.select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of integers -> (node, root), root the smallest node reachable.

    Nodes without a link are not returned; null and equal ends are ignored. Every round writes its
    links to the shared folder, so a lost executor repeats one round at most.
    """
    ends = links.where("u is not null and v is not null and u <> v")
    now = write_stage(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = state
        now = write_stage(_small_star(_large_star(now).distinct()).distinct(), "links")
