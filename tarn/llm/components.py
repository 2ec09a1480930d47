"""Connected components of an edge table, without gathering it anywhere.

Alternating star operations (Kiveris et al., 2014): the large star links a node's larger neighbours to the smallest node around it,
the small star does so with the smaller neighbours. Each halves long paths. Minima are aggregated before they are exchanged and joined back with the edges
of hot nodes dealt out, so a node with very many neighbours is no task of its own. A round ends in a written table; the last one is a
forest of stars, which is tested by one count per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import base


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a < b, repeats allowed. Returns edges of the same kind."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    linked = base.join_back(both, least, ["u"], "v")
    if large:  # neighbours above u now hang on m
        out = linked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:  # neighbours below u, and u itself, hang on m
        out = linked.select("m", F.explode(F.array("u", "v")).alias("b")).select(F.col("m").alias("a"), "b")
    return out.where("a < b")


def _open(edges: DataFrame) -> bool:
    """Does a node hang on two others, or on one that hangs on another itself."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("n"), F.lit(False).alias("top")).union(edges.select("a", F.lit(0), F.lit(True)))
    return not ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where("n > 1 or n = 1 and top").isEmpty()


def components(edges: DataFrame, scratch: base.Scratch | None = None) -> DataFrame:
    """For edges (a long, b long): (node, component), the component being its smallest node. Nodes without an edge don't appear; repeated edges and
    loops say nothing, an edge with a null end is none, and an empty table gives an empty result."""
    base.prepare(edges.sparkSession)
    scratch = scratch or base.Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while _open(now):
        before, now = now, scratch.keep(_stars(_stars(now, True), False).distinct(), "stars")
        scratch.drop(before)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
