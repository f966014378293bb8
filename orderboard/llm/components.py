"""Connected components of a graph given by its edges, as DataFrames.

Large-star and small-star steps in turn: every node ends up linked to the
smallest node of its component. Each step is a minimum by node, summed within
tasks first, and a join with it; between steps the edges are a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.llm.tables import removed, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("of"), F.least("u", "low").alias("low"))
    upper = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("of"))
    return upper.select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "of")
    linked = down.join(least, F.col("u") == F.col("of")).select("v", "low")
    kept = linked.filter(F.col("v") > F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return kept.unionByName(least.select(F.col("of").alias("u"), F.col("low").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) names, stored; the root is the smallest."""
    now = stored(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "components")
    state = _state(now)
    while state[0]:
        last, now = now, stored(_small_star(_large_star(now).distinct()).distinct(), "components")
        removed(last)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = stored(roots.unionByName(own), "components")
    removed(now)
    return found
