"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is an aggregation by node and a join back; no node's neighbours are ever
collected. Edges are salted by their other end: the least neighbour is found per node and salt,
then per node, and goes back to the salts that the node has (SALTS at most, never more than its
edges), so a centre with very many neighbours is spread over that many keys.
An empty table of edges gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import written


SALTS = 64


def _least(edges: DataFrame) -> DataFrame:
    """(u, salt, m): the least v around each u, once per salt among its edges (u, v, salt)."""
    part = edges.groupBy("u", "salt").agg(F.min("v").alias("m"))
    whole = part.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return whole.select("u", "m", F.explode("salts").alias("salt"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Link the larger (or the smaller) neighbours of each node to the least of all around it."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = _least(salted)
    if large:
        out = salted.join(least, ["u", "salt"]).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = salted.join(least, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge; root is the least node of its component.

    `edges` has two columns u, v of one orderable type; nulls and loops are ignored,
    repeated and reversed edges count once.
    """
    state = written(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "components",
    )
    while True:
        after = written(_star(_star(state, True), False), "components")
        # stars only: nobody's root has a root, and each node has one
        done = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        state = after
        if done and after.groupBy("u").count().where("count > 1").isEmpty():
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
