"""Typed, weighted graphs as edge tables, and ranking by bounded expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable

# Edge types with their weights forwards and backwards; a type without weights is never expanded.
EDGE_TYPES = (
    ("calls", 1.0, 1.0),
    ("instantiates", 1.0, 1.0),
    ("references", 1.0, 1.0),
    ("context_manager", 1.0, 1.0),
    ("contains", 0.7, 0.5),
    ("inherits", 0.5, 0.5),
    ("tested_by", None, None),
    ("calls_inferred", 0.8, 0.8),
    ("implements", 0.5, 0.5),
)
SEEDS, PER_NODE, DECAY = 5, 8, 0.5


def edge_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_TYPES, "type string, forward double, backward double")


def neighbours(edges: DataFrame) -> DataFrame:
    """``node, neighbour, weight``: both directions of edges (src, dst, type) that have a weight, the
    greatest of parallel ones; no node is its own neighbour."""
    w = edges.join(F.broadcast(edge_weights(edges.sparkSession)), "type").where("forward is not null and src <> dst")
    both = w.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.col("forward").alias("weight")).unionByName(
        w.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.col("backward").alias("weight"))
    )
    return both.groupBy("node", "neighbour").agg(F.max("weight").alias("weight"))


def in_degree(edges: DataFrame) -> DataFrame:
    """``node, in_degree``: rows of weighted edges that end in the node, parallel types each."""
    w = edges.join(F.broadcast(edge_weights(edges.sparkSession)), "type").where("forward is not null")
    return w.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def relative_relevance(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``score`` over the best of its ``keys``, clipped to 0..1; 0 where the best isn't positive."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return scores.withColumn("relevance", F.when(best > 0, F.least(F.greatest(F.col(score) / best, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))


def expand(edges: DataFrame, seeds: DataFrame, keys: list[str], relevance: DataFrame | Callable[[DataFrame], DataFrame] | None = None, hops: int = 2, rrf_k: int = 60, seed_count: int = SEEDS, per_node: int = PER_NODE) -> DataFrame:
    """``keys, item, score, graph_rank`` of what ``hops`` steps from the best ``seeds`` (keys, item,
    item_rank) reach. A seed of rank r gives 1/(rrf_k + r). A neighbour's strength is edge weight / ln(2 +
    in-degree) x relevance (keys, item, relevance, or a function that makes these rows for pairs of keys and
    item; without it 1, and with it 0 for items it lacks); each node passes on to its
    ``per_node`` strongest, in whole, and with half the value to the next hop. Scores are rounded to 12
    digits in each step, and ties go to the smaller item, so that no order of summing decides."""
    if hops < 1:
        raise ValueError("hops must be at least 1")
    near = neighbours(edges).join(in_degree(edges).withColumnRenamed("node", "neighbour"), "neighbour", "left")
    strength = F.col("weight") / F.log(F.lit(2.0) + F.coalesce("in_degree", F.lit(0)))
    near = near.select("node", "neighbour", F.round(strength, 12).alias("strength"))
    by_node = Window.partitionBy("node").orderBy(F.desc("strength"), "neighbour")
    if relevance is None:
        # what a node passes on doesn't depend on the query
        near = near.withColumn("n", F.row_number().over(by_node)).where(F.col("n") <= per_node).drop("n")
    near = durable(near)
    frontier = seeds.where(F.col("item_rank") <= seed_count).select(*keys, F.col("item").alias("node"), (F.lit(1.0) / (F.lit(rrf_k) + F.col("item_rank"))).alias("given"))
    reached: DataFrame | None = None
    for _ in range(hops):
        step = frontier.join(near, "node")
        if relevance is not None:
            known = relevance(step.select(*keys, F.col("neighbour").alias("item"))) if callable(relevance) else relevance
            step = step.join(known.select(*keys, F.col("item").alias("neighbour"), "relevance"), [*keys, "neighbour"])
            step = step.withColumn("strength", F.col("strength") * F.col("relevance"))
        step = step.withColumn("strength", F.round("strength", 12)).where("strength > 0")
        order = Window.partitionBy(*keys, "node").orderBy(F.desc("strength"), "neighbour")
        step = step.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_node)
        value: Column = F.round(F.col("given") * F.col("strength"), 12)
        step = step.select(*keys, F.col("neighbour").alias("item"), value.alias("value"))
        summed = step.groupBy(*keys, "item").agg(F.sum("value").alias("value"), F.max("value").alias("most"))
        reached = summed if reached is None else reached.unionByName(summed)
        frontier = summed.select(*keys, F.col("item").alias("node"), (F.col("most") * DECAY).alias("given"))
    total = reached.groupBy(*keys, "item").agg(F.round(F.sum("value"), 12).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "item")
    return total.withColumn("graph_rank", F.row_number().over(order))


def implementers(classes: DataFrame, methods: DataFrame, protocols: DataFrame, least: int = 2) -> DataFrame:
    """``protocol, cls``: classes that have every method of a protocol (relational division). ``methods``
    is (cls, name); ``protocols`` (protocol, name), of which those with fewer than ``least`` methods match
    nothing; ``__init__`` doesn't count. Classes meet a protocol at the rarest of its names, so no popular name
    is squared, and are then counted over all of them."""
    wanted = durable(protocols.where("name <> '__init__'").distinct())
    size = wanted.groupBy("protocol").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    have = durable(methods.distinct().join(classes.select("cls").distinct(), "cls", "left_semi").join(wanted.select("name").distinct(), "name", "left_semi"))
    often = have.groupBy("name").agg(F.count("*").alias("often"))
    rarest = wanted.join(size, "protocol").join(often, "name").groupBy("protocol", "n").agg(F.min_by("name", F.struct("often", "name")).alias("name"))
    able = rarest.join(have, "name").select("protocol", "n", "cls").where("protocol <> cls")
    has = able.join(wanted, "protocol").join(have, ["cls", "name"]).groupBy("protocol", "cls", "n").agg(F.count("*").alias("has"))
    return has.where("has = n").select("protocol", "cls")
