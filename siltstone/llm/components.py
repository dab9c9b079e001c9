"""Connected components: of pointers by jumping, of edges by alternating star contraction, and of both by contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    star = down.join(least, "a")
    return star.select("a", F.col("m").alias("b")).union(star.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, label)`` for each node of an edge: label is the least node that it can reach.

    ``edges`` has two columns of comparable values. Loops and nulls are ignored,
    repeated edges count once; a node without an edge isn't in the result. Each
    round is written to the shared folder, so rounds don't pile up lineage.
    """
    a, b = edges.columns
    now = scratch.write(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), f"{name}-0")
    mark, turn = None, 0
    while True:
        turn += 1
        now, old = scratch.write(_small_star(_large_star(now)), f"{name}-{turn}"), f"{name}-{turn - 1}"
        scratch.drop(old)
        # The stars are stable once a round leaves the edges as they were.
        new = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == new:
            break
        mark = new
    root = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(root)


def follow(pointers: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, label)`` of ``(node, parent)``: where a node's pointers lead to.

    A node has one pointer at most, to a lesser node; one without has no row.
    Each round halves the way to the label.
    """
    now, turn = scratch.write(pointers.select("node", F.col("parent").alias("label")), f"{name}-0"), 0
    while True:
        turn += 1
        up = now.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = now.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"), F.col("higher").isNotNull().alias("moved"))
        now = scratch.write(jumped, f"{name}-{turn}").select("node", "label", "moved")
        scratch.drop(f"{name}-{turn - 1}")
        if now.where("moved").isEmpty():
            return now.select("node", "label")
        now = now.select("node", "label")


def labelled(df: DataFrame, column: str, to: str, label: DataFrame) -> DataFrame:
    """``df`` with the label of a column's nodes; a node that ``label`` hasn't is its own."""
    return df.join(label.select(F.col("node").alias(column), F.col("label").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))


def contract(spark: SparkSession, label: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``label`` after more edges ``(a, b)``: only the components that they join are looked at.

    ``label`` has a row for each node that isn't its component's label, before and after.
    """
    between = labelled(labelled(edges.select("a", "b"), "a", "la", label), "b", "lb", label).where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = scratch.write(components(spark, between, scratch, f"{name}-parts").where("node != label"), f"{name}-joined")
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = label.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.write(moved.unionByName(joined), name)
