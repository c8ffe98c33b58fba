"""Graphs as edge tables: components, neighbourhoods, ego graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that rounds don't pile up lineage and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that each node of the edges is connected with.

    Each round a node takes the smallest label around it, then the label of that; both shuffles are as large as the edges.
    """
    both = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(b, a)).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        near = labels.join(heard, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old"))
        labels = new.select("node", "label")
        if not new.where(F.col("label") != F.col("old")).limit(1).count():
            return labels


#: Members of a key beyond which its pairs are made in blocks of as many by as many.
HOT = 2000


def pairs(members: DataFrame, key: str, node: str, also: tuple[str, ...] = (), both: bool = False) -> DataFrame:
    """a, b for each key that holds both nodes (a < b, or both ways), with a_x and b_x of each further column x of the nodes.

    A hot key's members are dealt to parts, and each pair of parts meets in a task of its own.
    """
    one = members.select(key, node, *also).distinct()
    side = lambda df, s, *more: df.select(key, F.col(node).alias(s), *[F.col(x).alias(f"{s}_{x}") for x in also], *more)
    kept = F.col("a") != F.col("b") if both else F.col("a") < F.col("b")
    hot = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / HOT).alias("parts")).where(F.col("parts") > 1)
    if not hot.limit(1).count():
        return side(one, "a").join(side(one, "b"), key).where(kept)
    parts = F.coalesce("parts", F.lit(1))
    dealt = cut(one.join(hot, key, "left").select(key, node, *also, parts.alias("parts"), F.pmod(F.xxhash64(node), parts).alias("own")))
    all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    return side(dealt, "a", F.col("own").alias("i"), all_.alias("j")).join(side(dealt, "b", all_.alias("i"), F.col("own").alias("j")), [key, "i", "j"]).where(kept)


def shared_pairs(members: DataFrame, key: str, node: str) -> DataFrame:
    """a, b, shared: pairs of nodes (a < b) and how many keys hold both."""
    return pairs(members, key, node).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of (id, nbr) once, smaller first, with its best score."""
    return edges.groupBy(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).agg(F.max("score").alias("score"))


def ego(edges: DataFrame, root, first: int = 10, second: int = 4) -> DataFrame:
    """id, depth: the root, its first neighbours by rank, and theirs."""
    near = edges.where((F.col("id") == root) & (F.col("rank") <= first)).select(F.col("nbr").alias("id"))
    far = edges.join(near, "id", "left_semi").where((F.col("rank") <= second) & (F.col("nbr") != root)).select(F.col("nbr").alias("id"))
    found = near.select("id", F.lit(1).alias("depth")).union(far.select("id", F.lit(2))).union(edges.sparkSession.createDataFrame([(root, 0)], "id long, depth int"))
    return found.groupBy("id").agg(F.min("depth").alias("depth"))


def focus_depth(nodes: DataFrame, edges: DataFrame, root, limit: int = 12) -> DataFrame:
    """id, depth: 0 for the root, 1 for its neighbours, 2 for theirs, 3 for the rest."""
    near = edges.where((F.col("id") == root) & (F.col("rank") <= limit)).select(F.col("nbr").alias("id"))
    far = edges.join(near, "id", "left_semi").select(F.col("nbr").alias("id")).distinct()
    marked = nodes.select("id").join(near.withColumn("n", F.lit(1)), "id", "left").join(far.withColumn("f", F.lit(1)), "id", "left")
    return marked.select("id", F.when(F.col("id") == root, 0).when(F.col("n") == 1, 1).when(F.col("f") == 1, 2).otherwise(3).alias("depth"))


def expand(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (id) that match, and those linked to one of them."""
    there = links.join(matches.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"))
    back = links.join(matches.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"))
    return matches.select("id").union(there).union(back).distinct()


def islands(labels: DataFrame, weights: DataFrame, least: int, most: int) -> DataFrame:
    """label, size, weight, rank: components by size, weight and label."""
    own = labels.join(weights, "node").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    order = [F.desc("size"), F.desc("weight"), F.asc("label")]
    few = own.where(F.col("size") >= least).orderBy(*order).limit(most)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
