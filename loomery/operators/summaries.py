"""Trends, reading trails and topic lenses of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import split_sentences
from loomery.operators.ranking import counted, top


def centrality(nodes: DataFrame, edges: DataFrame, how: str = "avg") -> DataFrame:
    """id, centrality: the mean (or sum) of a record's neighbour scores, to 6 places; 0 without neighbours."""
    value = F.round(F.avg("score") if how == "avg" else F.sum("score"), 6)
    own = edges.groupBy("id").agg(value.alias("c"))
    return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("centrality"))


def representatives(members: DataFrame, central: DataFrame, n: int = 5) -> DataFrame:
    """cluster, id, rank: the most central members."""
    return top(members.join(central, "id"), ["cluster"], [F.desc("centrality"), F.asc("ord")], n).select("cluster", "id", "rank")


def sentences(members: DataFrame, keywords: DataFrame, n: int = 3) -> DataFrame:
    """cluster, sentence, hits, rank: sentences of the members that hold most keywords; of those with a common start the first.

    members: cluster, ord, abstract; keywords: cluster, terms array<string>.
    """
    each = members.join(F.broadcast(keywords), "cluster").select("cluster", "ord", "terms", F.posexplode(split_sentences(F.col("abstract"))).alias("i", "sentence"))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.col("sentence")), F.lower(t))))
    scored = each.withColumn("hits", hits).where(F.col("hits") > 0).withColumn("start", F.lower(F.substring("sentence", 1, 60)))
    first = top(scored, ["cluster", "start"], [F.desc("hits"), F.asc("ord"), F.asc("i")], 1, "_first")
    return top(first, ["cluster"], [F.desc("hits"), F.asc("ord"), F.asc("i")], n).select("cluster", "sentence", "hits", "rank")


def trends(members: DataFrame, edges: DataFrame, keywords: DataFrame) -> dict[str, DataFrame]:
    """Cards of clusters with two members or more: sizes, representatives, sentences, counts of areas."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    own = members.join(sizes.select("cluster"), "cluster", "left_semi")
    central = centrality(own, edges, "sum")
    return {"sizes": sizes, "representatives": representatives(own, central), "sentences": sentences(own, keywords), "areas": counted(own, ["cluster"], "area", "ord", 6)}


def trail(members: DataFrame, edges: DataFrame, intro: str, applied: str) -> DataFrame:
    """id, stage, other: what to read next to a record: its cluster's most central record, an introduction, an application, a neighbour beyond.

    A record isn't its own next, and none comes twice.  Of each stage the two best of a cluster are enough to find another.
    """
    central = members.join(centrality(members, edges), "id")
    stages = {"core": F.lit(True), "intro": F.col("abstract").rlike(intro), "applied": F.col("abstract").rlike(applied)}
    best = None
    for place, (stage, keep) in enumerate(stages.items()):
        two = top(central.where(keep), ["cluster"], [F.desc("centrality"), F.asc("ord")], 2).select("cluster", F.lit(stage).alias("stage"), F.lit(place).alias("place"), F.col("id").alias("other"), "rank")
        best = two if best is None else best.unionAll(two)
    inside = members.select("id", "cluster").join(best, "cluster").where(F.col("id") != F.col("other"))
    picked = top(inside, ["id", "stage"], [F.asc("rank")], 1, "_r").select("id", "stage", "place", "other")
    clusters = members.select(F.col("id").alias("nbr"), F.col("cluster").alias("theirs"))
    beyond = edges.join(members.select("id", "cluster"), "id").join(clusters, "nbr").where(F.col("cluster") != F.col("theirs"))
    far = top(beyond, ["id"], [F.asc("rank")], 1, "_r").select("id", F.lit("broader").alias("stage"), F.lit(3).alias("place"), F.col("nbr").alias("other"))
    return top(picked.unionByName(far), ["id", "other"], [F.asc("place")], 1, "_once").select("id", "stage", "other")


def lenses(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, area: the most frequent area of each cluster, the first seen of equal ones."""
    return counted(members, ["cluster"], "area", "ord", 1).select("cluster", "area")


def outliers(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """id: the first records without neighbours."""
    return nodes.join(edges.select("id").distinct(), "id", "left_anti").orderBy("ord").limit(n).select("id")
