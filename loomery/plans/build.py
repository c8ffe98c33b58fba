"""The whole build: records and references in, pinned tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import APPLIED, INTRO, parse_authors, work_key
from loomery.operators import citations, cluster, contract, neighbours, people, postings, summaries
from loomery.operators.artifacts import fingerprint, publish, warm
from loomery.operators.graph import cut
from loomery.operators.ranking import first_works, scoped, top


def semantic(records: DataFrame) -> dict[str, DataFrame]:
    """Neighbours, clusters of each level, labels of the primary level, and places on the map."""
    n = records.count()
    vectors = cut(postings.tfidf(cut(postings.field_counts(records.withColumn("id", F.col("ord")))), n))
    edges = cut(neighbours.nearest(vectors))
    packed, dims = cluster.pack(vectors, records.select(F.col("ord").alias("id"), "ord"))
    packed = cut(packed)
    made = cluster.levels(packed, max(1, dims), n, edges)
    assigned = None
    for k, own in made.items():
        part = own.select(F.lit(k).alias("k"), "id", "cluster")
        assigned = part if assigned is None else assigned.unionAll(part)
    sizes = assigned.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("size"))
    primary = cluster.primary_level(sizes).first()["k"]
    terms = postings.top_terms(vectors, made[primary], n)
    return {"neighbours": edges, "clusters": assigned, "primary": made[primary], "terms": terms, "map": cluster.project(packed, max(1, dims))}


def authors(records: DataFrame) -> dict[str, DataFrame]:
    """People, links and groups of each scope."""
    works = first_works(records.withColumn("work_key", work_key(F.col("title"), F.col("id"))))
    each = scoped(works).select("scope", F.col("ord").alias("work_id"), F.posexplode(parse_authors(F.col("authors"))).alias("pos", "name"), F.col("category").alias("topic"))
    out: dict[str, DataFrame] = {}
    for scope in ("all", "main", "workshop"):
        own = cut(people.resolve(each.where(F.col("scope") == scope).withColumn("occ", F.concat_ws(":", "work_id", "pos"))))
        links = cut(people.coauthor_links(own))
        parts = {"authors": people.rollup(own), "links": links, "groups": people.groups(own, links)}
        for name, df in parts.items():
            df = df.withColumn("scope", F.lit(scope))
            out[name] = df if name not in out else out[name].unionByName(df)
    return out


class Refused(ValueError):
    """What was to be published breaks the contract."""


def gate(*checks: DataFrame) -> None:
    """Refuses to go on if any check finds a violation; the message names some."""
    found = contract.all_of(*checks).limit(5).collect()
    if found:
        raise Refused("; ".join(f"{r['artifact']}: {r['rule']}: {r['detail']}" for r in found))


def build(records: DataFrame, references: DataFrame, path: str) -> dict:
    """Publishes all tables under path; the semantic stage is taken from a former build of the same records.

    Nothing is published if ids repeat, references lead nowhere, places aren't finite, or a table of people holds an address.
    """
    spark = records.sparkSession
    key = fingerprint(records.select("ord", "title", "abstract", "category_tags", "area_tags", "domain_tags"))
    made: dict[str, DataFrame] = {}
    for name in ("neighbours", "clusters", "primary", "terms", "map"):
        made[name] = warm(spark, path, f"{key}-{name}", lambda name=name: _once(made, records)[name])
    members = records.select(F.col("ord").alias("id"), "ord", "abstract", F.coalesce(F.get("area_tags", F.lit(0)), "category").alias("area")).join(made["primary"], "id")
    words = made["terms"].groupBy("cluster").agg(F.collect_list("term").alias("terms"))
    own = summaries.trends(members, made["neighbours"], words)
    cited = records.select(F.col("id").alias("record_id"), "category")
    edges = citations.overlap_edges(citations.known(references, cited))
    concepts = top(postings.concept_scores(records), ["id"], [F.desc("weight"), F.asc("phrase")], 9)
    index = postings.quantised(postings.hashed_vectors(records.select("id", F.concat_ws("\n", "title", "abstract", "category").alias("text"))))
    made_people = authors(records)
    gate(*[contract.no_email(df, f"people {name}", df.columns[0]) for name, df in made_people.items()])
    tables = {
        "records": records, "neighbours": made["neighbours"], "clusters": made["clusters"], "cluster_terms": made["terms"], "map_points": made["map"],
        "trend_sizes": own["sizes"], "trend_representatives": own["representatives"], "trend_sentences": own["sentences"],
        "trails": summaries.trail(members, made["neighbours"], INTRO, APPLIED), "outliers": summaries.outliers(members, made["neighbours"]),
        "concepts": concepts, "search_index": index, "overlaps": edges, "foundations": citations.foundations(references), **{f"people_{k}": v for k, v in made_people.items()},
    }
    gate(contract.unique_ids(records, "records"), contract.known_ids(made["neighbours"], "map", "nbr", members), contract.level_sizes(made["clusters"], records), contract.finite(made["map"], "map", "x"))
    return publish(tables, path, {"records": "type"})


def _once(made: dict, records: DataFrame) -> dict[str, DataFrame]:
    if "_all" not in made:
        made["_all"] = semantic(records)  # type: ignore[assignment]
    return made["_all"]  # type: ignore[return-value]
