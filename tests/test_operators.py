import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import artifacts as A
from loomery.operators import citations, cluster, contract, graph, neighbours, people, postings, ranking, summaries, topics
from loomery.plans import catalog
from loomery.plans.build import Refused, build

WORDS = {"a": "language models decode tokens grammar text corpus", "b": "robot arms control grasp motion torque planning"}


def small_records(spark, n=8):
    rows = []
    for i in range(n):
        theme = "ab"[i % 2]
        words = WORDS[theme].split()
        rows.append((f"{theme}{i}", i, "paper", " ".join(words[:3]), " ".join(words[(i // 2) % 3 :]) + f" detail{i // 4}", "X; Y" if theme == "a" else "Z; Y", theme, [theme], [theme], []))
    return spark.createDataFrame(rows, "id string, ord long, type string, title string, abstract string, authors string, category string, category_tags array<string>, area_tags array<string>, domain_tags array<string>")


@pytest.fixture(scope="module")
def vectors(spark):
    c = small_records(spark).withColumn("id", F.col("ord"))
    return graph.cut(postings.tfidf(postings.field_counts(c), 8))


def test_vectors_have_length_one(vectors):
    for r in vectors.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9


def test_packed_vectors_are_the_vectors(spark, vectors):
    c = small_records(spark).withColumn("id", F.col("ord"))
    rows, dims = postings.packed_tfidf(graph.cut(postings.field_counts(c)), 8)
    terms = sorted(r["term"] for r in vectors.select("term").distinct().collect())
    got = {(r["id"], terms[i]): round(w, 12) for r in rows.collect() for i, w in zip(r["idx"], r["w"], strict=True)}
    assert dims == len(terms) and got == {(r["id"], r["term"]): round(r["w"], 12) for r in vectors.collect()}


def test_top_terms_count_a_record_in_each_of_its_clusters(spark):
    v = spark.createDataFrame([(1, "x", 1.0), (2, "x", 0.5), (2, "y", 0.5), (3, "y", 1.0)], "id long, term string, w double")
    m = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, None)], "id long, cluster string")
    got = {(r["cluster"], r["term"]): (r["score"], r["rank"]) for r in postings.top_terms(v, m, 3, 5).collect()}
    assert got == {("a", "x"): (0.45, 1), ("a", "y"): (-0.05, 2), ("b", "x"): (0.2, 1), ("b", "y"): (0.2, 2)}


def brute_neighbours(rows, most):
    own = {}
    for r in rows:
        own.setdefault(r["id"], {})[r["term"]] = r["w"]
    out = []
    for i, x in own.items():
        scores = [(math.floor(sum(w * y.get(t, 0) for t, w in x.items()) * 1e4 + 0.5) / 1e4, j) for j, y in own.items() if j != i and sum(w * y.get(t, 0) for t, w in x.items()) > 0.02]
        out += [(i, j, s, k + 1) for k, (s, j) in enumerate(sorted(scores, key=lambda v: (-v[0], v[1]))[:most])]
    return sorted(out)


@pytest.mark.parametrize("way", ["broadcast", "shuffled", "sparse"])
def test_neighbours_agree_with_all_pairs(monkeypatch, vectors, way):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 2)
    if way == "shuffled":
        monkeypatch.setattr(neighbours, "BROADCAST", -1)
    if way == "sparse":
        monkeypatch.setattr(neighbours, "DENSE", 0)
    found = neighbours.nearest(vectors, 4).collect()
    assert all(r["id"] % 2 == r["nbr"] % 2 for r in found if r["rank"] == 1)
    assert sorted((r["id"], r["nbr"], r["score"], r["rank"]) for r in found) == brute_neighbours(vectors.collect(), 4)


def test_what_is_ranked_grows_with_the_rows_alone(monkeypatch, vectors):
    seen, own = [], neighbours.top
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 1)
    monkeypatch.setattr(neighbours, "top", lambda df, *a: seen.append(df.count()) or own(df, *a))
    assert neighbours.nearest(vectors, 1).count() == 8
    assert seen[0] <= 16  # one a row of each of two parts, however many chunks there are


def test_some_records_neighbours_are_those_among_all(spark):
    r = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, [float(x) for x in r.normal(size=5)]) for i in range(40)] + [(40, [float("nan")] * 5)], "id long, vec array<double>")
    every = sorted(neighbours.nearest_dense(rows, 3).collect())
    assert sorted(neighbours.nearest_dense(rows, 3, of=F.col("id") % 10 == 0).collect()) == [x for x in every if x["id"] % 10 == 0]
    assert {x["id"] for x in every} <= set(range(40))


def test_neighbours_of_nothing(vectors):
    assert neighbours.nearest(vectors.limit(0), 4).count() == 0


def test_clusters_part_the_themes(spark, vectors):
    rows, dims = cluster.pack(vectors, vectors.select("id", F.col("id").alias("ord")).distinct())
    rows = graph.cut(rows)
    own = cluster.assign(rows, dims, cluster.kmeans(rows, dims, 2)).collect()
    assert len({r["cluster"] for r in own if r["id"] % 2 == 0}) == 1
    assert {r["cluster"] for r in own} == {0, 1}
    again = cluster.assign(rows, dims, cluster.kmeans(rows, dims, 2)).collect()
    assert sorted(own) == sorted(again)
    xy = cluster.project(rows, dims).collect()
    assert all(-1 <= v <= 1 for r in xy for v in (r["x"], r["y"]))
    assert max(abs(r["x"]) for r in xy) == 1


def test_seeds_prefer_the_first_of_equal_rows(spark):
    e = np.eye(3)
    rows = graph.cut(cluster.from_dense(spark.createDataFrame([(i, e[i % 3].tolist()) for i in range(6)], "id long, vec array<double>")))
    assert np.allclose(cluster.seeds(rows, 3, 5), e)  # three directions, no fourth at a distance
    assert [r["cluster"] for r in cluster.assign(rows, 3, e).orderBy("id").collect()] == [0, 1, 2, 0, 1, 2]


def test_smoothing_and_levels(spark):
    own = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, cluster int")
    edges = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2)], "id long, nbr long, score double, rank int")
    assert {r["id"]: r["cluster"] for r in cluster.smooth(own, edges).collect()}[1] == 0  # one against one: its own
    assert cluster.usable_levels(8) == [2] and cluster.usable_levels(40) == [5, 10, 15, 20]
    assert cluster.label_of(["deep net", "deep", "graph"], "x") == "Deep Net Graph"
    assert cluster.label_of([], "Cluster 1") == "Cluster 1"


def test_every_embedding_is_in_every_level(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4)], 0) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.runs()["j6_cluster_levels"](spark, str(tmp_path)).collect()
    assert {r["k"] for r in got} == set(cluster.LEVELS)
    assert sorted((r["k"], r["id"]) for r in got) == [(k, i) for k in cluster.LEVELS for i in range(60)]


def test_levels_are_those_of_single_runs(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(30)]
    packed = graph.cut(cluster.from_dense(spark.createDataFrame(rows, "id long, vec array<double>")))
    made = cluster.levels(packed, 4, 30)
    assert list(made) == [5, 10, 15]
    for k, own in made.items():
        assert sorted(own.collect()) == sorted(cluster.assign(packed, 4, cluster.kmeans(packed, 4, k)).collect())


def test_topics_fit_no_worse_each_round(spark):
    c = small_records(spark, 40)
    rows, dims = cluster.pack(postings.topic_vectors(c), c.select("id", "ord"))
    weights, h, errors = topics.factorise(graph.cut(rows), dims, 4, 6)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    shares = topics.proportions(weights).collect()
    assert len(shares) == 40 and all(abs(sum(r["shares"]) - 1) < 1e-9 for r in shares)
    assert topics.topic_count(100) == 12 and topics.topic_count(10_000) == 44
    named = topics.labels(h, [f"t{i}" for i in range(dims)], {0: 3, 1: 5})
    assert [t["component"] for t in named] == [1, 0] and named[0]["id"] == "topic-1"


def test_topic_queries_ask_for_the_builds_topics(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(WORDS["ab"[i % 2]].split()[j] for j in range(7) if j != i % 7), "en", "s", 1) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen, own = [], topics.factorise

    def factorise(packed, dims, k, rounds=topics.ROUNDS, seed=42, start=None):
        seen.append((k, rounds, start is not None and start.count()))
        return own(packed, dims, k, 2, seed, start)

    monkeypatch.setattr(topics, "factorise", factorise)
    assert catalog.runs()["j10_topic_labels"](spark, str(tmp_path)).count() == 8
    assert seen == [(40, 30, 8)]


def test_components_join_everything_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert {got[i] for i in range(21)} == {0} and got[101] == 100


REFS = [("rec-a", 0, "deep nets"), ("rec-a", 1, "graphs"), ("rec-a", 2, "own a"), ("rec-b", 0, "deep nets"), ("rec-b", 1, "graphs"), ("rec-b", 2, "own b")]


def test_shared_references(spark):
    refs = spark.createDataFrame(REFS, "record_id string, pos int, key string")
    records = spark.createDataFrame([("rec-a", "Vision"), ("rec-b", "Vision"), ("rec-c", "Systems")], "record_id string, category string")
    made = citations.reference_artifacts(refs, records)
    assert [tuple(r) for r in made["edges"].collect()] == [("rec-a", "rec-b", 2, 0.6667)]
    (c,) = made["communities"].collect()
    assert (c["members"], c["max_shared"], c["category"]) == (2, 2, "Vision")
    assert [r["count"] for r in made["foundations"].collect()] == [2, 2]
    s = made["summary"].first()
    assert (s["records"], s["keys"], s["overlapping"]) == (2, 4, 2)


def test_overlaps_make_no_links_of_pairs(spark, monkeypatch):
    refs = spark.createDataFrame([(r, k, f"k{(r * 7 + k * k) % 30}") for r in range(40) for k in range(4)] + [(90, 0, "own"), (91, 0, None), (92, 0, None)], "record_id int, pos int, key string")
    records = spark.createDataFrame([(r, "x" if r % 3 else "y") for r in range(93)], "record_id int, category string")
    seen, own = [], citations.components
    monkeypatch.setattr(citations, "components", lambda edges: seen.append(edges.count()) or own(edges))
    edges = citations.overlap_edges(refs)
    both = [(r["a"], r["b"], r["shared"], r["score"]) for r in edges.collect()]
    both += [(b, a, *rest) for a, b, *rest in both]
    want = {}
    for a, b, shared, score in sorted(both, key=lambda x: (x[0], -x[3], -x[2], x[1])):
        want.setdefault(a, []).append((b, shared, score))
    got = {}
    for r in citations.neighbourhoods(refs, 3).orderBy("record_id", "rank").collect():
        got.setdefault(r["record_id"], []).append((r["other"], r["shared"], r["score"]))
    assert got == {a: x[:3] for a, x in want.items()}
    assert sum(r["edges"] for r in citations.communities(refs, records).collect()) == len(both) / 2
    assert seen[0] <= 160 < len(both) / 2  # as many links as references at most
    assert citations.summary(refs, edges).first()["overlapping"] == len(want)


def occurrences(spark, rows):
    return spark.createDataFrame([(f"{w}:{n}", w, n, "t", e) for w, n, e in rows], "occ string, work_id int, name string, topic string, email string")


def test_same_names_are_one_person_only_with_a_coauthor(spark):
    own = people.resolve(occurrences(spark, [(1, "ann", None), (1, "bob", None), (2, "ann", None), (2, "bob", None), (3, "ann", None), (3, "cy", None)]).drop("email"))
    ids = {r["occ"]: r["identity"] for r in own.collect()}
    assert ids["1:ann"] == ids["2:ann"] != ids["3:ann"]


def test_people_are_told_from_keys_not_from_every_occurrence(spark, monkeypatch):
    rows = [(w, n, None) for w in range(200) for n in ("ann", "bob", "cy")] + [(900, "ann", "a@x.org"), (901, "ann", "A@x.org"), (902, "dan", None)]
    seen, own = [], people.components
    monkeypatch.setattr(people, "components", lambda edges, *a: seen.append(edges.count()) or own(edges, *a))
    found = {r["occ"]: r["label"] for r in people.same_people(occurrences(spark, rows)).collect()}
    assert seen[0] <= 20  # the former code linked each of 600 occurrences
    assert len(found) == 602 and "902:dan" not in found
    assert {found[f"{w}:ann"] for w in range(200)} == {"0:ann"} and found["901:ann"] == "900:ann"


def test_addresses_join_and_part(spark):
    rows = [(1, "ann", "x@y.z"), (1, "bob", None), (2, "ann", "other@y.z"), (2, "bob", None), (3, "anna", "X@y.z ")]
    ids = {r["occ"]: r["identity"] for r in people.resolve(occurrences(spark, rows)).collect()}
    assert ids["1:ann"] == ids["3:anna"] != ids["2:ann"]


def test_networks_hold_everyone_with_enough_works(spark):
    own = spark.range(1500).select(F.col("id").alias("identity"), F.concat(F.lit("n"), "id").alias("name"), F.lit(2).alias("works"), F.array(F.struct(F.lit("t").alias("topic"), F.lit(2).alias("count"))).alias("topics"))
    links = spark.range(1499).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("shared"))
    nodes, inside = people.network(own.union(own.limit(1).withColumns({"identity": F.lit(-1).cast("long"), "works": F.lit(1)})), links)
    assert nodes.count() == 1500 and inside.count() == 1499
    assert people.insights(nodes, inside).first()["topic_authors"] == 1500


def test_works_take_the_paper_before_the_poster(spark):
    rows = spark.createDataFrame([("p", 0, "poster", "k"), ("a", 1, "paper", "k"), ("b", 2, "paper", "k")], "id string, ord long, type string, work_key string")
    (r,) = ranking.first_works(rows).collect()
    assert (r["id"], r["place"]) == ("a", 0)


def test_sentences_and_trail(spark):
    m = spark.createDataFrame([(1, 1, 0, "x", "A survey of practical control. Practical control of arms is old."), (2, 2, 0, "x", "Practical control of arms is old. More words about nothing at all.")], "id long, ord long, cluster int, area string, abstract string")
    words = spark.createDataFrame([(0, ["control", "practical"])], "cluster int, terms array<string>")
    got = [r["sentence"] for r in summaries.sentences(m, words).orderBy("rank").collect()]
    assert got == ["Practical control of arms is old."]
    none = spark.createDataFrame([], "id long, nbr long, score double, rank int")
    assert {(r["id"], r["other"]) for r in summaries.trail(m, none, "survey", "practical").collect()} == {(1, 2), (2, 1)}
    assert summaries.outliers(m, none).count() == 2


def test_every_contract_rule_fires_once(spark):
    ids = spark.createDataFrame([("a",), ("a",)], "id string")
    known = spark.createDataFrame([("a",)], "id string")
    refs = spark.createDataFrame([("a",), ("z",)], "nbr string")
    nums = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "id string, x double")
    vecs = spark.createDataFrame([("a", [1]), ("b", [1, 2])], "id string, v array<int>")
    mail = spark.createDataFrame([("a", "no"), ("b", "me@x.org")], "id string, t string")
    levels = spark.createDataFrame([(5, "a"), (5, "a")], "k int, id string")
    all_ = contract.all_of(contract.unique_ids(ids, "r"), contract.known_ids(refs, "r", "nbr", known), contract.finite(nums, "r", "x"), contract.same_length(vecs, "r", "v"), contract.no_email(mail, "r"), contract.level_sizes(levels, ids.distinct()))
    assert sorted(r["rule"] for r in all_.collect()) == ["finite x", "known nbr", "length of v", "level", "no email", "unique id"]


def test_fingerprints_ignore_order_and_see_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    assert A.fingerprint(a) == A.fingerprint(a.orderBy(F.desc("i")))
    assert A.fingerprint(a) != A.fingerprint(a.distinct())


def test_pins_show_a_changed_table(spark, tmp_path):
    path = str(tmp_path / "out")
    t = spark.createDataFrame([(1, "x")], "i int, s string")
    A.publish({"t": t, "empty": t.limit(0)}, path)
    assert A.read(spark, path, "t").collect() == t.collect() and A.read(spark, path, "empty").count() == 0
    assert A.broken(spark, path) == []
    t.withColumn("s", F.lit("z")).write.mode("overwrite").parquet(f"{path}/t")
    assert A.broken(spark, path) == ["t"]
    with pytest.raises(A.BrokenPin):
        A.read(spark, path, "t")


def test_the_build_publishes_tables_without_violations(spark, tmp_path):
    records = small_records(spark)
    refs = spark.createDataFrame([("a0", 0, "k"), ("b1", 0, "k")], "record_id string, pos int, key string")
    path = str(tmp_path / "site")
    entries = build(records, refs, path)
    assert entries["records"]["rows"] == 8
    assert entries["people_authors"]["rows"] > 0 and entries["overlaps"]["rows"] == 1
    assert A.broken(spark, path) == []
    calls = []
    A.warm(spark, path, "k", lambda: calls.append(1) or records.select("id"))
    A.warm(spark, path, "k", lambda: calls.append(1) or records.select("id"))
    assert calls == [1]


@pytest.mark.parametrize("fault", ["address among the authors", "repeated id"])
def test_the_build_refuses_what_breaks_the_contract(spark, tmp_path, fault):
    records = small_records(spark)
    if fault == "repeated id":
        records = records.withColumn("id", F.when(F.col("ord") == 3, "a2").otherwise(F.col("id")))
    else:
        records = records.withColumn("authors", F.when(F.col("ord") == 1, "X; Jo jo@example.org").otherwise(F.col("authors")))
    refs = spark.createDataFrame([("a0", 0, "k"), ("b1", 0, "k")], "record_id string, pos int, key string")
    path = str(tmp_path / "site")
    with pytest.raises(Refused, match="no email|unique id"):
        build(records, refs, path)
    assert not A.exists(spark, f"{path}/{A.MANIFEST}")


def test_tampering_with_shards_is_seen(spark, tmp_path):
    path, rows = str(tmp_path / "site"), small_records(spark).select("id", "type")
    A.publish({"records": rows}, path, {"records": "type"})
    assert contract.shards(spark, path, "records", rows).count() == 0
    assert {(r["rule"], r["detail"]) for r in contract.shards(spark, path, "records", rows.where("id <> 'a0'")).collect()} == {("known id", "a0")}
    rows.where("id <> 'b1'").write.mode("overwrite").partitionBy("type").parquet(f"{path}/records")
    assert {(r["rule"], r["detail"]) for r in contract.shards(spark, path, "records", rows).collect()} == {("id in no shard", "b1"), ("pin", "records")}


def test_shared_pairs_of_a_hot_key_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 5)
    members = spark.createDataFrame([(k, n) for k in range(4) for n in range(12 if k == 0 else k + 2)] + [(0, 3)], "key int, node int")
    got = {(r["a"], r["b"]): r["shared"] for r in graph.shared_pairs(members, "key", "node").collect()}
    want = {}
    for k in range(4):
        own = range(12 if k == 0 else k + 2)
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_topics_have_labels():
    h = np.array([[0.1, 0.9, 0.5], [0.7, 0.0, 0.2]])
    made = topics.labels(h, ["alpha", "beta", "gamma"], {0: 3, 1: 5})
    assert [(t["id"], t["component"], t["size"]) for t in made] == [("topic-1", 1, 5), ("topic-2", 0, 3)] and made[1]["label"].split()[0] == "Beta"


def test_new_files_are_those_of_other_bytes(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, sha256 string")
    assert [r["file"] for r in A.new_files(files, files.limit(1)).collect()] == ["b"]
