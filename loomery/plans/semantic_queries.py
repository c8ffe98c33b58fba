"""Queries of postings, neighbours, searches, clusters, topics and summaries."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import cluster as K
from loomery.operators import graph as G
from loomery.operators import neighbours as N
from loomery.operators import postings as P
from loomery.operators import summaries as S
from loomery.operators import topics as O
from loomery.operators.ranking import content_fingerprint, numbered, top
from loomery.plans.registry import query as q
from loomery.functions.text import APPLIED, INTRO
from loomery.plans.scalar_queries import sql_bigrams, sql_fnv, sql_search, sql_tokens
from loomery.sources.views import CORPUS, DENSE, corpus, dense, table, with_views

C = F.col
_TAGS = "category_tags[1] || ' ' || area_tags[1]"
_POST = f"toks AS (SELECT ord AS id, {sql_tokens('title')} AS tt, {sql_tokens('abstract')} AS ta, {sql_tokens(_TAGS)} AS tg FROM corpus), post AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM (SELECT id, unnest({sql_bigrams('tt')}) AS term, 2.2 AS w FROM toks UNION ALL SELECT id, unnest({sql_bigrams('ta')}), 1.0 FROM toks UNION ALL SELECT id, unnest({sql_bigrams('tg')}), 0.8 FROM toks) WHERE term IS NOT NULL GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM corpus), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"
_VECS = _POST + ", raw AS (SELECT id, term, (1 + ln(tf)) * (ln((n + 1.0) / (df + 1)) + 1) AS w FROM post JOIN df USING (term), n WHERE df >= 2), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), vecs AS (SELECT id, term, w / norm AS w FROM raw JOIN norms USING (id))"
_KNN = "knn AS (SELECT id, nbr, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, nbr)::INTEGER AS rank FROM (SELECT a.id, b.id AS nbr, round(sum(a.w * b.w), 4) AS score FROM vecs a JOIN vecs b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) > 0.02) QUALIFY rank <= 12)"
#: Edges of the dense view: the twelve nearest by cosine.
_DEDGES = "u AS (SELECT id, cluster, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS v FROM dense), edges AS (SELECT id, nbr, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, nbr)::INTEGER AS rank FROM (SELECT a.id, b.id AS nbr, round(list_dot_product(a.v, b.v), 4) AS score FROM u a JOIN u b ON a.id <> b.id WHERE list_dot_product(a.v, b.v) > 0.02) QUALIFY rank <= 12)"


def records(spark, sf_dir):
    """The corpus with its order as id."""
    return corpus(spark, sf_dir).withColumn("id", C("ord"))


def vectors(spark, sf_dir):
    c = records(spark, sf_dir)
    return P.tfidf(G.cut(P.field_counts(c)), c.count())


def nearest_records(spark, sf_dir):
    c = records(spark, sf_dir)
    return N.nearest_rows(*P.packed_tfidf(G.cut(P.field_counts(c)), c.count()))


def dense_long(spark, sf_dir):
    return P.unit(dense(spark, sf_dir).select("id", F.posexplode("vec").alias("term", "w")))


def dense_edges(spark, sf_dir, of=None):
    """The nearest of each record of the dense view, or of those that are asked for."""
    return G.cut(N.nearest_dense(dense(spark, sf_dir), of=of))


def dense_edges_around(spark, sf_dir, root):
    """Those of a record and of its neighbours."""
    own = dense_edges(spark, sf_dir, C("id") == root)
    near = [r["nbr"] for r in own.select("nbr").collect()]  # twelve at most
    return own.union(dense_edges(spark, sf_dir, C("id").isin(near)))


def members(spark, sf_dir):
    """The dense view as clustered records: its labels as clusters, ids as their order, some made-up columns."""
    d = dense(spark, sf_dir)
    text = F.concat(F.lit("This survey of part "), C("id"), F.lit(" applies practical methods to label "), C("cluster"), F.lit(". A second sentence tells more about vector "), C("id") % 7, F.lit(" of it."))
    return d.select("id", C("id").alias("ord"), "cluster", F.concat(F.lit("area "), C("id") % 4).alias("area"), F.when(C("id") % 3 == 0, text).otherwise(F.concat(F.lit("Plain words on label "), C("cluster"), F.lit(" and nothing else here."))).alias("abstract"))


_MEMBERS = "members AS (SELECT id, id AS ord, cluster, 'area ' || (id % 4) AS area, CASE WHEN id % 3 = 0 THEN 'This survey of part ' || id || ' applies practical methods to label ' || cluster || '. A second sentence tells more about vector ' || (id % 7) || ' of it.' ELSE 'Plain words on label ' || cluster || ' and nothing else here.' END AS abstract FROM dense)"
_CENTRAL = "central AS (SELECT m.*, coalesce(c, 0) AS centrality FROM members m LEFT JOIN (SELECT id, round(avg(score), 6) AS c FROM edges GROUP BY 1) USING (id))"


@q("f2_weighted_term_counts", f"{with_views(CORPUS, _POST)} SELECT id, term, round(tf, 6) AS tf FROM post")
def f2(spark, sf_dir):
    return P.field_counts(records(spark, sf_dir)).select("id", "term", F.round("tf", 6).alias("tf"))


@q("f3_document_frequency", f"{with_views(CORPUS, _POST)} SELECT term, df FROM df")
def f3(spark, sf_dir):
    return P.document_frequency(P.field_counts(records(spark, sf_dir)))


@q("f4_vector_norms", f"{with_views(CORPUS, _VECS)} SELECT id, round(norm, 6) AS norm FROM norms")
def f4(spark, sf_dir):
    c = records(spark, sf_dir)
    counts, n = G.cut(P.field_counts(c)), c.count()
    df = P.document_frequency(counts).where(C("df") >= 2)
    raw = counts.join(df, "term").select("id", ((1 + F.log("tf")) * (F.log((F.lit(n) + 1.0) / (C("df") + 1)) + 1)).alias("w"))
    return raw.groupBy("id").agg(F.round(F.sqrt(F.sum(C("w") * C("w"))), 6).alias("norm"))


@q("f5_mean_vectors", f"{with_views(DENSE)}, t AS (SELECT cluster, generate_subscripts(vec, 1) - 1 AS term, unnest(vec) AS w FROM dense), s AS (SELECT cluster, count(*) AS n FROM dense GROUP BY 1) SELECT cluster, term::INTEGER AS term, round(sum(w) / any_value(n), 6) AS mean FROM t JOIN s USING (cluster) GROUP BY 1, 2")
def f5(spark, sf_dir):
    d = dense(spark, sf_dir)
    sizes = d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return d.select("cluster", F.posexplode("vec").alias("term", "w")).groupBy("cluster", "term").agg(F.sum("w").alias("s")).join(sizes, "cluster").select("cluster", "term", F.round(C("s") / C("n"), 6).alias("mean"))


@q("d10_vocabulary_pruning", f"{with_views(CORPUS, _POST)} SELECT count(*) AS kept, sum(df)::BIGINT AS postings FROM df, n WHERE df >= 2 AND df BETWEEN greatest(2, ceil(0.003 * n)) AND floor(0.4 * n)")
def d10(spark, sf_dir):
    c = records(spark, sf_dir)
    n = c.count()
    df = P.document_frequency(P.field_counts(c)).where(C("df").between(max(2, -(-3 * n // 1000)), int(0.4 * n)))
    return df.agg(F.count(F.lit(1)).alias("kept"), F.sum("df").alias("postings"))


@q("j1_tfidf_vectors", f"{with_views(CORPUS, _VECS)} SELECT id, term, round(w, 6) AS w FROM vecs")
def j1(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "term", F.round("w", 6).alias("w"))


@q("j2_nearest_neighbours", f"{with_views(CORPUS, _VECS, _KNN)} SELECT * FROM knn")
def j2(spark, sf_dir):
    return nearest_records(spark, sf_dir)


@q("e3_knn_join", f"{with_views(DENSE, _DEDGES)} SELECT id, nbr, score, rank FROM edges")
def e3(spark, sf_dir):
    return N.nearest_dense(dense(spark, sf_dir))


@q("g1_top_neighbours", f"{with_views(DENSE, _DEDGES)} SELECT id, nbr FROM edges WHERE rank = 1")
def g1(spark, sf_dir):
    return N.nearest_dense(dense(spark, sf_dir), most=1).select("id", "nbr")


_SEEDS = "cent AS (SELECT id AS cluster, v FROM u WHERE id < 10)"


@q("j3_kmeans_assign_step", f"{with_views(DENSE, _DEDGES, _SEEDS)} SELECT u.id, cent.cluster, round(list_dot_product(u.v, cent.v), 6) AS dot FROM u, cent QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY dot DESC, cent.cluster) = 1")
def j3(spark, sf_dir):
    v = dense_long(spark, sf_dir)
    cent = v.where(C("id") < 10).select(C("id").alias("cluster"), "term", C("w").alias("v"))
    return K.assign_step(v, cent)


@q("j3_kmeans")
def j3_full(spark, sf_dir):
    rows = G.cut(K.from_dense(dense(spark, sf_dir)))
    return K.assign(rows, 64, K.kmeans(rows, 64, 5))


@q("j4_smooth_assignments", f"{with_views(DENSE, _DEDGES)}, votes AS (SELECT id, cluster, 1.0 AS vote, 0 AS place FROM dense UNION ALL SELECT edges.id, dense.cluster, 0.5, rank FROM edges JOIN dense ON nbr = dense.id) SELECT id, cluster FROM votes GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sum(vote) DESC, min(place)) = 1")
def j4(spark, sf_dir):
    return K.smooth(dense(spark, sf_dir).select("id", "cluster"), dense_edges(spark, sf_dir))


@q("j5_cluster_ids", f"{with_views(DENSE)} SELECT cluster, 'c' || row_number() OVER (ORDER BY cluster) AS cluster_id, count(*) AS size FROM dense GROUP BY 1")
def j5(spark, sf_dir):
    return K.cluster_ids(dense(spark, sf_dir))




@q("g4_top_terms", f"{with_views(CORPUS, _VECS)}, m AS (SELECT ord AS id, area_tags[1] AS cluster FROM corpus), base AS (SELECT term, sum(w) / max(n) AS base FROM vecs, n GROUP BY 1), sz AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1), own AS (SELECT cluster, term, sum(w) AS s FROM vecs JOIN m USING (id) GROUP BY 1, 2) SELECT cluster, term, round(s / size - 0.6 * base, 6) AS score, row_number() OVER (PARTITION BY cluster ORDER BY round(s / size - 0.6 * base, 6) DESC, term)::INTEGER AS rank FROM own JOIN sz USING (cluster) JOIN base USING (term) QUALIFY rank <= 5")
def g4(spark, sf_dir):
    c = records(spark, sf_dir)
    return P.top_terms(vectors(spark, sf_dir), c.select("id", C("area_tags")[0].alias("cluster")), c.count())


@q("j6_cluster_levels")
def j6(spark, sf_dir):
    rows = G.cut(K.from_dense(dense(spark, sf_dir)))
    made = K.levels(rows, 64, rows.count())
    out = None
    for k, own in made.items():
        part = own.select(F.lit(k).alias("k"), "id", "cluster")
        out = part if out is None else out.unionAll(part)
    return out


@q("j7_primary_level", "WITH s AS (SELECT m AS k, c_custkey % m AS cluster, count(*) AS size FROM customer, (VALUES (5), (30), (600)) t(m) GROUP BY 1, 2), l AS (SELECT k, min(size) AS least FROM s GROUP BY 1) SELECT coalesce(min(k) FILTER (least >= 3), max(k) FILTER (least >= 2), min(k))::INTEGER AS k FROM l")
def j7(spark, sf_dir):
    levels = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(5), F.lit(30), F.lit(600))).alias("k"))
    return K.primary_level(levels.groupBy("k", (C("c_custkey") % C("k")).alias("cluster")).agg(F.count(F.lit(1)).alias("size")))


@q("j8_project_2d")
def j8(spark, sf_dir):
    return K.project(G.cut(K.from_dense(dense(spark, sf_dir))), 64)


_TOPIC = f"tt AS (SELECT ord AS id, {sql_tokens('title')} AS a, {sql_tokens('abstract')} AS b, {sql_tokens('category')} AS c FROM corpus), tp AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM (SELECT id, unnest(a) AS term, 2.2 AS w FROM tt UNION ALL SELECT id, unnest(b), 1.0 FROM tt UNION ALL SELECT id, unnest(c), 0.8 FROM tt) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM corpus), td AS (SELECT term, count(*) AS df FROM tp GROUP BY 1), kept AS (SELECT term, df FROM td, n WHERE df BETWEEN greatest(2, ceil(0.003 * n)) AND floor(0.4 * n) ORDER BY df DESC, term LIMIT 6000), tr AS (SELECT id, term, (1 + ln(tf)) * ln((n + 1.0) / (df + 1)) + 1 AS w FROM tp JOIN kept USING (term), n), tn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM tr GROUP BY 1)"


@q("j9a_topic_vectors", f"{with_views(CORPUS, _TOPIC)} SELECT id, term, round(w / norm, 6) AS w FROM tr JOIN tn USING (id)")
def j9a(spark, sf_dir):
    return P.topic_vectors(records(spark, sf_dir)).select("id", "term", F.round("w", 6).alias("w"))


def _primary(spark, sf_dir):
    """id, cluster of the primary level, made as the build does."""
    c, vecs = records(spark, sf_dir), G.cut(vectors(spark, sf_dir))
    rows, dims = K.pack(vecs, c.select("id", "ord"))
    made = K.levels(G.cut(rows), max(1, dims), c.count(), G.cut(N.nearest(vecs)))
    parts = [own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).select(F.lit(k).alias("k"), "cluster", "size") for k, own in made.items()]
    return made[K.primary_level(functools.reduce(DataFrame.unionAll, parts)).first()["k"]]


def _topics(spark, sf_dir):
    """As many topics as the build asks for, begun from the clusters of the primary level."""
    c, start = records(spark, sf_dir), _primary(spark, sf_dir)
    rows, dims = K.pack(G.cut(P.topic_vectors(c)), c.select("id", "ord"))
    k = max(O.TOPICS, start.select("cluster").distinct().count())
    return O.factorise(G.cut(rows), dims, k, start=start)


@q("j9_nmf_topics")
def j9(spark, sf_dir):
    return O.proportions(_topics(spark, sf_dir)[0]).groupBy("topic").agg(F.count(F.lit(1)).alias("size"))


@q("j10_topic_labels")
def j10(spark, sf_dir):
    """Each record's topic and secondary topic, with the labels and sizes of the topics."""
    weights, h, _ = _topics(spark, sf_dir)
    shares = G.cut(O.proportions(weights).select("id", "topic", "secondary"))
    sizes = {r["topic"]: r["count"] for r in shares.groupBy("topic").count().collect()}  # a row a topic
    terms = [r["term"] for r in P.topic_vectors(records(spark, sf_dir)).select("term").distinct().orderBy("term").collect()]  # 6000 at most
    named = [(t["component"], t["id"], t["label"], t["size"]) for t in O.labels(h, terms, sizes)]
    labels = spark.createDataFrame(named, "topic int, topic_id string, label string, size long")
    return shares.join(F.broadcast(labels), "topic").select("id", "topic_id", "label", "size", "secondary")


@q("j9d_topic_display", f"{with_views(CORPUS)}, w AS (SELECT ord, generate_subscripts(r, 1) AS i, unnest(r) AS word FROM (SELECT ord, regexp_extract_all(lower(title || ' ' || coalesce(abstract, '')), '[a-z0-9][a-z0-9+\\-]+') AS r FROM corpus)), f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(word, '^[-+]+|[-+]+$', '', 'g'), 'ies$', 'y'), '(ing|ers|er|ed|s)$', '') AS term FROM w) SELECT term, arg_min(word, ord * 1000000 + i) AS display FROM f WHERE length(term) > 2 AND NOT list_contains({T.STOP_WORDS!r}, term) GROUP BY 1")
def j9d(spark, sf_dir):
    return P.display_forms(records(spark, sf_dir), T.topic_text(F.concat_ws(" ", "title", "abstract")))


@q("j11_concept_scores", f"{with_views(CORPUS)}, toks AS (SELECT ord AS id, {sql_tokens('title')} AS t, {sql_tokens('abstract')} AS a FROM corpus), bg AS (SELECT id, {sql_bigrams('t')} AS t, {sql_bigrams('a')} AS a FROM toks), sc AS (SELECT id, phrase, sum(w)::DOUBLE AS s FROM (SELECT id, unnest(t) AS phrase, 2.0 AS w FROM bg UNION ALL SELECT id, phrase, CASE WHEN list_contains(t, phrase) THEN 1.4 ELSE 0.6 END FROM (SELECT id, t, unnest(a) AS phrase FROM bg)) GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM corpus), df AS (SELECT phrase, count(*) AS df FROM sc GROUP BY 1) SELECT id, phrase, round(s * ln(1 + n / df), 6) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(s * ln(1 + n / df), 6) DESC, phrase)::INTEGER AS rank FROM sc JOIN df USING (phrase), n WHERE df <= 0.6 * n QUALIFY rank <= 9")
def j11(spark, sf_dir):
    scored = P.concept_scores(records(spark, sf_dir)).select("id", "phrase", F.round("weight", 6).alias("weight"))
    return top(scored, ["id"], [F.desc("weight"), F.asc("phrase")], 9)


def _hashed(text: str, frm: str, id_: str, name: str) -> str:
    toks = f"{name}_t AS (SELECT {id_} AS id, {sql_tokens(text, T.SEARCH_STOP_WORDS)} AS ts FROM {frm}), {name}_c AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({sql_bigrams('ts')}) AS token FROM {name}_t) GROUP BY 1, 2)"
    h = f"{name}_h AS (SELECT id, {sql_fnv('token')} AS h, CASE WHEN contains(token, '_') THEN 0.58 ELSE 1 END * (1 + ln(1 + n) + CASE WHEN length(token) > 8 THEN 0.25 ELSE 0 END) AS w FROM {name}_c WHERE token IS NOT NULL)"
    return toks + f", {h}, {name}_s AS (SELECT id, (h % 512)::BIGINT AS term, sum(CASE WHEN (h & 65536) = 0 THEN w ELSE -w END)::DOUBLE AS w FROM {name}_h GROUP BY 1, 2), {name}_n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_s GROUP BY 1), {name} AS (SELECT id, term, w / norm AS w FROM {name}_s JOIN {name}_n USING (id))"


_HDOCS = _hashed("title || ' ' || abstract", "corpus", "ord", "hd")
_HQ = _hashed("text", "benchmark", "item_id", "hq")


def hashed_docs(spark, sf_dir):
    return G.cut(P.hashed_vectors(corpus(spark, sf_dir).select(C("ord").alias("id"), F.concat_ws(" ", "title", "abstract").alias("text"))))


def hashed_queries(spark, sf_dir):
    return P.hashed_vectors(table(spark, sf_dir, "benchmark").select(C("item_id").alias("id"), "text"))


@q("j12_hashed_vectors", f"{with_views(CORPUS, _HDOCS)} SELECT id, term, round(w, 6) + 0.0 AS w FROM hd")
def j12(spark, sf_dir):
    return hashed_docs(spark, sf_dir).select("id", "term", (F.round("w", 6) + 0.0).alias("w"))  # no negative zeros


@q("j13_quantise", f"{with_views(CORPUS, _HDOCS)} SELECT id, sum(trunc(round(w * 127, 9)))::BIGINT AS total, sum((trunc(round(w * 127, 9)) <> 0)::INT)::BIGINT AS cells FROM hd GROUP BY 1")
def j13(spark, sf_dir):
    v = P.quantised(hashed_docs(spark, sf_dir).withColumn("w", F.round(C("w") * 127, 9) / 127))
    return v.select("id", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("vec", lambda x: x != 0)).cast("long").alias("cells"))


@q("b7_search_index", f"{with_views(CORPUS, _HDOCS)}, m AS (SELECT id, map_from_entries(list((term, trunc(round(w * 127, 9))::INTEGER))) AS m FROM hd GROUP BY 1) SELECT id, 512 AS dims, array_to_string(list_transform(range(512), lambda i: coalesce(m[i], 0)), ',') AS vec FROM m")
def b7(spark, sf_dir):
    v = P.quantised(hashed_docs(spark, sf_dir).withColumn("w", F.round(C("w") * 127, 9) / 127))
    return v.select("id", F.size("vec").alias("dims"), F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"))


@q("j14_import_quantise", f"{with_views(DENSE, _DEDGES)} SELECT id, array_to_string(list_transform(v, lambda x: greatest(-127, least(127, floor(x * 127 + 0.5)))::INTEGER), ',') AS vec FROM u")
def j14(spark, sf_dir):
    return dense(spark, sf_dir).select("id", F.array_join(P.imported(C("vec")).cast("array<string>"), ",").alias("vec"))


@q("a13_import_embeddings", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, min(len(embedding))::INTEGER AS least, max(len(embedding))::INTEGER AS most FROM embeddings")
def a13(spark, sf_dir):
    return dense(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"))


_LEX = "lex AS (SELECT hq.id AS query, hd.id, sum(hq.w * hd.w) AS s FROM hd JOIN hq USING (term) GROUP BY 1, 2 HAVING sum(hq.w * hd.w) >= 0.045), res AS (SELECT query, id, round(s, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY round(s, 4) DESC, id)::INTEGER AS rank FROM lex QUALIFY rank <= 260)"


@q("j15_lexical_search", f"{with_views(CORPUS, _HDOCS, _HQ, _LEX)} SELECT query, id, score, rank FROM res")
def j15(spark, sf_dir):
    return N.sparse_search(hashed_queries(spark, sf_dir), hashed_docs(spark, sf_dir))


_Q8 = "qd AS (SELECT id, list_transform(v, lambda x: greatest(-127, least(127, floor(x * 127 + 0.5)))) AS d, v FROM u)"
_DRES = "ds AS (SELECT a.id AS query, b.id, list_dot_product(a.v, b.d) / 127 AS s FROM qd a, qd b WHERE a.id % 50 = 0), dres AS (SELECT query, id, round(s, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY round(s, 4) DESC, id)::INTEGER AS rank FROM ds WHERE s >= 0.12 QUALIFY rank <= 260)"


def _dense_parts(spark, sf_dir):
    d = dense(spark, sf_dir)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    queries = d.where(C("id") % 50 == 0).select("id", F.transform("vec", lambda x: x / norm).alias("vec"))
    return queries, d.select("id", P.imported(C("vec")).alias("vec"))


@q("j16_dense_search", f"{with_views(DENSE, _DEDGES, _Q8, _DRES)} SELECT query, id, score, rank FROM dres")
def j16(spark, sf_dir):
    return N.dense_search(*_dense_parts(spark, sf_dir))


@q("j17_semantic_dispatch", f"{with_views(CORPUS, _HDOCS, _HQ, _LEX, DENSE, _DEDGES, _Q8, _DRES)} SELECT 'dense' AS source, query, count(*) AS n FROM dres GROUP BY 1, 2 UNION ALL SELECT 'lexical', query, count(*) FROM res WHERE query NOT IN (SELECT query FROM dres) GROUP BY 1, 2")
def j17(spark, sf_dir):
    dq, dd = _dense_parts(spark, sf_dir)
    found = N.semantic_search(hashed_queries(spark, sf_dir), hashed_docs(spark, sf_dir), dq, dd)
    return found.groupBy("source", "query").agg(F.count(F.lit(1)).alias("n"))


_HAY = f"hay AS (SELECT ord AS id, concat_ws(' ', {sql_search('title')}, {sql_search('abstract')}) AS hay, {sql_search('title')} AS t FROM corpus)"


def _hay(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.concat_ws(" ", T.search_normal(C("title")), T.search_normal(C("abstract"))).alias("hay"), T.search_normal(C("title")).alias("title_norm"))


@q("j18_map_search", f"{with_views(CORPUS, _VECS, _KNN, _HAY)}, s AS (SELECT id FROM hay WHERE contains(hay, 'the of and')) SELECT id FROM s UNION SELECT nbr FROM knn WHERE id IN (SELECT id FROM s) AND rank <= 10")
def j18(spark, sf_dir):
    seeds = _hay(spark, sf_dir).where(F.contains("hay", F.lit("the of and"))).select("id")
    near = nearest_records(spark, sf_dir).where(C("rank") <= 10).join(seeds, "id", "left_semi").select(C("nbr").alias("id"))
    return seeds.union(near).distinct()


@q("e16_keyword_neighbours", f"{with_views(DENSE, _DEDGES)} SELECT id, nbr, rank FROM edges WHERE id % 11 = 0 AND rank <= 10")
def e16(spark, sf_dir):
    return dense_edges(spark, sf_dir, C("id") % 11 == 0).where(C("rank") <= 10).select("id", "nbr", "rank")


@q("f21_search_summary", f"{with_views(DENSE, _DEDGES)}, s AS (SELECT id FROM dense WHERE id % 11 = 0), x AS (SELECT DISTINCT nbr FROM edges WHERE id IN (SELECT id FROM s) AND rank <= 10) SELECT (SELECT count(*) FROM s) AS seeds, (SELECT count(*) FROM x WHERE nbr NOT IN (SELECT id FROM s)) AS semantic")
def f21(spark, sf_dir):
    seeds = dense(spark, sf_dir).where(C("id") % 11 == 0).select("id")
    near = dense_edges(spark, sf_dir, C("id") % 11 == 0).where(C("rank") <= 10).select(C("nbr").alias("id")).distinct().join(seeds, "id", "left_anti")
    return seeds.agg(F.count(F.lit(1)).alias("seeds")).join(F.broadcast(near.agg(F.count(F.lit(1)).alias("semantic"))))


@q("j19_keyword_search", f"{with_views(CORPUS, _HAY)} SELECT id, round(CASE WHEN contains(t, 'and') THEN 3 ELSE 0 END + least(2, 120.0 * 3 / greatest(1, length(hay)))::DOUBLE, 6) AS score FROM hay WHERE contains(hay, 'and')")
def j19(spark, sf_dir):
    return N.keyword_scores(_hay(spark, sf_dir), "and").select("id", "score")


@q("c51_client_vectors", f"{with_views(_HQ)} SELECT id AS query, term, round(w, 6) + 0.0 AS w FROM hq")
def c51(spark, sf_dir):
    """Queries go through the tokens, hashes and lengths that documents went through."""
    return hashed_queries(spark, sf_dir).select(C("id").alias("query"), "term", (F.round("w", 6) + 0.0).alias("w"))


# graph views of the neighbours

@q("e12_neighbour_records", f"{with_views(DENSE, _DEDGES)} SELECT edges.id, nbr, dense.cluster, rank FROM edges JOIN dense ON nbr = dense.id WHERE rank <= 8")
def e12(spark, sf_dir):
    names = dense(spark, sf_dir).select(C("id").alias("nbr"), "cluster")
    return dense_edges(spark, sf_dir).where(C("rank") <= 8).join(names, "nbr").select("id", "nbr", "cluster", "rank")


@q("e13_bridge_records", f"{with_views(DENSE, _DEDGES)} SELECT nbr FROM edges WHERE id = 3 INTERSECT SELECT nbr FROM edges WHERE id = (SELECT nbr FROM edges WHERE id = 3 AND rank = 1)")
def e13(spark, sf_dir):
    e = dense_edges_around(spark, sf_dir, 3)
    other = e.where((C("id") == 3) & (C("rank") == 1)).select(C("nbr").alias("id"))
    return e.where(C("id") == 3).select("nbr").intersect(e.join(other, "id", "left_semi").select("nbr"))


@q("e18_topic_lens", f"{with_views(DENSE, _MEMBERS)} SELECT m.id, l.area FROM members m JOIN (SELECT cluster, area FROM members GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(ord)) = 1) l USING (cluster)")
def e18(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.select("id", "cluster").join(S.lenses(m, m), "cluster").select("id", "area")


@q("k13_ego_graph", f"{with_views(DENSE, _DEDGES)}, f AS (SELECT nbr AS id FROM edges WHERE id = 7 AND rank <= 10), g AS (SELECT DISTINCT nbr AS id FROM edges WHERE id IN (SELECT id FROM f) AND rank <= 4 AND nbr <> 7) SELECT id, min(depth)::INTEGER AS depth FROM (SELECT 7 AS id, 0 AS depth UNION ALL SELECT id, 1 FROM f UNION ALL SELECT id, 2 FROM g) GROUP BY 1")
def k13(spark, sf_dir):
    return G.ego(dense_edges_around(spark, sf_dir, 7), 7)


@q("k14_focus_depth", f"{with_views(DENSE, _DEDGES)}, f AS (SELECT nbr AS id FROM edges WHERE id = 7), g AS (SELECT nbr AS id FROM edges WHERE id IN (SELECT id FROM f)) SELECT id, CASE WHEN id = 7 THEN 0 WHEN id IN (SELECT id FROM f) THEN 1 WHEN id IN (SELECT id FROM g) THEN 2 ELSE 3 END AS depth FROM dense")
def k14(spark, sf_dir):
    return G.focus_depth(dense(spark, sf_dir), dense_edges_around(spark, sf_dir, 7), 7)


@q("k15_graph_links", f"{with_views(DENSE, _DEDGES)} SELECT least(id, nbr) AS a, greatest(id, nbr) AS b, max(score) AS score FROM edges WHERE rank <= 2 GROUP BY 1, 2")
def k15(spark, sf_dir):
    return G.undirected(dense_edges(spark, sf_dir).where(C("rank") <= 2))


@q("k16_record_neighbourhood", f"{with_views(DENSE, _DEDGES)} SELECT nbr AS id, rank, round(greatest(0.08, least(1, (score - min(score) OVER ()) / greatest(0.001, max(score) OVER () - min(score) OVER ()))), 6) AS strength FROM edges WHERE id = 7 AND rank <= 10")
def k16(spark, sf_dir):
    near = dense_edges(spark, sf_dir, C("id") == 7).where(C("rank") <= 10)
    low = near.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    v = (C("score") - C("lo")) / F.greatest(F.lit(0.001), C("hi") - C("lo"))
    return near.join(F.broadcast(low)).select(C("nbr").alias("id"), "rank", F.round(F.greatest(F.lit(0.08), F.least(F.lit(1.0), v)), 6).alias("strength"))


@q("k17_nearest_point", f"{with_views(DENSE)} SELECT id FROM dense ORDER BY round((vec[1] - 0.05) ** 2 + (vec[2] + 0.05) ** 2, 9), id LIMIT 1")
def k17(spark, sf_dir):
    d = F.round(F.pow(C("vec")[0] - 0.05, 2) + F.pow(C("vec")[1] + 0.05, 2), 9)
    return dense(spark, sf_dir).orderBy(d, "id").limit(1).select("id")


@q("k19_selected_neighbours", f"{with_views(DENSE, _DEDGES)} SELECT nbr FROM edges WHERE id = 11 AND rank <= 12")
def k19(spark, sf_dir):
    return dense_edges(spark, sf_dir, C("id") == 11).where(C("rank") <= 12).select("nbr")


# summaries

@q("f17_centrality", f"{with_views(DENSE, _DEDGES)} SELECT d.id, coalesce(round(avg(score), 6), 0) AS centrality, coalesce(round(sum(score), 6), 0) AS total FROM dense d LEFT JOIN edges USING (id) GROUP BY 1")
def f17(spark, sf_dir):
    d, e = dense(spark, sf_dir), dense_edges(spark, sf_dir)
    return S.centrality(d, e).join(S.centrality(d, e, "sum").withColumnRenamed("centrality", "total"), "id")


@q("g5_representative_sentences", f"{with_views(DENSE, _MEMBERS)}, x AS (SELECT cluster, ord, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS sentence FROM (SELECT cluster, ord, string_split(regexp_replace(abstract, '([.!?]) ([A-Z0-9])', '\\1␞\\2', 'g'), '␞') AS ss FROM members)), h AS (SELECT *, lower(substr(sentence, 1, 60)) AS start, (contains(lower(sentence), 'survey'))::INT + (contains(lower(sentence), 'second'))::INT AS hits FROM x WHERE length(sentence) > 30 AND length(sentence) < 600), f AS (SELECT * FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY cluster, start ORDER BY hits DESC, ord, i) = 1) SELECT cluster, sentence, hits, row_number() OVER (PARTITION BY cluster ORDER BY hits DESC, ord, i)::INTEGER AS rank FROM f QUALIFY rank <= 3")
def g5(spark, sf_dir):
    m = members(spark, sf_dir)
    words = m.select("cluster").distinct().withColumn("terms", F.array(F.lit("survey"), F.lit("second")))
    return S.sentences(m, words)


@q("g6_representatives", f"{with_views(DENSE, _DEDGES, _MEMBERS, _CENTRAL)} SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY centrality DESC, ord)::INTEGER AS rank FROM central QUALIFY rank <= 5")
def g6(spark, sf_dir):
    m = members(spark, sf_dir)
    return S.representatives(m, S.centrality(m, dense_edges(spark, sf_dir)))


@q("l1_trends", f"{with_views(DENSE, _MEMBERS)}, s AS (SELECT cluster, count(*) AS size FROM members GROUP BY 1 HAVING count(*) >= 2), a AS (SELECT cluster, area, count(*) AS n, min(ord) AS o FROM members GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, o) = 1) SELECT cluster, size, area, n FROM s JOIN a USING (cluster)")
def l1(spark, sf_dir):
    m = members(spark, sf_dir)
    words = m.select("cluster").distinct().withColumn("terms", F.array(F.lit("survey")))
    made = S.trends(m, N.nearest_dense(dense(spark, sf_dir)), words)
    return made["sizes"].join(made["areas"].where(C("rank") == 1), "cluster").select("cluster", "size", "area", C("count").alias("n"))


_TRAIL = f"""cand AS (SELECT c.id, 'core' AS stage, 0 AS place, o.id AS other, o.centrality, o.ord FROM members c JOIN central o ON c.cluster = o.cluster AND c.id <> o.id
UNION ALL SELECT c.id, 'intro', 1, o.id, o.centrality, o.ord FROM members c JOIN central o ON c.cluster = o.cluster AND c.id <> o.id AND regexp_matches(o.abstract, '{INTRO}')
UNION ALL SELECT c.id, 'applied', 2, o.id, o.centrality, o.ord FROM members c JOIN central o ON c.cluster = o.cluster AND c.id <> o.id AND regexp_matches(o.abstract, '{APPLIED}')),
best AS (SELECT id, stage, place, other FROM cand QUALIFY row_number() OVER (PARTITION BY id, stage ORDER BY centrality DESC, ord) = 1 UNION ALL SELECT id, 'broader', 3, nbr FROM (SELECT e.id, e.nbr, e.rank FROM edges e JOIN dense a ON a.id = e.id JOIN dense b ON b.id = e.nbr WHERE a.cluster <> b.cluster) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1)"""


@q("l2_study_trail", f"{with_views(DENSE, _DEDGES, _MEMBERS, _CENTRAL, _TRAIL)} SELECT id, stage, other FROM best QUALIFY row_number() OVER (PARTITION BY id, other ORDER BY place) = 1")
def l2(spark, sf_dir):
    return S.trail(members(spark, sf_dir), dense_edges(spark, sf_dir), INTRO, APPLIED)


@q("l3_content_fingerprint")
def l3(spark, sf_dir):
    return content_fingerprint(table(spark, sf_dir, "nation"))


@q("l6_insight_panel", f"{with_views(CORPUS)} SELECT category AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category)::INTEGER AS rank FROM corpus WHERE area_tags[1] = 'en' GROUP BY 1 QUALIFY rank <= 3")
def l6(spark, sf_dir):
    n = corpus(spark, sf_dir).where(C("area_tags")[0] == "en").groupBy(C("category").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(n, [F.desc("n"), F.asc("label")], 3)


@q("l10_lookups", f"{with_views(DENSE, _MEMBERS)} SELECT id, cluster, area FROM members WHERE id = 17")
def l10(spark, sf_dir):
    return members(spark, sf_dir).where(C("id") == 17).select("id", "cluster", "area")


@q("m4_map_contract", f"{with_views(DENSE, _DEDGES)} SELECT 'unknown neighbour' AS rule, count(*) AS n FROM edges WHERE nbr NOT IN (SELECT id FROM dense WHERE id % 13 <> 0)")
def m4(spark, sf_dir):
    from loomery.operators.contract import unknown

    known = dense(spark, sf_dir).where(C("id") % 13 != 0).select("id")
    return unknown(dense_edges(spark, sf_dir).select("nbr"), "nbr", known, "id").agg(F.lit("unknown neighbour").alias("rule"), F.count(F.lit(1)).alias("n"))


@q("m9_embedding_contract", "SELECT 'dimensions' AS rule, count(*) AS n FROM embeddings WHERE len(embedding) <> 64")
def m9(spark, sf_dir):
    return dense(spark, sf_dir).where(F.size("vec") != 64).agg(F.lit("dimensions").alias("rule"), F.count(F.lit(1)).alias("n"))
