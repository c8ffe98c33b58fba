"""Queries of the citation graph and of the people in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import citations as X
from loomery.operators import graph as G
from loomery.operators import people as P
from loomery.operators.ranking import top
from loomery.plans.registry import query as q
from loomery.sources.views import AUTHORSHIP, BIBLIOGRAPHY, CITED, authorship, bibliography, cited_records, table, with_views

C = F.col
_FEW = "few AS (SELECT l_orderkey AS work_id, l_suppkey AS author, 'Name ' || (l_suppkey % 40) AS name, o_orderpriority AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_OCC = "occ AS (SELECT DISTINCT l_orderkey AS work_id, 'Name ' || (l_suppkey % 40) AS name, l_orderkey || ':' || (l_suppkey % 40) AS occ, o_orderpriority AS topic FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_EDGES = "sizes AS (SELECT record_id, count(*) AS n FROM bibliography GROUP BY 1), u AS (SELECT DISTINCT record_id, key FROM bibliography), pairs AS (SELECT x.record_id AS a, y.record_id AS b, count(*) AS shared FROM u x JOIN u y ON x.key = y.key AND x.record_id < y.record_id GROUP BY 1, 2), edges AS (SELECT a, b, shared, round(shared::DOUBLE / greatest(1, least(p.n, r.n)), 4) AS score FROM pairs JOIN sizes p ON a = p.record_id JOIN sizes r ON b = r.record_id)"
_LINKS = "u AS (SELECT DISTINCT work_id, author FROM {t}), links AS (SELECT x.author AS a, y.author AS b, count(*) AS shared FROM u x JOIN u y ON x.work_id = y.work_id AND x.author < y.author GROUP BY 1, 2)"


def _labels(groups: str, rounds: int = 16) -> str:
    """Components of what shares a group (table of node, k), by passing on the smallest label; to be put behind WITH RECURSIVE."""
    mem = f"mem AS (SELECT DISTINCT node, k FROM ({groups}) QUALIFY count(*) OVER (PARTITION BY k) > 1)"
    heard = "SELECT it, k, min(label) AS label FROM lab JOIN mem USING (node) GROUP BY 1, 2"
    lab = f"lab AS (SELECT DISTINCT 0 AS it, node, node AS label FROM mem UNION ALL SELECT it + 1, mem.node, min(g.label) FROM mem JOIN ({heard}) g USING (k) WHERE it < {rounds} GROUP BY 1, 2)"
    return f"{mem}, {lab}, labels AS (SELECT node, label FROM lab WHERE it = {rounds})"


_CITING = _labels("SELECT DISTINCT record_id AS node, key AS k FROM bibliography")
_STRONG = _labels("SELECT a AS node, a || '-' || b AS k FROM links WHERE shared >= 2 UNION ALL SELECT b, a || '-' || b FROM links WHERE shared >= 2")
_SAME = _labels("SELECT DISTINCT x.occ AS node, x.name || '|' || y.name AS k FROM occ x JOIN occ y ON x.work_id = y.work_id AND x.name <> y.name")


def few(spark, sf_dir):
    """Whole authorship, authors as numbers."""
    return authorship(spark, sf_dir).select("work_id", F.substring("author", 2, 20).cast("long").alias("author"), "name", "topic")


def occurrences(spark, sf_dir):
    a = authorship(spark, sf_dir)
    return a.select("work_id", "name", F.concat_ws(":", "work_id", F.substring("name", 6, 10)).alias("occ"), "topic").distinct()


@q("k1_overlap_edges", f"{with_views(BIBLIOGRAPHY, _EDGES)} SELECT a, b, shared, score FROM edges")
def k1(spark, sf_dir):
    return X.overlap_edges(bibliography(spark, sf_dir))


@q("e4_citation_overlap_join", f"{with_views(BIBLIOGRAPHY, _EDGES)} SELECT count(*) AS pairs, sum(shared)::BIGINT AS shared FROM edges")
def e4(spark, sf_dir):
    return G.shared_pairs(bibliography(spark, sf_dir), "key", "record_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("shared").alias("shared"))


@q("k2_communities", f"WITH RECURSIVE {BIBLIOGRAPHY}, {CITED}, {_EDGES}, {_CITING}, sz AS (SELECT label, count(*) AS members FROM labels GROUP BY 1), ins AS (SELECT label, count(*) AS edges, max(shared) AS max_shared FROM edges JOIN labels ON a = node GROUP BY 1), modes AS (SELECT label, category FROM labels JOIN cited ON node = record_id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(node)) = 1) SELECT label, members, edges, max_shared, category FROM sz JOIN ins USING (label) JOIN modes USING (label) ORDER BY members DESC, label LIMIT 12")
def k2(spark, sf_dir):
    return X.communities(bibliography(spark, sf_dir), cited_records(spark, sf_dir))


@q("k3_bridge_pairs", f"{with_views(BIBLIOGRAPHY, _EDGES)} SELECT row_number() OVER (ORDER BY score DESC, shared DESC, a, b)::INTEGER AS rank, a, b, shared, score FROM edges ORDER BY rank LIMIT 10")
def k3(spark, sf_dir):
    return X.bridges(X.overlap_edges(bibliography(spark, sf_dir)))


@q("k4_shared_foundations", f'{with_views(BIBLIOGRAPHY)} SELECT key, count(DISTINCT record_id) AS "count" FROM bibliography GROUP BY 1 HAVING count(DISTINCT record_id) >= 2 ORDER BY 2 DESC, key LIMIT 20')
def k4(spark, sf_dir):
    return X.foundations(bibliography(spark, sf_dir))


@q("k5_citation_neighbourhood", f"{with_views(BIBLIOGRAPHY, _EDGES)}, two AS (SELECT a AS record_id, b AS other, shared, score FROM edges UNION ALL SELECT b, a, shared, score FROM edges) SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, shared DESC, other)::INTEGER AS rank FROM two QUALIFY rank <= 20")
def k5(spark, sf_dir):
    return X.neighbourhoods(bibliography(spark, sf_dir))


@q("f14_reference_summary", f"{with_views(BIBLIOGRAPHY, _EDGES)} SELECT (SELECT count(DISTINCT record_id) FROM bibliography) AS records, (SELECT count(DISTINCT key) FROM bibliography) AS keys, (SELECT count(*) FROM (SELECT a FROM edges UNION SELECT b FROM edges)) AS overlapping, (SELECT count(*) FROM edges) AS edges")
def f14(spark, sf_dir):
    refs = bibliography(spark, sf_dir)
    return X.summary(refs, G.shared_pairs(refs, "key", "record_id"))


@q("g7_citing_ids", f"{with_views(BIBLIOGRAPHY)}, u AS (SELECT DISTINCT key, record_id FROM bibliography) SELECT key, record_id, row_number() OVER (PARTITION BY key ORDER BY record_id)::INTEGER AS rank FROM u QUALIFY rank <= 40")
def g7(spark, sf_dir):
    return top(bibliography(spark, sf_dir).select("key", "record_id").distinct(), ["key"], [F.asc("record_id")], 40)


@q("l7_reference_health", f"{with_views(BIBLIOGRAPHY)} SELECT (SELECT count(*) FROM orders) AS records, count(DISTINCT record_id) AS with_references, round(count(DISTINCT record_id) * 100.0 / (SELECT count(*) FROM orders), 2)::DOUBLE AS percent, count(*) AS refs FROM bibliography")
def l7(spark, sf_dir):
    refs = bibliography(spark, sf_dir).agg(F.count_distinct("record_id").alias("with_references"), F.count(F.lit(1)).alias("refs"))
    n = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("records"))
    return n.join(F.broadcast(refs)).select("records", "with_references", F.round(C("with_references") * 100.0 / C("records"), 2).alias("percent"), "refs")


@q("l11_reference_artifacts", f"{with_views(BIBLIOGRAPHY, _EDGES)} SELECT 'edges' AS artifact, count(*) AS n FROM edges UNION ALL SELECT 'bridges', least(10, count(*)) FROM edges UNION ALL SELECT 'foundations', least(20, count(*)) FROM (SELECT key FROM bibliography GROUP BY 1 HAVING count(DISTINCT record_id) >= 2) UNION ALL SELECT 'summary', 1")
def l11(spark, sf_dir):
    kinds = ("edges", "bridges", "foundations", "summary")
    made = X.reference_artifacts(bibliography(spark, sf_dir), cited_records(spark, sf_dir), kinds)
    parts = [made[k].agg(F.lit(k).alias("artifact"), F.count(F.lit(1)).alias("n")) for k in kinds]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@q("e5_coauthor_join", f"{with_views(AUTHORSHIP, _LINKS.format(t='authorship'))} SELECT a, b, shared FROM links")
def e5(spark, sf_dir):
    return P.coauthor_links(authorship(spark, sf_dir), "author")


@q("k7_coauthor_links", f"{with_views(_FEW, _LINKS.format(t='few'))} SELECT a, b, shared FROM links")
def k7(spark, sf_dir):
    return P.coauthor_links(few(spark, sf_dir), "author")


@q("k8_coauthor_groups", f"WITH RECURSIVE {_FEW}, {_LINKS.format(t='few')}, {_STRONG}, ins AS (SELECT label, work_id FROM u JOIN labels ON author = node GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT label, count(*) AS works FROM ins GROUP BY 1 HAVING count(*) >= 2), sz AS (SELECT label, count(*) AS members FROM labels GROUP BY 1) SELECT label, members, works FROM sz JOIN w USING (label)")
def k8(spark, sf_dir):
    own = few(spark, sf_dir)
    return P.groups(own, P.coauthor_links(own, "author"), "author")


@q("e6_identity_candidates", f"WITH RECURSIVE {_OCC}, {_SAME} SELECT count(*) AS occurrences, count(DISTINCT label) AS people FROM labels")
def e6(spark, sf_dir):
    return P.same_people(occurrences(spark, sf_dir)).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("label").alias("people"))


_IDENT = f"{_OCC}, {_SAME}, resolved AS (SELECT occ.*, coalesce(label, occ) AS identity FROM occ LEFT JOIN labels ON node = occ)"


@q("k6_identity_resolution", f"WITH RECURSIVE {_IDENT} SELECT occ, identity FROM resolved")
def k6(spark, sf_dir):
    return P.resolve(occurrences(spark, sf_dir)).select("occ", "identity")


@q("f12_author_rollup", f"WITH RECURSIVE {_IDENT}, t AS (SELECT identity, topic, count(DISTINCT work_id) AS n FROM resolved GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY identity ORDER BY n DESC, topic) <= 5) SELECT identity, min(name) AS name, count(DISTINCT work_id) AS works, any_value(topics) AS topics FROM resolved JOIN (SELECT identity, string_agg(topic || '=' || n, ',' ORDER BY n DESC, topic) AS topics FROM t GROUP BY 1) USING (identity) GROUP BY 1")
def f12(spark, sf_dir):
    people = P.rollup(G.cut(P.resolve(occurrences(spark, sf_dir))))
    return people.select("identity", "name", "works", F.array_join(F.transform("topics", lambda t: F.concat_ws("=", t["topic"], t["count"])), ",").alias("topics"))


@q("e7_email_union", "WITH x AS (SELECT l_orderkey || ':' || l_linenumber AS occ, CASE WHEN l_suppkey % 3 < 2 THEN l_suppkey END AS mail FROM lineitem) SELECT occ, CASE WHEN mail IS NULL THEN occ ELSE min(occ) OVER (PARTITION BY mail) END AS identity FROM x")
def e7(spark, sf_dir):
    """Two thirds of the suppliers sign with an address, in either case; names are all different, so addresses alone unite."""
    li = table(spark, sf_dir, "lineitem")
    occ = F.concat_ws(":", "l_orderkey", "l_linenumber")
    mail = F.concat(F.when(C("l_linenumber") % 2 == 0, " S").otherwise("s"), C("l_suppkey"), F.lit("@Example.org "))
    own = li.select(C("l_orderkey").alias("work_id"), occ.alias("name"), occ.alias("occ"), F.lit("t").alias("topic"), F.when(C("l_suppkey") % 3 < 2, mail).when(C("l_suppkey") % 2 == 0, F.lit(" ")).alias("email"))
    return P.resolve(own).select("occ", "identity")


def _people(spark, sf_dir):
    own = few(spark, sf_dir).withColumnRenamed("author", "identity")
    return P.network(G.cut(P.rollup(own)), P.coauthor_links(own))


_NET = f"{_FEW}, {_LINKS.format(t='few')}, n AS (SELECT author, min(name) AS name, count(DISTINCT work_id) AS works FROM few GROUP BY 1 HAVING count(DISTINCT work_id) >= 2)"


@q("k9_author_network", f"WITH {_NET} SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS links, sum(shared)::BIGINT AS shared FROM links WHERE a IN (SELECT author FROM n) AND b IN (SELECT author FROM n)")
def k9(spark, sf_dir):
    nodes, links = _people(spark, sf_dir)
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(links.agg(F.count(F.lit(1)).alias("links"), F.sum("shared").alias("shared"))))


@q("f18_network_insights", f"WITH {_NET}, l AS (SELECT * FROM links WHERE a IN (SELECT author FROM n) AND b IN (SELECT author FROM n)), deg AS (SELECT x AS author, count(*) AS n FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l) GROUP BY 1), p AS (SELECT author, works FROM n ORDER BY works DESC, name, author LIMIT 1), s AS (SELECT a || '-' || b AS pair, shared FROM l ORDER BY shared DESC, a, b LIMIT 1), c AS (SELECT author, deg.n FROM deg JOIN n USING (author) ORDER BY deg.n DESC, works DESC, author LIMIT 1), lead AS (SELECT author, topic FROM (SELECT author, topic, count(DISTINCT work_id) AS k FROM few WHERE author IN (SELECT author FROM n) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY author ORDER BY k DESC, topic) = 1), t AS (SELECT topic, count(*) AS n FROM lead GROUP BY 1 ORDER BY n DESC, topic LIMIT 1) SELECT p.author AS prolific, p.works AS prolific_works, s.pair, s.shared AS pair_works, c.author AS connector, c.n AS collaborators, t.topic, t.n AS topic_authors FROM p, s, c, t")
def f18(spark, sf_dir):
    nodes, links = _people(spark, sf_dir)
    return P.insights(nodes, G.cut(links))


@q("k10_components", f"WITH RECURSIVE {_FEW}, {_LINKS.format(t='few')}, {_STRONG} SELECT node, label FROM labels")
def k10(spark, sf_dir):
    return G.components(P.coauthor_links(few(spark, sf_dir), "author").where(C("shared") >= 2))


@q("k11_islands", f"WITH RECURSIVE {_FEW}, {_LINKS.format(t='few')}, {_STRONG}, w AS (SELECT author AS node, count(DISTINCT work_id) AS weight FROM few GROUP BY 1), i AS (SELECT label, count(*) AS size, sum(weight)::BIGINT AS weight FROM labels JOIN w USING (node) GROUP BY 1 HAVING count(*) >= 2) SELECT *, row_number() OVER (ORDER BY size DESC, weight DESC, label)::INTEGER AS rank FROM i QUALIFY rank <= 10")
def k11(spark, sf_dir):
    own = few(spark, sf_dir)
    labels = G.components(P.coauthor_links(own, "author").where(C("shared") >= 2))
    return G.islands(labels, own.groupBy(C("author").alias("node")).agg(F.count_distinct("work_id").alias("weight")), 2, 10)


@q("e15_one_hop_expansion", f"WITH {_FEW}, {_LINKS.format(t='few')}, m AS (SELECT DISTINCT author FROM few WHERE author % 25 = 3) SELECT author AS id FROM m UNION SELECT b FROM links WHERE a IN (SELECT author FROM m) UNION SELECT a FROM links WHERE b IN (SELECT author FROM m)")
def e15(spark, sf_dir):
    own = few(spark, sf_dir)
    return G.expand(own.where(C("author") % 25 == 3).select(C("author").alias("id")).distinct(), P.coauthor_links(own, "author"))


@q("k12_filtered_author_graph", f"WITH {_FEW}, {_LINKS.format(t='few')}, m AS (SELECT DISTINCT author FROM few WHERE topic = '1-URGENT') SELECT a, b, shared FROM links WHERE a IN (SELECT author FROM m) AND b IN (SELECT author FROM m)")
def k12(spark, sf_dir):
    own = few(spark, sf_dir)
    m = own.where(C("topic") == "1-URGENT").select("author").distinct()
    return P.coauthor_links(own, "author").join(m.withColumnRenamed("author", "a"), "a", "left_semi").join(m.withColumnRenamed("author", "b"), "b", "left_semi").select("a", "b", "shared")


@q("l5_people_by_scope", f"WITH {_FEW}, s AS (SELECT *, unnest(CASE WHEN work_id % 3 = 0 THEN ['all', 'workshop'] ELSE ['all', 'main'] END) AS scope FROM few) SELECT scope, count(DISTINCT work_id) AS works, count(DISTINCT author) AS authors FROM s GROUP BY 1")
def l5(spark, sf_dir):
    own = F.when(C("work_id") % 3 == 0, F.array(F.lit("all"), F.lit("workshop"))).otherwise(F.array(F.lit("all"), F.lit("main")))
    return few(spark, sf_dir).withColumn("scope", F.explode(own)).groupBy("scope").agg(F.count_distinct("work_id").alias("works"), F.count_distinct("author").alias("authors"))
