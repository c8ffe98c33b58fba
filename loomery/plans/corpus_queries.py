"""Queries of sources, filters, joins, aggregates, ranks and sets, over the corpus view and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.functions.records import search_parts
from loomery.operators import ranking as K
from loomery.plans.registry import query
from loomery.functions.text import EMAIL
from loomery.plans.scalar_queries import sql_search, sql_tokens, sql_work_key
from loomery.sources import records as S
from loomery.sources.views import AUTHORSHIP, BIBLIOGRAPHY, CITED, CORPUS, DENSE, authorship, bibliography, cited_records, corpus, dense, table, with_views

C = F.col
_WORKS = f"k AS (SELECT *, {sql_work_key()} AS work_key FROM corpus), works AS (SELECT *, min(ord) OVER (PARTITION BY work_key) AS place FROM k QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY (type = 'poster')::INT, ord) = 1)"
_SCOPED = "scoped AS (SELECT *, unnest(CASE type WHEN 'workshop' THEN ['all', 'workshop'] ELSE ['all', 'main'] END) AS scope FROM corpus)"


def works_of(spark, sf_dir):
    return K.first_works(corpus(spark, sf_dir).withColumn("work_key", T.work_key(C("title"), C("id"))))


def q(name, sql):
    return query(name, sql)


# sources and sinks

@q("a3_records_from_csv_rows", "SELECT coalesce(nullif(trim(s_name), ''), 'x') AS title, 'paper' AS type, 'src' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'k' || s_nationkey END AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'https://doi.org/10.1/' || s_suppkey ELSE '' END AS doi_url, CASE WHEN s_suppkey % 2 = 0 THEN 'A B, C' ELSE 'C' END AS authors, CASE WHEN s_suppkey % 5 = 0 THEN 'G' ELSE 'Main Conference' END AS \"group\" FROM supplier")
def a3(spark, sf_dir):
    k, even = C("s_suppkey"), C("s_suppkey") % 2 == 0
    rows = table(spark, sf_dir, "supplier").select(
        F.lit(" ").alias("id"), F.concat(F.lit("src"), k, F.lit(".PDF")).alias("pdf_file"), F.concat(F.lit("  "), "s_name").alias("title"), F.lit("").alias("type"),
        F.when(even, "a").otherwise("").alias("category"), F.concat(F.lit(" k"), "s_nationkey", F.lit(" ; z")).alias("keywords"), F.when(even, "A  B;; C ").otherwise("C").alias("authors"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k)).otherwise("").alias("doi"), F.when(k % 5 == 0, " G").otherwise("").alias("group"))
    return S.from_csv_rows(rows).select("id", "type", "title", "category", "doi_url", "authors", "group")


@q("a10_reference_overrides", "WITH e AS (SELECT l_orderkey AS record_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS refs FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS record_id, [o_custkey] AS refs FROM orders WHERE o_orderkey % 7 = 0) SELECT coalesce(o.record_id, e.record_id) AS record_id, array_to_string(coalesce(o.refs, e.refs), ',') AS refs FROM e FULL JOIN o ON e.record_id = o.record_id")
def a10(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    found = li.groupBy(C("l_orderkey").alias("record_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("found"))
    given = o.where(C("o_orderkey") % 7 == 0).select(C("o_orderkey").alias("record_id"), F.array(C("o_custkey").cast("string")).alias("given"))
    return found.join(given, "record_id", "full").select("record_id", F.array_join(F.coalesce("given", "found"), ",").alias("refs"))


@q("a11_html_list_rows", r"SELECT page_id, (i - 1)::INTEGER AS pos, regexp_extract(c[i + 1], 'href=.([^ \x22>]+)', 1) AS link FROM (SELECT page_id, regexp_split_to_array(html, '<p[^>]*>') AS c FROM pages), unnest(generate_series(1, len(c) - 1)) t(i)")
def a11(spark, sf_dir):
    rows = S.html_rows(table(spark, sf_dir, "pages").select("page_id", "html"), row="<p[^>]*>")
    return rows.select("page_id", "pos", F.regexp_extract("chunk", 'href=.([^ \\x22>]+)', 1).alias("link"))


@q("a16_all_shards", f"{with_views(CORPUS)} SELECT id, type FROM corpus")
def a16(spark, sf_dir):
    c = corpus(spark, sf_dir)
    parts = [c.where(C("type") == t) for t in S.TYPES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "type")




def reviewed(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = labels.join(corpus(spark, sf_dir), labels["doc_id"] == C("ord"))
    core = F.array(F.lit("Deep  Learning"), C("category"), F.upper("category"), F.concat(C("area_tags")[0], F.lit(" prose")))
    accepted = named.where(C("quality") == 1).select("id", T.concrete_concepts(core, 3).alias("core"), F.array(C("category"), C("type"), F.lit("Theory"), C("group")).alias("raw"))
    return accepted.where(F.size("core") > 0).select("id", "core", T.concrete_concepts(C("raw"), 6, C("core")).alias("detail"))


_CONCEPTS = """concepts AS (SELECT id, [category, area_tags[1] || ' prose'] AS core, [type, "group"] AS detail FROM corpus JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) ON ord = doc_id WHERE quality = 1)"""
_DETAIL = "CASE WHEN lower(detail[1]) = lower(detail[2]) THEN detail[1] ELSE array_to_string(detail, '|') END"


@q("a18_parse_concepts", f"{with_views(CORPUS, _CONCEPTS)} SELECT id, array_to_string(core, '|') AS core, {_DETAIL} AS detail FROM concepts")
def a18(spark, sf_dir):
    return reviewed(spark, sf_dir).select("id", F.array_join("core", "|").alias("core"), F.array_join("detail", "|").alias("detail"))


@q("b3_shard_counts", f"{with_views(CORPUS)} SELECT type AS shard, count(*) AS n, min(ord) AS first_ord FROM corpus GROUP BY 1")
def b3(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy(C("type").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


@q("b8_reference_shards", f"{with_views(BIBLIOGRAPHY)} SELECT record_id, 'record-' || record_id AS file, count(*) AS reference_count FROM bibliography GROUP BY 1, 2")
def b8(spark, sf_dir):
    return bibliography(spark, sf_dir).groupBy("record_id").agg(F.count(F.lit(1)).alias("reference_count")).withColumn("file", T.safe_file_id(F.concat(F.lit("record-"), C("record_id").cast("string"))))


# filters

@q("d1_facets", f"""{with_views(CORPUS)} SELECT id FROM corpus WHERE list_contains(category_tags, 'src2') AND "group" = 'Main Conference' AND area_tags[1] = 'en'""")
def d1(spark, sf_dir):
    return corpus(spark, sf_dir).where(F.array_contains("category_tags", "src2") & (C("group") == "Main Conference") & (C("area_tags")[0] == "en")).select("id")


def phrase_hits(c, phrase):
    parts = search_parts(C("title"), C("authors"), C("abstract"), C("category"))
    return c.where(F.contains(F.concat_ws(" ", *[parts[k] for k in ("title", "abstract", "authors", "tags")]), F.lit(phrase)))


_HAY = f"concat_ws(' ', {sql_search('title')}, {sql_search('abstract')}, {sql_search('authors')}, {sql_search('category')})"


@q("d3_filtered_records", f"{with_views(CORPUS)} SELECT id, row_number() OVER (ORDER BY ord)::INTEGER AS place FROM corpus WHERE type <> 'poster' AND area_tags[1] = 'en' AND contains({_HAY}, 'src2')")
def d3(spark, sf_dir):
    shown = corpus(spark, sf_dir).where((C("type") != "poster") & (C("area_tags")[0] == "en"))
    hits = phrase_hits(shown, "src2").select("id")
    return shown.join(hits, "id", "left_semi").select("id", F.row_number().over(Window.orderBy("ord")).alias("place"))


@q("d4_scopes", f"{with_views(CORPUS, _SCOPED)} SELECT scope, count(*) AS n FROM scoped GROUP BY 1")
def d4(spark, sf_dir):
    return K.scoped(corpus(spark, sf_dir)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@q("d6_people_search_page", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_suppkey LIMIT 20 OFFSET 5")
def d6(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("1"))).orderBy("s_suppkey").offset(5).limit(20).select("s_suppkey", "s_name")


@q("d7_contains_email", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\b[^\s@]+@[^\s@]+\.[^\s@]+\b')")
def d7(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(C("text").rlike(EMAIL)).select("doc_id")


@q("d8_record_validation", "SELECT 'o' || o_orderkey AS id, 'type' AS rule FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o' || o_orderkey, 'missing title' FROM orders WHERE o_orderkey % 9 = 0")
def d8(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return S.violations(o.select(F.concat(F.lit("o"), C("o_orderkey")).alias("id"), F.when(C("o_orderstatus") == "F", "F").otherwise("paper").alias("type"), F.when(C("o_orderkey") % 9 == 0, " ").otherwise("t").alias("title")))


@q("d11_author_node_search", f"{with_views(AUTHORSHIP)} SELECT author FROM (SELECT author, name, string_agg(DISTINCT topic, ' ' ORDER BY topic) AS topics FROM authorship GROUP BY 1, 2) WHERE contains(lower(name || ' ' || topics), 'name 7')")
def d11(spark, sf_dir):
    nodes = authorship(spark, sf_dir).groupBy("author", "name").agg(F.array_join(F.array_sort(F.collect_set("topic")), " ").alias("topics"))
    return nodes.where(F.contains(F.lower(F.concat_ws(" ", "name", "topics")), F.lit("name 7"))).select("author")


# joins

@q("e1_records_with_files", "SELECT coalesce(s_name, 'file ' || c_custkey) AS id, s_suppkey IS NULL AS made, c_custkey IS NOT NULL AS has_file FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON s_suppkey = c_custkey")
def e1(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer").where(C("c_acctbal") > 0)
    j = s.join(c, s["s_suppkey"] == c["c_custkey"], "full")
    return j.select(F.coalesce("s_name", F.concat(F.lit("file "), C("c_custkey"))).alias("id"), C("s_suppkey").isNull().alias("made"), C("c_custkey").isNotNull().alias("has_file"))


@q("e2_known_references", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS records FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def e2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(C("o_orderstatus") == "O").select(C("o_orderkey").alias("record_id"))
    return bibliography(spark, sf_dir).join(o, "record_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


@q("e8_title_enrichment", "WITH e AS (SELECT lower(p_brand) AS key, max_by(p_partkey, p_partkey) AS entry FROM part GROUP BY 1) SELECT p_partkey, coalesce(entry, 0) AS entry FROM part LEFT JOIN e ON lower(p_brand) = key AND p_partkey % 2 = 0")
def e8(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entries = p.groupBy(F.lower("p_brand").alias("key")).agg(F.max_by("p_partkey", "p_partkey").alias("entry"))
    left = p.select("p_partkey", F.when(C("p_partkey") % 2 == 0, F.lower("p_brand")).alias("key"))
    return left.join(entries, "key", "left").select("p_partkey", F.coalesce("entry", F.lit(0)).alias("entry"))


_TITLE = sql_search("title")


@q("e9_paper_posters", f"{with_views(CORPUS)}, posters AS (SELECT {_TITLE} AS t, max_by(id, ord) AS poster, max_by(has_slide, ord) AS slide FROM corpus WHERE type = 'poster' GROUP BY 1) SELECT id, poster, has_slide OR coalesce(slide, false) AS has_slide FROM corpus LEFT JOIN posters ON {_TITLE} = t WHERE type = 'paper'")
def e9(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("t", T.search_normal(C("title")))
    posters = c.where(C("type") == "poster").groupBy("t").agg(F.max_by("id", "ord").alias("poster"), F.max_by("has_slide", "ord").alias("slide"))
    return c.where(C("type") == "paper").join(posters, "t", "left").select("id", "poster", (C("has_slide") | F.coalesce("slide", F.lit(False))).alias("has_slide"))


@q("e10_attach_concepts", f"{with_views(CORPUS, _CONCEPTS)} SELECT corpus.id, coalesce(array_to_string(core, '|'), '') AS core FROM corpus LEFT JOIN concepts USING (id)")
def e10(spark, sf_dir):
    own = reviewed(spark, sf_dir).select("id", F.array_join("core", "|").alias("core"))
    return corpus(spark, sf_dir).join(own, "id", "left").select("id", F.coalesce("core", F.lit("")).alias("core"))


@q("e11_attach_clusters", f"{with_views(DENSE)}, m AS (SELECT cluster, count(*) AS size FROM dense GROUP BY 1) SELECT id, 'c' || (cluster + 1) AS cluster_id, size FROM dense JOIN m USING (cluster)")
def e11(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d.join(d.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster").select("id", F.concat(F.lit("c"), C("cluster") + 1).alias("cluster_id"), "size")


@q("e14_topic_authors", f"{with_views(AUTHORSHIP)} SELECT topic, author, count(DISTINCT work_id) AS works FROM authorship GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY works DESC, author) <= 8")
def e14(spark, sf_dir):
    n = authorship(spark, sf_dir).groupBy("topic", "author").agg(F.count_distinct("work_id").alias("works"))
    return K.top(n, ["topic"], [F.desc("works"), F.asc("author")], 8).drop("rank")


@q("e17_anti_joins", f"{with_views(BIBLIOGRAPHY)} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def e17(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where(C("o_orderkey") % 5 == 0), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


# aggregates

@q("f1_corpus_summary", f"""{with_views(CORPUS)} SELECT count(*) AS total, sum((type = 'paper')::INT)::BIGINT AS papers, sum((type = 'poster')::INT)::BIGINT AS posters, sum((type = 'workshop')::INT)::BIGINT AS workshops, sum(has_pdf::INT)::BIGINT AS pdf, sum(has_poster::INT)::BIGINT AS poster, sum(has_slide::INT)::BIGINT AS slide, sum((availability_status = 'downloaded')::INT)::BIGINT AS downloaded, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT "group", ',' ORDER BY "group") AS groups FROM corpus""")
def f1(spark, sf_dir):
    count = lambda c: F.sum(c.cast("long"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    kinds = {"papers": C("type") == "paper", "posters": C("type") == "poster", "workshops": C("type") == "workshop", "pdf": C("has_pdf"), "poster": C("has_poster"), "slide": C("has_slide"), "downloaded": C("availability_status") == "downloaded"}
    return corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), *[count(v).alias(k) for k, v in kinds.items()], joined("category").alias("categories"), joined("group").alias("groups"))


@q("f6_mode_first_seen", f"{with_views(CORPUS)} SELECT area_tags[1] AS area, category FROM corpus GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, min(ord)) = 1")
def f6(spark, sf_dir):
    return K.counted(corpus(spark, sf_dir).withColumn("area", C("area_tags")[0]), ["area"], "category", "ord", 1).select("area", "category")


@q("f7_count_by", f"{with_views(CORPUS)} SELECT area_tags[1] AS area, category, count(*) AS n, row_number() OVER (PARTITION BY area ORDER BY n DESC, min(ord))::INTEGER AS rank FROM corpus GROUP BY 1, 2 QUALIFY rank <= 6")
def f7(spark, sf_dir):
    return K.counted(corpus(spark, sf_dir).withColumn("area", C("area_tags")[0]), ["area"], "category", "ord", 6).withColumnRenamed("count", "n")


@q("f8_sorted_counts", f"{with_views(CORPUS)} SELECT category AS label, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def f8(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy(C("category").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(5)


@q("f9_top_keywords", f"{with_views(CORPUS)}, few AS (SELECT * FROM corpus WHERE area_tags[1] = 'en' ORDER BY ord LIMIT 160), w AS (SELECT ord, unnest({sql_tokens(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || substr(abstract, 1, 1200)')}) AS word FROM few) SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 AND word <> 'tion' GROUP BY 1 ORDER BY n DESC, word LIMIT 6")
def f9(spark, sf_dir):
    few = corpus(spark, sf_dir).where(C("area_tags")[0] == "en").orderBy("ord").limit(160)
    words = few.select(F.explode(T.tokenize(F.concat_ws(" ", "title", F.substring("abstract", 1, 1200)))).alias("word"))
    return words.where((F.length("word") >= 4) & (C("word") != "tion")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(6)


@q("f10_topic_trends", f"{with_views(CORPUS, _CONCEPTS, _WORKS)}, n AS (SELECT count(*) AS total FROM works) SELECT core[1] AS label, count(*) AS works, round(count(*)::DOUBLE / max(total), 6) AS share FROM works JOIN concepts USING (id), n GROUP BY 1")
def f10(spark, sf_dir):
    works = works_of(spark, sf_dir)
    total = works.agg(F.count(F.lit(1)).alias("total"))
    counts = works.join(reviewed(spark, sf_dir), "id").groupBy(C("core")[0].alias("label")).agg(F.count(F.lit(1)).alias("works"))
    return counts.join(F.broadcast(total)).select("label", "works", F.round(C("works") / C("total"), 6).alias("share"))


@q("f11_topic_index", f"{with_views(CORPUS, _CONCEPTS, _WORKS)} SELECT label, count(*) AS works, min(place) AS first_place FROM (SELECT id, place, unnest(core) AS label FROM works JOIN concepts USING (id)) GROUP BY 1")
def f11(spark, sf_dir):
    each = works_of(spark, sf_dir).join(reviewed(spark, sf_dir), "id").select("place", F.explode("core").alias("label"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("works"), F.min("place").alias("first_place"))


@q("f13_references_by_area", f"{with_views(BIBLIOGRAPHY, CITED)} SELECT area, count(*) AS n FROM bibliography JOIN cited USING (record_id) GROUP BY 1")
def f13(spark, sf_dir):
    n = bibliography(spark, sf_dir).groupBy("record_id").agg(F.count(F.lit(1)).alias("k"))
    return n.join(cited_records(spark, sf_dir), "record_id").groupBy("area").agg(F.sum("k").alias("n"))


@q("f15_box_selection", f"{with_views(DENSE)} SELECT cluster, count(*) AS n FROM dense WHERE vec[1] BETWEEN -0.1 AND 0.1 AND vec[2] BETWEEN -0.1 AND 0.1 GROUP BY 1")
def f15(spark, sf_dir):
    return dense(spark, sf_dir).where(C("vec")[0].between(-0.1, 0.1) & C("vec")[1].between(-0.1, 0.1)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@q("f16_header_stats", f"{with_views(CORPUS)} SELECT sum((type <> 'poster')::INT)::BIGINT AS shown, count(DISTINCT area_tags[1]) AS areas FROM corpus")
def f16(spark, sf_dir):
    return corpus(spark, sf_dir).agg(F.sum((C("type") != "poster").cast("long")).alias("shown"), F.count_distinct(C("area_tags")[0]).alias("areas"))


@q("f19_facet_values", f"{with_views(CORPUS)}, v AS (SELECT DISTINCT presentation_type AS value FROM corpus WHERE presentation_type <> '') SELECT value, row_number() OVER (ORDER BY CASE value WHEN 'Spotlight' THEN 0 WHEN 'Oral' THEN 1 ELSE 2 END, value)::INTEGER AS place FROM v")
def f19(spark, sf_dir):
    v = corpus(spark, sf_dir).where(C("presentation_type") != "").select(C("presentation_type").alias("value")).distinct()
    first = F.when(C("value") == "Spotlight", 0).when(C("value") == "Oral", 1).otherwise(2)
    return v.select("value", F.row_number().over(Window.orderBy(first, "value")).alias("place"))


@q("f22_distinct_facets", f"{with_views(CORPUS)} SELECT type, count(*) AS n, count(DISTINCT area_tags[1]) AS areas, count(DISTINCT category) AS domains FROM corpus GROUP BY 1")
def f22(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(C("area_tags")[0]).alias("areas"), F.count_distinct("category").alias("domains"))


@q("f23_pairwise_compare", f"""{with_views(CORPUS)} SELECT a.id AS l, b.id AS r, len(list_intersect([a.category, a.type, a."group"], [b.category, b.type, b."group"]))::INTEGER AS shared, len(list_filter([a.category, a.type, a."group"], lambda v: NOT list_contains([b.category, b.type, b."group"], v)))::INTEGER AS different FROM corpus a JOIN corpus b ON b.ord = a.ord + 1""")
def f23(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", "ord", F.array("category", "type", "group").alias("tags"))
    b = c.select(C("id").alias("r"), (C("ord") - 1).alias("ord"), C("tags").alias("other"))
    return c.join(b, "ord").select(C("id").alias("l"), "r", F.size(F.array_intersect("tags", "other")).alias("shared"), F.size(F.array_except("tags", "other")).alias("different"))


@q("f24_topic_increments", f"{with_views(AUTHORSHIP)} SELECT author, topic, count(DISTINCT work_id) AS n FROM authorship GROUP BY 1, 2")
def f24(spark, sf_dir):
    return authorship(spark, sf_dir).groupBy("author", "topic").agg(F.count_distinct("work_id").alias("n"))


@q("f25_tab_counts", f"{with_views(CORPUS)} SELECT type, count(*) AS n, count(*) FILTER (availability_status = 'downloaded') AS fresh FROM corpus GROUP BY 1")
def f25(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("availability_status") == "downloaded").alias("fresh"))


# ranks, sets, paging

@q("g2_unique_works", f"{with_views(CORPUS, _WORKS)} SELECT id, place FROM works")
def g2(spark, sf_dir):
    return works_of(spark, sf_dir).select("id", "place")


@q("g3_keep_first", "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS kept FROM orders GROUP BY 1")
def g3(spark, sf_dir):
    return K.top(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderkey")], 1).select("o_custkey", C("o_orderkey").alias("kept"))


@q("g8_reference_leaderboard", f"{with_views(BIBLIOGRAPHY)} SELECT record_id, count(DISTINCT key) AS keys, count(*) AS refs FROM bibliography GROUP BY 1 ORDER BY keys DESC, refs DESC, record_id LIMIT 16")
def g8(spark, sf_dir):
    return bibliography(spark, sf_dir).groupBy("record_id").agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("refs")).orderBy(F.desc("keys"), F.desc("refs"), "record_id").limit(16)


@q("g9_minmax_strength", "SELECT l_orderkey, l_linenumber, round(greatest(0.08, least(1, (l_quantity - min(l_quantity) OVER w) / greatest(0.001, max(l_quantity) OVER w - min(l_quantity) OVER w))), 6) AS strength FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def g9(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    low, high = F.min("l_quantity").over(w), F.max("l_quantity").over(w)
    v = (C("l_quantity") - low) / F.greatest(F.lit(0.001), high - low)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.greatest(F.lit(0.08), F.least(F.lit(1.0), v)), 6).alias("strength"))


@q("g10_percentile_normalise", "WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS i FROM customer), b AS (SELECT min(v) FILTER (i = floor(n * 0.02)) AS lo, min(v) FILTER (i = least(n - 1, floor(n * 0.98))) AS hi FROM r, n) SELECT c_custkey, round(greatest(-1, least(1, (c_acctbal - lo) / (hi - lo) * 2 - 1)), 6) AS x FROM customer, b")
def g10(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    # the value at an index of the sorted order: exact percentiles with an offset of half a step
    n = c.count()
    low, high = int(n * 0.02), min(n - 1, int(n * 0.98))
    at = lambda i: F.expr(f"percentile(c_acctbal, {i / max(1, n - 1)}D)")
    bounds = c.agg(at(low).alias("lo"), at(high).alias("hi"))
    x = (C("c_acctbal") - C("lo")) / (C("hi") - C("lo")) * 2 - 1
    return c.join(F.broadcast(bounds)).select("c_custkey", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)), 6).alias("x"))


@q("g11_paging", f"{with_views(CORPUS)} SELECT id FROM corpus ORDER BY ord LIMIT 80 OFFSET 80")
def g11(spark, sf_dir):
    return corpus(spark, sf_dir).orderBy("ord").offset(80).limit(80).select("id")


@q("g12_ordinal_ids", f"{with_views(CORPUS)} SELECT 'topic-' || row_number() OVER (ORDER BY count(*) DESC, category) AS topic_id, category FROM corpus GROUP BY category")
def g12(spark, sf_dir):
    n = corpus(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.lit("topic-"), F.row_number().over(Window.orderBy(F.desc("n"), "category"))).alias("topic_id"), "category")


@q("h1_union_all", "SELECT 'o' AS kind, o_orderkey AS k FROM orders UNION ALL SELECT 'c', c_custkey FROM customer")
def h1(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.lit("o").alias("kind"), C("o_orderkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), C("c_custkey").alias("k")))


@q("h2_intersect_except", "SELECT 'both' AS op, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey = 1) UNION ALL SELECT 'rest', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)")
def h2(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select(C("o_custkey").alias("k")), table(spark, sf_dir, "customer")
    both = o.intersect(c.where(C("c_nationkey") == 1).select(C("c_custkey").alias("k")))
    return both.select(F.lit("both").alias("op"), "k").union(c.select(C("c_custkey").alias("k")).subtract(o).select(F.lit("rest"), "k"))


@q("h3_ordered_distinct", f"{with_views(CORPUS)}, d AS (SELECT category, min(ord) AS first_ord FROM corpus GROUP BY 1) SELECT category, row_number() OVER (ORDER BY first_ord)::INTEGER AS place FROM d")
def h3(spark, sf_dir):
    d = corpus(spark, sf_dir).groupBy("category").agg(F.min("ord").alias("first_ord"))
    return d.select("category", F.row_number().over(Window.orderBy("first_ord")).alias("place"))


# contract

@q("m1_unique_ids", "SELECT text AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def m1(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(C("text").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(C("n") > 1)


@q("l8_identity_evidence", f"{with_views(AUTHORSHIP)} SELECT author, CASE WHEN count(DISTINCT work_id) > 1 THEN 'normalized-name+shared-coauthor-context' ELSE 'single-record-name' END AS evidence FROM authorship GROUP BY 1")
def l8(spark, sf_dir):
    n = authorship(spark, sf_dir).groupBy("author").agg(F.count_distinct("work_id").alias("n"))
    return n.select("author", F.when(C("n") > 1, "normalized-name+shared-coauthor-context").otherwise("single-record-name").alias("evidence"))
