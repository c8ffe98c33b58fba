"""Queries of file sources, PDF extraction, plain-text forms, published tables and their contract."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomery.functions import latex as L
from loomery.functions import text as T
from loomery.operators import artifacts as A
from loomery.operators import contract as K
from loomery.operators.ranking import selected
from loomery.plans.corpus_queries import _CONCEPTS, reviewed
from loomery.plans.registry import query as q
from loomery.plans.semantic_queries import members
from loomery.session import shared_folder
from loomery.sources import pdf as P
from loomery.sources import records as R
from loomery.sources.views import CORPUS, DENSE, corpus, dense, table, with_views

C = F.col


def _shared(spark, name: str) -> str:
    """A new folder that all executors see."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sample_pdfs(spark, sf_dir):
    """path, content: a small PDF file of each supplier, two of the three references of neighbours in common.

    Every third file shows its text as hexadecimal strings, every third as octal escapes; every other title is UTF-16.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, name in zip(b["s_suppkey"], b["s_name"], strict=True):
                lines = [f"A Sample Paper About {name}", "", "abstract", "This abstract is about a supplier and says so at some length, with more than eighty characters in it.", "", "1 Introduction", "Words.", "References"]
                lines += [f"[{i + 1}] A shared reference title number {(k + i) // 3}. Venue of many words, {1990 + (k + i) % 30}, with pages." for i in range(3)]
                lines[0] += " (with 100\\% more)"
                write = [
                    lambda x: "({}) Tj".format(x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")),
                    lambda x: f"<{x.encode('latin-1').hex()}> Tj",
                    lambda x: "({}) Tj".format("".join(f"\\{ord(c):03o}" for c in x)),
                ][k % 3]
                shown = " T* ".join(map(write, lines))
                stream = zlib.compress(f"BT {shown} ET".encode("latin-1"))
                title = b"(Paper " + str(k).encode() + b")" if k % 2 else b"<feff" + f"Paper {k}".encode("utf-16-be").hex().encode() + b">"
                body = b"%PDF-1.4\n1 0 obj << /Title " + title + b" >> endobj\n2 0 obj << /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj\n%%EOF"
                out.append((f"/pdfs/p{k}.pdf", body))
            yield pd.DataFrame(out, columns=["path", "content"])

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInPandas(make, "path string, content binary")


@q("a1_csv_rows", """SELECT s_suppkey::VARCHAR AS id, 'a "quoted", ' || s_name || chr(10) || 'line' AS title FROM supplier""")
def a1(spark, sf_dir):
    path = _shared(spark, "csv")
    table(spark, sf_dir, "supplier").select(C("s_suppkey").alias(" ID "), F.concat(F.lit('a "quoted", '), "s_name", F.lit("\nline")).alias("Title")).write.csv(path, header=True, quote='"', escape='"')
    return R.read_csv(spark, path)


@q("a2_csv_header", "SELECT 'id' || s_suppkey AS id, s_name AS title, s_nationkey::VARCHAR AS doi FROM supplier")
def a2(spark, sf_dir):
    """Values go by the names of the header, whatever their order, case and white space."""
    path = _shared(spark, "csv")
    table(spark, sf_dir, "supplier").select(C("s_nationkey").alias("DOI "), C("s_name").alias("Title"), F.concat(F.lit("id"), "s_suppkey").alias(" Id")).write.csv(path, header=True)
    return R.read_csv(spark, path).select("id", "title", "doi")


@q("a4_json_lines", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def a4(spark, sf_dir):
    path = _shared(spark, "jsonl")
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k long")["k"].alias("k"))).alias("value")).write.text(path)
    return R.read_jsonl(spark, path, StructType.fromDDL("event_id long, k long"))


@q("a5_source_precedence", "SELECT 'src' || s_suppkey AS id FROM supplier")
def a5(spark, sf_dir):
    path = _shared(spark, "csv")
    table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("id"), C("s_name").alias("title")).write.csv(path, header=True)
    return R.load_records(spark, csv=path).select("id")


@q("a7_pdf_files", "SELECT 'p' || s_suppkey AS file FROM supplier")
def a7(spark, sf_dir):
    return P.extracted(sample_pdfs(spark, sf_dir)).where(F.length("sha256") == 64).select("file")


@q("a8_pdf_text", "SELECT 'p' || s_suppkey AS file, 'Paper ' || s_suppkey AS info_title, 'A Sample Paper About ' || s_name || ' (with 100\\% more)' AS first_line FROM supplier")
def a8(spark, sf_dir):
    return P.extracted(sample_pdfs(spark, sf_dir)).select("file", "info_title", F.split("full_text", "\n")[0].alias("first_line"))


_PDF_TEXT = """'A Sample Paper About ' || s_name || ' (with 100\\% more)' || chr(10) || chr(10) || 'abstract' || chr(10) || 'This abstract is about a supplier and says so at some length, with more than eighty characters in it.' || chr(10) || chr(10) || '1 Introduction' || chr(10) || 'Words.' || chr(10) || 'References' || chr(10) || array_to_string(list_transform([0, 1, 2], lambda i: '[' || (i + 1) || '] A shared reference title number ' || ((s_suppkey + i) // 3) || '. Venue of many words, ' || (1990 + (s_suppkey + i) % 30) || ', with pages.'), chr(10))"""


@q("a9_native_extraction_parity", f"SELECT 'p' || s_suppkey AS file, {_PDF_TEXT} AS full_text FROM supplier")
def a9(spark, sf_dir):
    """Whatever the way in which a file shows its text, the same text comes out."""
    return P.extracted(sample_pdfs(spark, sf_dir)).select("file", "full_text")


@q("a12_feed_entries", "SELECT 'n' || s_suppkey AS entry_id, s_name AS title, 'cs.X' AS primary_category FROM supplier")
def a12(spark, sf_dir):
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/n"), "s_suppkey", F.lit("</id><title>"), "s_name", F.lit('</title><category term="cs.X"/></entry>'))
    return R.parse_feed(table(spark, sf_dir, "supplier").select(F.concat(F.lit("<feed>"), entry).alias("xml"))).select("entry_id", "title", "primary_category")


@q("a15_published_tables", "SELECT n_nationkey, n_name FROM nation")
def a15(spark, sf_dir):
    path = _shared(spark, "site")
    A.publish({"nation": table(spark, sf_dir, "nation")}, path)
    return A.read(spark, path, "nation").select("n_nationkey", "n_name")


@q("a17_pinned_reads", "SELECT 'region' AS broken UNION ALL SELECT 'supplier'")
def a17(spark, sf_dir):
    """Of four tables one is written anew with a changed row and one is gone."""
    path = _shared(spark, "site")
    A.publish({t: table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer")}, path)
    other = table(spark, sf_dir, "region").withColumn("r_name", F.when(C("r_regionkey") == 0, "x").otherwise(C("r_name")))
    other.write.mode("overwrite").parquet(f"{path}/region")
    table(spark, sf_dir, "supplier").limit(0).write.mode("overwrite").parquet(f"{path}/supplier")
    return spark.createDataFrame([(x,) for x in A.broken(spark, path)], "broken string")


@q("b9_manifest", "SELECT 'nation' AS name, 25 AS n UNION ALL SELECT 'empty', 0")
def b9(spark, sf_dir):
    path = _shared(spark, "site")
    n = table(spark, sf_dir, "nation")
    A.publish({"nation": n, "empty": n.limit(0)}, path)
    return spark.createDataFrame([(k, v["rows"]) for k, v in A.manifest(spark, path).items()], "name string, n int")


@q("b10_empty_artifacts", "SELECT 'nation' AS name, 'n_nationkey,n_name,n_regionkey' AS names, 0 AS n UNION ALL SELECT 'region', 'r_regionkey,r_name', 0")
def b10(spark, sf_dir):
    """Tables without rows are published, pinned and read like any others, columns and all."""
    path = _shared(spark, "site")
    A.publish({t: table(spark, sf_dir, t).limit(0) for t in ("nation", "region")}, path)
    back = [A.read(spark, path, t) for t in ("nation", "region")]
    return spark.createDataFrame([(t, ",".join(d.columns), d.count()) for t, d in zip(("nation", "region"), back, strict=True)], "name string, names string, n int")


@q("c14_plain_math_title", f"""{with_views(CORPUS)} SELECT id, CASE ord % 6 WHEN 0 THEN 'Deep α nets: ' || category || ' in ℝ' WHEN 1 THEN category || ': ' || area_tags[1] WHEN 2 THEN 'Over β and alphabet O(n) ' || category WHEN 3 THEN 'x2 by ' || ord || ' textbf{{a{{b}}c}}' WHEN 4 THEN trim(regexp_replace(regexp_replace(regexp_replace(title, '\\$([^$]+)\\$', '\\1', 'g'), ':([A-Za-z])', ': \\1', 'g'), '\\s+', ' ', 'g')) ELSE 'θ$ ' || category END AS value FROM corpus""")
def c14(spark, sf_dir):
    forms = [
        F.concat(F.lit("\\textbf{Deep} $\\alpha$ nets:"), C("category"), F.lit(" in \\mathbb{R}")),
        F.concat(F.lit("  \\texttt{"), C("category"), F.lit("}:"), C("area_tags")[0]),
        F.concat(F.lit("Over $\\beta$ and \\alphabet \\mathcal{O}(n) "), C("category")),
        F.concat(F.lit("$x2$ by "), C("ord"), F.lit(" \\textbf{a{b}c}")),
        C("title"),
        F.concat(F.lit("\\theta$ "), C("category")),
    ]
    raw = F.element_at(F.array(*forms), (C("ord") % 6 + 1).cast("int"))
    return corpus(spark, sf_dir).select("id", L.plain_math_title(raw).alias("value"))


@q("c15_clean_abstract", f"""{with_views(CORPUS)} SELECT id, CASE ord % 5 WHEN 0 THEN 'We use x, $\\alpha_1$ and ' || category || '.' WHEN 1 THEN 'Nested \\textbf{{' || category || '}}; done.' WHEN 2 THEN 'Costs $5 of ' || ord WHEN 3 THEN 'n^2 steps' || category ELSE category || ', a: b $andz$' END AS value FROM corpus""")
def c15(spark, sf_dir):
    forms = [
        F.concat(F.lit("We  use $x$ ,\\cite{a} $ \\alpha_1 $ and \\emph{"), C("category"), F.lit("} [cite: 1, 2].")),
        F.concat(F.lit("Nested \\textbf{\\mathcal{"), C("category"), F.lit("}} ; done.")),
        F.concat(F.lit("Costs $5 of "), C("ord")),
        F.concat(F.lit("$n^2$ steps\\citep{x}[CITE: 3]"), C("category")),
        F.concat(C("category"), F.lit(" , \\text{a} : \\mathbf{\\textit{b}} $$ and $z$")),
    ]
    raw = F.element_at(F.array(*forms), (C("ord") % 5 + 1).cast("int"))
    return corpus(spark, sf_dir).select("id", L.clean_abstract(raw).alias("value"))


@q("c21_extract_abstract", "SELECT 'p' || s_suppkey AS file, 'This abstract is about a supplier and says so at some length, with more than eighty characters in it' AS abstract FROM supplier")
def c21(spark, sf_dir):
    return P.extracted(sample_pdfs(spark, sf_dir)).select("file", P.abstract_of(C("full_text")).alias("abstract"))


@q("c22_extract_references", "SELECT 'p' || s_suppkey AS file, i AS pos, 'A shared reference title number ' || ((s_suppkey + i) // 3) AS title, (1990 + (s_suppkey + i) % 30)::VARCHAR AS year FROM supplier, unnest([0, 1, 2]) t(i)")
def c22(spark, sf_dir):
    refs = P.extracted(sample_pdfs(spark, sf_dir)).select("file", F.posexplode(P.references_of(C("full_text"))).alias("pos", "r"))
    return refs.select("file", "pos", "r.title", "r.year")


@q("c23_guess_title", "SELECT 'p' || s_suppkey AS file, 'A Sample Paper About ' || s_name || ' (with 100\\% more)' AS title FROM supplier")
def c23(spark, sf_dir):
    return P.extracted(sample_pdfs(spark, sf_dir)).select("file", P.guess_title(C("full_text")).alias("title"))


@q("c35_citation_titles", f"""{with_views(CORPUS)} SELECT id, array_to_string(list_concat(['A long enough title on ' || category || ' ' || (ord % 9)], CASE WHEN length(trim(title)) >= 18 AND len(regexp_split_to_array(trim(title), '\\s+')) >= 3 AND regexp_matches(title, '[A-Za-z]{{3,}}') AND NOT regexp_matches(trim(title), '^(?i:and|[a-z]\\.)\\s+|^[A-Za-z]{{1,3}},\\s*[A-Z]\\.|[a-z]{{3,}}[A-Z]\\.,|^[A-Z]\\.,?\\s+|^[A-Z][\\w''’.-]+,\\s+[A-Z]\\.?[, ]') THEN [title] ELSE [] END), '|') AS shown FROM corpus""")
def c35(spark, sf_dir):
    """Titles of documents among an address, names, a short one, and one title in two cases."""
    own = F.concat(F.lit("title on "), C("category"), F.lit(" "), C("ord") % 9)
    titles = F.array(F.concat(F.lit("A long enough "), own), F.lit("https://x.org"), F.lit("Smith, J., Doe, A."), C("title"), F.concat(F.lit("A LONG enough "), own), F.lit("Too short"), F.lit("and others of this long list"))
    return corpus(spark, sf_dir).select("id", F.array_join(L.shown_references(titles), "|").alias("shown"))


@q("f20_ingest_report", "SELECT count(*) AS files, count(*) AS with_references FROM supplier")
def f20(spark, sf_dir):
    refs = P.references_of(C("full_text"))
    return P.extracted(sample_pdfs(spark, sf_dir)).select(F.size(refs).alias("n")).agg(F.count(F.lit(1)).alias("files"), F.count_if(C("n") > 0).alias("with_references"))


@q("g13_selection_fallback", f"{with_views(CORPUS)}, f AS (SELECT * FROM corpus WHERE type = 'paper' AND has_pdf) SELECT c.id AS wanted, coalesce(f.id, (SELECT arg_min(id, ord) FROM f)) AS selected FROM corpus c LEFT JOIN f USING (id)")
def g13(spark, sf_dir):
    """Each record as the one that is wanted: itself where the filters leave it, else the first that they leave."""
    c = corpus(spark, sf_dir)
    return selected(c.select(C("id").alias("wanted")), c.where((C("type") == "paper") & C("has_pdf")))


@q("l4_warm_start", "SELECT count(*) AS n FROM nation")
def l4(spark, sf_dir):
    path = _shared(spark, "warm")
    n = table(spark, sf_dir, "nation")
    key = A.fingerprint(n)
    A.warm(spark, path, key, lambda: n)
    return A.warm(spark, path, key, lambda: n.limit(0)).agg(F.count(F.lit(1)).alias("n"))


@q("l9_topic_handoff", f"{with_views(CORPUS)} SELECT id FROM corpus JOIN labels ON doc_id = ord WHERE quality = 1 AND category = 'src3' GROUP BY 1")
def l9(spark, sf_dir):
    return reviewed(spark, sf_dir).where(F.array_contains("core", "src3")).select("id")


@q("m2_manifest_shards", f"""{with_views(CORPUS)} SELECT 'shards' AS artifact, 'known id' AS rule, 'doc-x' AS detail UNION ALL SELECT 'shards', 'id in no shard', id FROM corpus WHERE type = 'workshop' OR ord % 41 = 0
UNION ALL SELECT 'shards', 'empty shard', 'workshop' UNION ALL SELECT 'shards', 'pin', 'records'""")
def m2(spark, sf_dir):
    """Published shards, then tampered with: a type gone, some rows gone, a row that the index doesn't have."""
    path, c = _shared(spark, "site"), corpus(spark, sf_dir)
    rows = c.select("id", "type", "title")
    A.publish({"records": rows}, path, {"records": "type"})
    left = c.where((C("type") != "workshop") & (C("ord") % 41 != 0)).select("id", "type", "title")
    left.union(rows.where(C("type") == "paper").limit(1).withColumn("id", F.lit("doc-x"))).write.mode("overwrite").partitionBy("type").parquet(f"{path}/records")
    return K.shards(spark, path, "records", c.select("id", "type"))


@q("m3_startup_ids", f"{with_views(CORPUS)} SELECT 'startup' AS artifact, 'known id' AS rule, id AS detail FROM corpus WHERE ord % 97 = 0")
def m3(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return K.known_ids(c.select("id"), "startup", "id", c.where(C("ord") % 97 != 0).select(C("id").alias("k")), "k")


@q("m5_trend_references", f"{with_views(DENSE)} SELECT 'trends' AS artifact, 'known record' AS rule, id::VARCHAR AS detail FROM dense WHERE id % 50 = 1")
def m5(spark, sf_dir):
    d = dense(spark, sf_dir)
    return K.known_ids(d.select(C("id").alias("record")), "trends", "record", d.where(C("id") % 50 != 1))


@q("m6_study_references", f"{with_views(DENSE)} SELECT 'study' AS artifact, 'known topic' AS rule, cluster::VARCHAR AS detail FROM (SELECT DISTINCT cluster FROM dense) WHERE cluster = 3")
def m6(spark, sf_dir):
    m = members(spark, sf_dir)
    return K.known_ids(m.select(C("cluster").alias("topic")).distinct(), "study", "topic", m.where(C("cluster") != 3).select(C("cluster").alias("id")))


@q("m7_concept_counts", f"{with_views(CORPUS, _CONCEPTS)} SELECT id, len(core)::INTEGER AS n_core, CASE WHEN lower(detail[1]) = lower(detail[2]) THEN 1 ELSE 2 END::INTEGER AS n_detail FROM concepts")
def m7(spark, sf_dir):
    return reviewed(spark, sf_dir).select("id", F.size("core").alias("n_core"), F.size("detail").alias("n_detail"))


@q("m8_people_without_addresses", r"SELECT 'people' AS artifact, 'no email' AS rule, doc_id::VARCHAR AS detail FROM documents WHERE regexp_matches(text, '\b[^\s@]+@[^\s@]+\.[^\s@]+\b')")
def m8(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return K.violation(d.where(C("text").rlike(T.EMAIL)), "people", "no email", "doc_id")


@q("m10_concept_coverage", f"{with_views(CORPUS)} SELECT count(*) - (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)) AS missing FROM corpus")
def m10(spark, sf_dir):
    return corpus(spark, sf_dir).join(reviewed(spark, sf_dir), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@q("m12_json_validity", "SELECT event_id FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN replace(props, ':', '') ELSE props END AS p FROM events) WHERE NOT json_valid(p)")
def m12(spark, sf_dir):
    """Documents cut short, or without colons, among valid ones."""
    p = F.when(C("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).when(C("event_id") % 7 == 1, F.replace("props", F.lit(":"), F.lit(""))).otherwise(C("props"))
    return table(spark, sf_dir, "events").withColumn("p", p).where(F.try_parse_json("p").isNull()).select("event_id")