import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from loomery.sources import pdf as P
from loomery.sources import records as S


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_csv_keeps_quoted_commas_breaks_and_quotes(spark, tmp_path):
    rows = S.read_csv(spark, write(tmp_path / "a.csv", ' ID ,Title,Abstract\r\na,"x, ""y""","l1\nl2"\r\n\r\nb,short\r\n')).collect()
    assert [(r["id"], r["title"], r["abstract"]) for r in rows] == [("a", 'x, "y"', "l1\nl2"), ("b", "short", "")]


def test_records_of_csv_rows_get_defaults(spark):
    rows = spark.createDataFrame([("", "2301.00001-some.pdf", "T", "A; B;  C ", "robots; vision", "10.1/x"), ("", "", "My Title!", "", "", "")], "id string, pdf_file string, title string, authors string, keywords string, doi string")
    a, b = S.from_csv_rows(rows).collect()
    assert (a["id"], a["type"], a["authors"], a["category"], a["doi_url"]) == ("2301.00001-some", "paper", "A, B, C", "robots", "https://doi.org/10.1/x")
    assert (b["id"], b["category"], b["group"]) == ("my-title", "Other", "Main Conference")


def test_json_lines_skip_blanks_and_raise_on_broken_ones(spark, tmp_path):
    schema = StructType().add("id", StringType()).add("title", StringType())
    good = write(tmp_path / "a.jsonl", '{"id": "a", "title": "t", "more": 1}\n\n{"id": "b"}\n')
    assert S.read_jsonl(spark, good, schema).count() == 2
    with pytest.raises(S.InvalidRecords):
        S.read_jsonl(spark, write(tmp_path / "b.jsonl", '{"id": \n'), schema)


def test_the_first_source_with_rows_wins(spark, tmp_path):
    schema = StructType().add("id", StringType()).add("type", StringType()).add("title", StringType())
    empty = write(tmp_path / "e.csv", "id,title\n")
    jsonl = write(tmp_path / "a.jsonl", '{"id": "j", "type": "paper", "title": "t"}\n')
    assert [r["id"] for r in S.load_records(spark, empty, jsonl, schema).collect()] == ["j"]
    assert [r["id"] for r in S.load_records(spark, write(tmp_path / "f.csv", "id,title\nc,t\n"), jsonl, schema).collect()] == ["c"]
    assert S.load_records(spark).count() == 0


def test_invalid_records_raise(spark):
    bad = spark.createDataFrame([("a", "book", "t"), ("b", "paper", " ")], "id string, type string, title string")
    assert {(r["id"], r["rule"]) for r in S.violations(bad).collect()} == {("a", "type"), ("b", "missing title")}
    with pytest.raises(S.InvalidRecords):
        S.validate(bad)


def test_normalised_records(spark):
    rows = spark.createDataFrame([("a", "workshop", "t", "x.pdf"), ("b", "paper", "t", None)], "id string, type string, title string, local_pdf_path string")
    a, b = S.normalise(rows).collect()
    assert (a["group"], a["best_asset_kind"], a["availability_status"], a["area_tags"]) == ("Workshop", "pdf", "downloaded", ["Other"])
    assert (b["group"], b["best_asset"], b["availability_label"], b["has_pdf"]) == ("Main Conference", "", "Metadata only", False)


def test_programme_rows_and_feed_entries(spark):
    html = '<table><tr><th>x</th></tr><tr class="r"><td><a href="/virtual/2026/poster/12">A &amp; B</a><div class="indented"> <i>P Q ⋅ R</i></div></td><td class="elc-keywords"> k1; k2 </td><td>In Room: Hall 1<br>Poster Location: #A-7</td></tr></table>'
    (r,) = S.parse_programme(spark.createDataFrame([(html,)], "html string")).collect()
    assert (r["number"], r["title"], r["authors"], r["keywords"], r["room"], r["board"]) == ("12", "A & B", ["P Q", "R"], ["k1", "k2"], "Hall 1", "A-7")
    xml = '<feed><entry><id>http://arxiv.org/abs/1.2v1</id><title>A\n b</title><summary>s</summary><category term="cs.CV"/><category term="cs.AI"/><author><name>N</name></author></entry></feed>'
    (e,) = S.parse_feed(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert (e["entry_id"], e["title"], e["primary_category"], e["categories"], e["authors"]) == ("1.2v1", "A b", "cs.CV", ["cs.CV", "cs.AI"], ["N"])


def sample_pdf(*streams, title="(Test Title)"):
    body = b"%PDF-1.4\n1 0 obj << /Title " + title.encode("latin-1") + b" >> endobj\n"
    for s in streams:
        body += b"2 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(s.encode("latin-1")) + b"\nendstream endobj\n"
    return body + b"%%EOF"


def test_pdf_text_and_title():
    title, text = P.extract(sample_pdf("BT (First \\(line\\)) Tj T* (Second\\101) Tj ET"))
    assert title == "Test Title"
    assert text == "First (line)\nSecondA"


def test_every_stream_of_a_pdf_is_decoded():
    _, text = P.extract(sample_pdf("BT (one) Tj ET", "BT (two) Tj ET", "BT <0074006800720065> Tj <65> Tj ET"))
    assert [x for x in text.split("\n") if x] == ["one", "two", "three"]


def test_pdf_titles_and_escapes():
    assert P.info_title(sample_pdf(title="<feff00410042>")) == "AB"
    assert P.info_title(sample_pdf(title="(\\376\\377\\000A\\000B)")) == "AB"
    assert P.unescape("a\\n\\050b\\") == "a\n(b"
    assert P.extract(b"not a pdf stream x endstream") == ("", "")


TEXT = """A Plausible Title Of A Paper
abstract This abstract has more than eighty characters, which it needs so that it is taken for one at all, you see.
1 Introduction
words
References
[1] "A first title that is long enough". Some Venue, 1996. With more words.
[2] A second entry whose title is long enough. Venue (1952), pages and more.
"""


def test_abstract_references_and_title_of_a_text(spark):
    df = spark.createDataFrame([(TEXT,)], "t string")
    r = df.select(P.abstract_of(F.col("t")).alias("a"), P.references_of(F.col("t")).alias("r"), P.guess_title(F.col("t")).alias("g")).first()
    assert r["a"].startswith("This abstract has") and r["a"].endswith("you see.")
    assert [x["year"] for x in r["r"]] == ["1996", "1952"]
    assert r["r"][0]["title"] == "A first title that is long enough"
    assert r["g"] == "A Plausible Title Of A Paper"


def test_files_without_a_record_become_records(spark):
    records = spark.createDataFrame([("a", "paper", "T", "")], "id string, type string, title string, abstract string")
    files = spark.createDataFrame([("/x/a.pdf", bytearray(sample_pdf("BT (x) Tj ET"))), ("/x/b.PDF", bytearray(sample_pdf("BT (y) Tj ET")))], "path string, content binary")
    out, refs = P.ingest(records, P.extracted(files))
    assert {(r["id"], r["title"]) for r in out.collect()} == {("a", "T"), ("b", "Test Title")}
    assert refs.count() == 0


def test_the_year_of_a_reference_is_not_a_number_of_its_title(spark):
    text = "x\nReferences\n[1] A shared reference title number 1984. Venue of many words, 2001, with pages.\n[2] A shared title that ends in 1999. Venue of many words, with pages alone."
    r = spark.createDataFrame([(text,)], "t string").select(P.references_of(F.col("t")).alias("r")).first()["r"]
    assert [x["year"] for x in r] == ["2001", "1999"]
