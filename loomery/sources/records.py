"""Records from files: CSV, JSON lines, HTML lists, feeds; the normalised schema and its checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.text import normalize_whitespace, slugify, strip_tags

# The columns of the CSV input.
CSV_COLUMNS = (
    "id", "title", "abstract", "authors", "type", "group", "category", "keywords", "pdf_file", "page_url", "doi",
    "session", "room", "start_time", "end_time", "presentation_type", "decision", "search_aliases",
)
TYPES = ("paper", "poster", "workshop")


class InvalidRecords(ValueError):
    """Input that breaks the record contract, with the first offenders."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file as strings: names trimmed and lower-cased, short rows filled with "", blank rows left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    filled = named.select([F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "\r$", "").alias(c) for c in named.columns])
    return filled.where(F.trim(F.concat_ws("", *[f"`{c}`" for c in filled.columns])) != "")


def split_list(x: Column) -> Column:
    """The parts of a ;-list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), normalize_whitespace), lambda v: v != "")


def from_csv_rows(rows: DataFrame) -> DataFrame:
    """Records of CSV rows, with ids made from the file name or title where they are missing."""
    have = set(rows.columns)
    col = lambda c: normalize_whitespace(F.col(c)) if c in have else F.lit("")
    raw = lambda c: F.col(c) if c in have else F.lit("")
    filled = lambda c: F.nullif(col(c), F.lit(""))
    id_ = F.coalesce(filled("id"), F.regexp_replace(filled("pdf_file"), "(?i)\\.pdf$", ""), slugify(col("title")))
    keywords = split_list(raw("keywords"))
    category = F.coalesce(filled("category"), F.get(keywords, F.lit(0)), F.lit("Other"))
    base = rows.select(
        id_.alias("id"), F.coalesce(filled("type"), F.lit("paper")).alias("type"), F.coalesce(filled("title"), id_).alias("title"), col("abstract").alias("abstract"),
        F.array_join(split_list(raw("authors")), ", ").alias("authors"), filled("group").alias("g"), category.alias("category"), F.array(category).alias("category_tags"),
        split_list(raw("search_aliases")).alias("search_aliases"), col("page_url").alias("source_url"), col("doi").alias("doi"),
        F.when(col("doi") != "", F.concat(F.lit("https://doi.org/"), col("doi"))).otherwise("").alias("doi_url"),
        col("presentation_type").alias("presentation_type"), col("session").alias("session"), col("room").alias("room"), col("decision").alias("decision"),
    )
    group = F.coalesce("g", F.when(F.contains(F.lower("id"), F.lit("workshop")), "Workshop").otherwise("Main Conference"))
    return base.withColumn("group", group).drop("g")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a broken one raises with its content."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.select("value", F.from_json("value", kept, {"mode": "PERMISSIVE"}).alias("r"))
    bad = rows.where(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()).select("value").limit(3).collect()
    if bad:
        raise InvalidRecords(f"{path}: invalid JSON: {[b['value'][:200] for b in bad]}")
    return rows.select("r.*").drop("_corrupt_record")


def violations(records: DataFrame) -> DataFrame:
    """id, rule: records without id, type or title, or of an unknown type."""
    rules = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"missing {c}")) for c in ("id", "type", "title")]
    rules.append(F.when(~F.coalesce(F.col("type"), F.lit("")).isin(*TYPES), F.lit("type")))
    return records.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def validate(records: DataFrame) -> DataFrame:
    bad = violations(records).limit(3).collect()
    if bad:
        raise InvalidRecords(", ".join(f"{r['id']}: {r['rule']}" for r in bad))
    return records


def load_records(spark: SparkSession, csv: str | None = None, jsonl: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The CSV file's records if it has any, else those of the JSON-lines file."""
    if csv is not None:
        rows = from_csv_rows(read_csv(spark, csv))
        if rows.limit(1).count():
            return validate(rows)
    if jsonl is not None and schema is not None:
        return validate(read_jsonl(spark, jsonl, schema))
    return from_csv_rows(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in CSV_COLUMNS)))


def normalise(records: DataFrame) -> DataFrame:
    """Defaults of the normalised record: area tags from the category, best asset, availability, page."""
    have = set(records.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    tags = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    some = lambda c: F.nullif(text(c), F.lit(""))
    categories = F.when(F.size(tags("category_tags")) > 0, tags("category_tags")).otherwise(F.array(F.coalesce(some("category"), F.lit("Other"))))
    out = {
        "category_tags": categories, "category": categories[0], "area_tags": F.when(F.size(tags("area_tags")) > 0, tags("area_tags")).otherwise(F.slice(categories, 1, 1)),
        "domain_tags": tags("domain_tags"), "group": F.coalesce(some("group"), F.when(F.col("type") == "workshop", "Workshop").otherwise("Main Conference")),
        "best_asset": F.coalesce(some("local_pdf_path"), some("local_slide_path"), some("local_poster_path"), F.lit("")),
        "best_asset_kind": F.when(some("local_pdf_path").isNotNull(), "pdf").when(some("local_slide_path").isNotNull(), "slide").when(some("local_poster_path").isNotNull(), "poster").otherwise(""),
        "has_pdf": some("local_pdf_path").isNotNull(), "has_slide": some("local_slide_path").isNotNull(), "has_poster": some("local_poster_path").isNotNull(),
        "page_url": F.coalesce(some("page_url"), text("source_url")),
    }
    shown = records.withColumns(out)
    downloaded = F.col("best_asset") != ""
    return shown.withColumns({
        "availability_status": F.coalesce(some("availability_status"), F.when(downloaded, "downloaded").otherwise("metadata")),
        "availability_label": F.coalesce(some("availability_label"), F.when(downloaded, "Downloaded").otherwise("Metadata only")),
    })


def html_rows(pages: DataFrame, html: str = "html", row: str = "<li[^>]*>") -> DataFrame:
    """pages with one row for each list row of their HTML: pos, chunk."""
    chunks = F.slice(F.split(html, row), 2, 1_000_000)
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(chunks).alias("pos", "chunk"))


def parse_programme(pages: DataFrame) -> DataFrame:
    """Records of a programme page: linked title, authors, keywords, room, board, time and session of each table row."""
    rows = html_rows(pages, row="<tr[^>]*>")
    c = F.col("chunk")
    pick = lambda p: F.trim(F.regexp_extract(c, p, 1))
    listed = lambda x, sep: F.filter(F.transform(F.split(x, sep), lambda v: F.trim(v)), lambda v: v != "")
    number = F.regexp_extract(c, '<a href="/[^"]*/poster/(\\d+)">', 1)
    return rows.where(number != "").select(
        "pos", number.alias("number"), strip_tags(F.regexp_extract(c, '(?s)<a href="/[^"]*/poster/\\d+">(.*?)</a>', 1)).alias("title"),
        listed(strip_tags(F.regexp_extract(c, '(?s)<div class="indented">\\s*<i>(.*?)</i>', 1)), "⋅").alias("authors"),
        listed(strip_tags(F.regexp_extract(c, '(?s)<td class="[^"]*keywords">\\s*(.*?)\\s*</td>', 1)), ";").alias("keywords"),
        pick("In Room:\\s*([^<]*?)<").alias("room"), pick("Poster Location:\\s*#\\s*([\\w-]+)").alias("board"),
        pick("at\\s+([^<]*?)(?:<|\\s{2})").alias("time"), pick("in\\s+(Poster Session [\\dA-Za-z ]+?)\\.?\\s*(?:<|$)").alias("session"),
    )


def parse_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of Atom feeds: id, title, summary, published, categories (the first as primary, if none is named), authors."""
    entries = feeds.select(F.posexplode(F.slice(F.split(xml, "<entry>"), 2, 1_000_000)).alias("pos", "chunk"))
    c = F.col("chunk")
    pick = lambda tag: normalize_whitespace(F.regexp_extract(c, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    categories = F.regexp_extract_all(c, F.lit('<category[^>]*term="([^"]+)"'), F.lit(1))
    primary = F.nullif(F.regexp_extract(c, '<arxiv:primary_category[^>]*term="([^"]+)"', 1), F.lit(""))
    return entries.select(
        "pos", F.regexp_extract(c, "<id>http://arxiv\\.org/abs/([^<]+)</id>", 1).alias("entry_id"), pick("title").alias("title"), pick("summary").alias("summary"), pick("published").alias("published"),
        F.coalesce(primary, F.get(categories, F.lit(0)), F.lit("")).alias("primary_category"), F.slice(categories, 1, 8).alias("categories"),
        F.transform(F.regexp_extract_all(c, F.lit("(?s)<name>(.*?)</name>"), F.lit(1)), lambda n: F.trim(n)).alias("authors"),
    )


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
