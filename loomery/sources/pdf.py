"""Text, title, abstract and references of PDF files.

Bytes are read by Spark and taken apart in Arrow batches; what follows from the text is column expressions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.functions.text import WHITE, reference_key

# Escapes of PDF strings; operators that show strings, and those that end a line.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
SHOWS, LINE_ENDS = {"Tj", "TJ", "'", '"'}, {"Td", "TD", "T*", "ET"}
_ESCAPE = re.compile(r"\\([0-7]{1,3}|[\s\S]|$)")
_TOKEN = re.compile(r"(?P<open>\()|<(?P<hex>[0-9A-Fa-f\s]+)>|(?P<op>\b(?:Tj|TJ|Td|TD|ET)\b|\bT\*)")
#: Limits of the lists made from a text.
REFERENCE_WINDOW, MOST_REFERENCES = 30_000, 400


def unescape(raw: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x, 8) & 0xFF) if x[:1].isdigit() and x[0] < "8" else ESCAPES.get(x, x)

    return _ESCAPE.sub(one, raw)


def literal_end(s: str, start: int) -> int:
    """Where the string that opens at start - 1 closes; brackets inside may nest."""
    depth, i = 1, start
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(s)


def hex_text(digits: str) -> str:
    """A hexadecimal string: 16-bit characters if it looks like them, else printable single bytes."""
    d = re.sub(r"\s+", "", digits)
    if len(d) % 4 == 0 and d[:2].lower() in ("00", "01", "fe", "ff"):
        codes = (int(d[i : i + 4], 16) for i in range(0, len(d), 4))
        return "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\ufffd" for c in codes if c >= 32 or c in (10, 13))
    return "".join(chr(c) for c in bytes.fromhex(d + "0" * (len(d) % 2)) if 32 <= c < 127)


def shown_text(content: str) -> str:
    """What a content stream shows, a line for each move to a new one."""
    out: list[str] = []
    held, at = "", 0
    while m := _TOKEN.search(content, at):
        at = m.end()
        if m["open"]:
            end = literal_end(content, at)
            held = ""
            out.append(unescape(content[at:end]))
            at = end + 1
        elif m["hex"] is not None:
            held = hex_text(m["hex"])
        else:
            out.append(held if held or m["op"] in SHOWS else "\n")
            held = ""
    return "".join(out)


def streams(data: bytes) -> Iterator[str]:
    """The inflated streams of a file, one after the other; what doesn't inflate is left out."""
    at = 0
    while (start := data.find(b"stream", at)) >= 0:
        start += len(b"stream")
        start += 1 if data[start : start + 1] == b"\r" else 0
        start += 1 if data[start : start + 1] == b"\n" else 0
        end = data.find(b"endstream", start)
        if end < 0:
            return
        for window in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
            try:
                yield zlib.decompressobj(window).decompress(data[start:end]).decode("latin-1")
                break
            except zlib.error:
                continue
        at = end + len(b"endstream")


def info_title(data: bytes) -> str:
    """The title of the information dictionary, as a string or hexadecimal."""
    s = data.decode("latin-1")
    if m := re.search(r"/Title\s*\(", s):
        raw = unescape(s[m.end() : literal_end(s, m.end())])
        return raw[2:].encode("latin-1", "replace").decode("utf-16-be", "replace") if raw.startswith("\xfe\xff") else raw
    if m := re.search(r"/Title\s*<([0-9A-Fa-f\s]+)>", s):
        d = re.sub(r"\s+", "", m[1])
        if d[:4].lower() == "feff":
            return bytes.fromhex(d[4 : len(d) // 4 * 4]).decode("utf-16-be", "replace")
        return "".join(chr(c) for c in bytes.fromhex(d[: len(d) // 2 * 2]) if 32 <= c < 127).strip()
    return ""


def extract(data: bytes) -> tuple[str, str]:
    """(title, text) of a file's bytes."""
    text = "\n".join(map(shown_text, streams(data)))
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    return info_title(data), text


def extract_column(content: Column) -> Column:
    """struct(info_title, full_text) of a binary column."""

    @F.pandas_udf("info_title string, full_text string")
    def extracted_(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([extract(bytes(b)) if b is not None else ("", "") for b in s], columns=["info_title", "full_text"])

    return extracted_(content)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, info_title, full_text of the PDF files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return extracted(files)


def extracted(files: DataFrame) -> DataFrame:
    """The same for a table with path and content."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(?i)\\.pdf$", "")
    rows = files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"), extract_column(F.col("content")).alias("x"))
    return rows.select("file", "sha256", "x.info_title", "x.full_text")


def guess_title(text: Column) -> Column:
    """The first plausible of a text's first fifteen lines, else ""."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 15)
    odd = r"(?i)^(abstract|introduction|keywords?|proceedings|copyright|doi|https?:)"
    good = F.filter(lines, lambda x: ~x.rlike("^\\d+$") & F.length(x).between(12, 220) & ~x.rlike(odd) & x.rlike("[a-z]{3}") & x.rlike("[A-Z]"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def abstract_of(text: Column) -> Column:
    """What stands between "abstract" and the introduction, keywords or a new paragraph: 80 to 2200 characters, else ""."""
    ends = r"\n\s*(?:1\s+introduction|1\.?\s|introduction|keywords?|categories|ccs concepts|acm reference|permission to make)\b|[.\n]*\n\s*\n\s*[A-Z0-9]"
    found = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)abstract\b[:.\s-]*(.{{80,2200}}?)(?={ends})", 1), WHITE + "+", " "))
    return F.when(F.length(found) >= 80, found).otherwise("")


def references_of(text: Column) -> Column:
    """array<struct<title, year, key, raw>> of the numbered entries behind the heading of the references."""
    section = F.substring(F.regexp_extract(text, r"(?is)\n\s*(?:references|bibliography)\s*\n(.*)$", 1), 1, REFERENCE_WINDOW)
    entries = F.split(F.concat(F.lit("\n"), section), r"\n(?=\[\d{1,3}\]\s|\d{1,3}\.\s(?=[A-Z\"“]))")
    clean = F.transform(entries, lambda e: F.trim(F.regexp_replace(e, WHITE + "+", " ")))
    kept = F.slice(F.filter(clean, lambda e: F.length(e).between(41, 1199) & e.rlike("[a-z]{3}")), 1, MOST_REFERENCES)

    def parse(raw: Column) -> Column:
        titled, dated = r'^(?:\[\d{1,3}\]|\d{1,3}\.)\s*"?([^.""]{10,240})[.""]?', r"(?:\b|\()((?:19|20)\d{2})(?:\b|\))"
        title = F.nullif(F.regexp_extract(raw, titled, 1), F.lit(""))
        behind = F.regexp_extract(F.regexp_replace(raw, titled, ""), dated, 1)  # a number within the title may look like a year
        year = F.when(behind != "", behind).otherwise(F.regexp_extract(raw, dated, 1))
        return F.struct(F.trim(F.coalesce(title, F.substring(raw, 1, 160))).alias("title"), year.alias("year"), reference_key(raw).alias("key"), F.substring(raw, 1, 600).alias("raw"))

    return F.filter(F.transform(kept, parse), lambda r: F.length(r["key"]) > 12)


def ingest(records: DataFrame, pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with what their files add, references): files without a record become records.

    A record's file is the one named like its id; its own abstract stays, a missing one is filled.
    """
    found = pdfs.select("file", F.coalesce(F.nullif("info_title", F.lit("")), F.nullif(guess_title(F.col("full_text")), F.lit("")), F.col("file")).alias("file_title"), abstract_of(F.col("full_text")).alias("file_abstract"), references_of(F.col("full_text")).alias("refs"))
    joined = records.join(found, records["id"] == found["file"], "full")
    filled = {
        "id": F.coalesce("id", "file"), "title": F.coalesce("title", "file_title"), "type": F.coalesce("type", F.lit("paper")),
        "abstract": F.coalesce(F.nullif("abstract", F.lit("")), F.col("file_abstract"), F.lit("")), "local_pdf_path": F.when(F.col("file").isNotNull(), F.concat(F.lit("pdfs/"), "file", F.lit(".pdf"))),
    }
    out = joined.withColumns(filled)
    references = out.where(F.size("refs") > 0).select(F.col("id").alias("record_id"), F.posexplode("refs").alias("pos", "r")).select("record_id", "pos", "r.key", "r.title", "r.year")
    return out.drop("file", "file_title", "file_abstract", "refs"), references
