"""Benchmark decontamination with DataFrame functions alone.

Texts are lower-cased (A to Z) and cut into words.  A window is 13 consecutive words of a benchmark item, or all words of
a shorter one.  A document's words that lie inside an occurrence of a window are hit.

Any run of w words holds a run of k words that starts at a multiple of w - k + 1, so documents are probed at those places
only: with windows of 13 words, five words at every ninth.  The probes meet the hash set of the items' five-word grams,
broadcast while it is below PROBE_LIMIT grams and shuffled beyond.  Around each probe that meets a gram the whole windows
are then compared word for word, so a hit is never a matter of hashes.

Defined results: null or wordless text has no words, is never hit and, as an item, has no window; rows equal in id and
text get equal results; an item id on several rows stands for all their windows, items without an id still hit words but
aren't counted; an empty benchmark hits nothing.  Other columns are left out of the verdicts, and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import cut, prepare, row_key, shrink_executors

WINDOW = 13
PROBE = 5
#: Grams, and documents with probes that met one, up to which a side is broadcast (some 50 MB); beyond, it is shuffled.
PROBE_LIMIT = 1_000_000
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that isn't lower-cased yet.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text, lower-cased, with one space between; null: none."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _AZ, _AZ.lower()))
    return F.coalesce(F.trim(F.regexp_replace(low, _GAPS, " ")), F.lit(""))


def count_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def _grams(norm: Column, size: int, step: int) -> Column:
    """Runs of `size` words (each with a space behind) that start at multiples of `step`."""
    return F.regexp_extract_all(F.concat(norm, F.lit(" ")), F.lit(rf"(?=((?:[^ ]+ ){{{size}}}))(?:[^ ]+ ){{1,{step}}}"), F.lit(1))


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcast if it has no more rows than limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_text, n_words, n_hit, spans array<struct<s,e>> of hit words (end exclusive), items array<string>: rows with a hit."""
    prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal(F.col("text")).alias("norm"))
    items = items.where(F.col("norm") != "").withColumn("n", count_words(F.col("norm")))
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect())  # 13 numbers at most
    none = docs.limit(0).select(*row_key(F.col(id_col), F.col(text_col)), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    if not lengths:
        return none
    k = min(PROBE, lengths[0])
    step = lengths[0] - k + 1
    windows = cut(items.select("item", F.explode(F.when(F.col("n") < WINDOW, F.array(F.concat("norm", F.lit(" ")))).otherwise(_grams(F.col("norm"), WINDOW, 1))).alias("window")).distinct())
    grams = cut(windows.select(F.explode(_grams(F.rtrim("window"), k, 1)).alias("gram")).distinct())

    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), normal(F.col(text_col)).alias("norm"))
    probes = keyed.select("k_id", "k_text", F.posexplode(_grams(F.col("norm"), k, step)).alias("at", "gram"))
    met = probes.join(_sized(grams, PROBE_LIMIT), "gram", "left_semi")
    places = cut(met.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_set("at")).alias("places")))

    near = keyed.join(_sized(places, PROBE_LIMIT), [keyed["k_id"].eqNullSafe(places["k_id"]), keyed["k_text"] == places["k_text"]]).select(keyed["k_id"], keyed["k_text"], "norm", "places")
    near = near.dropDuplicates(["k_id", "k_text"]).withColumn("words", F.split("norm", " ")).withColumn("n_words", F.size("words").cast("long"))

    def starts(size: int) -> Column:
        def around(b: Column) -> Column:
            first, last = F.greatest(F.lit(0), b * step - (size - k)), F.least(b * step, F.size("words") - size)
            return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct(i.cast("int").alias("s"), (i + size).cast("int").alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

        return F.flatten(F.transform("places", around))

    tried = near.select("k_id", "k_text", "n_words", "words", F.explode(F.array_distinct(F.concat(*map(starts, lengths)))).alias("x"))
    tried = tried.select("k_id", "k_text", "n_words", "x", F.concat(F.array_join(F.slice("words", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")), " "), F.lit(" ")).alias("window"))
    own = windows.groupBy("window").agg(F.collect_set("item").alias("own"))
    found = tried.join(_sized(own, PROBE_LIMIT), "window")
    per = found.groupBy("k_id", "k_text", "n_words").agg(F.sort_array(F.collect_set("x")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n"), F.greatest(a["upto"], x["e"]).alias("upto")))
    return per.withColumn("n_hit", covered["n"]).select("k_id", "k_text", "n_words", "n_hit", "spans", "items")


def _is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    found = hits(docs, benchmark).select(F.col("k_id").alias("h_id"), F.col("k_text").alias("h_text"), F.col("n_hit").alias("h"), "items")
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), count_words(normal(F.col("text"))).alias("n_words"))
    joined = rows.join(found, [rows["k_id"].eqNullSafe(found["h_id"]), rows["k_text"] == found["h_text"]], "left")
    out = joined.select(F.col("k_id").alias("doc_id"), "n_words", F.coalesce("h", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"))
    out = out.withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long")))
    return out.withColumn("contaminated", _is_contaminated())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows; of the rest, the hit words are cut from the text.  Columns stay as they are."""
    shrink_executors(docs.sparkSession)
    found = cut(hits(docs, benchmark).select(F.col("k_id").alias("_loom_id"), F.col("k_text").alias("_loom_text"), "spans", _is_contaminated().alias("_loom_out")).withColumnRenamed("spans", "_loom_spans"))
    shrink_executors(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = docs.join(_sized(found, PROBE_LIMIT), [docs["doc_id"].eqNullSafe(found["_loom_id"]), key == found["_loom_text"]], "left").where(~F.coalesce("_loom_out", F.lit(False)))
    words, gaps = F.regexp_extract_all("text", F.lit(_ANY_WORD), F.lit(0)), F.split("text", _ANY_WORD, -1)
    kept = F.transform(words, lambda w, i: F.when(F.exists("_loom_spans", lambda x: (x["s"] <= i) & (i < x["e"])), "").otherwise(w))
    text = F.concat(gaps[0], F.array_join(F.zip_with(kept, F.slice(gaps, 2, F.size(gaps)), lambda w, g: F.concat(w, g)), ""))
    cut_text = F.when(F.col("_loom_spans").isNotNull(), text).otherwise(F.col("text"))
    size = {"n_chars": F.when(F.col("_loom_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return joined.withColumn("text", cut_text).withColumns(size).select(docs.columns)


#: DuckDB: every window of every document against every window of every item.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) t(i)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
