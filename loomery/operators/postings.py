"""Term postings: weighted counts, TF-IDF vectors, hashed vectors, concept scores.  Vectors are long tables (id, term, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.text import fnv1a, raw_words, normalize_token, tokenize, topic_text, with_bigrams, SEARCH_STOP_WORDS, STOP_WORDS
from loomery.operators.cluster import numbered_terms
from loomery.operators.graph import cut
from loomery.operators.ranking import top

# What an occurrence counts in each field; dimensions, scale and thresholds of the hashed search index.
FIELD_WEIGHTS = {"title": 2.2, "abstract": 1.0, "tags": 0.8}
DIMENSIONS, SCALE, BIGRAM_WEIGHT, LONG_BOOST = 512, 127, 0.58, 0.25


def tags_text() -> Column:
    return F.array_join(F.concat("category_tags", "area_tags", "domain_tags"), " ")


def field_counts(records: DataFrame) -> DataFrame:
    """id, term, tf: weighted counts of words and word pairs; pairs stay within a field.

    Records are dealt by id before they are cut into words: everything about one stays in its task from there on.
    """
    fields = {"title": F.col("title"), "abstract": F.col("abstract"), "tags": tags_text()}
    toks = records.repartition("id").select("id", *[tokenize(c).alias(k) for k, c in fields.items()])
    weighted = [F.transform(with_bigrams(F.col(k)), _weigh(FIELD_WEIGHTS[k])) for k in fields]
    each = toks.select("id", F.explode(F.concat(*weighted)).alias("x"))
    return each.groupBy("id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def _weigh(weight: float):
    return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(counts: DataFrame, n: int) -> DataFrame:
    """id, term, w: unit vectors of (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1); terms of one record alone go if n > 8."""
    df = document_frequency(counts).where(F.col("df") >= (2 if n > 8 else 1))
    idf = F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1
    raw = counts.join(df, "term").select("id", "term", ((1 + F.log("tf")) * idf).alias("w"))
    return unit(raw)


def packed_tfidf(counts: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The vectors of tfidf() as rows id, idx, w, and the number of dimensions.

    Counts meet the frequencies and numbers of their terms in one join, and go from there to their records.
    """
    numbers, dims = numbered_terms(document_frequency(counts).where(F.col("df") >= (2 if n > 8 else 1)))
    weight = (1 + F.log("tf")) * (F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1)
    each = counts.join(numbers, "term").select("id", "i", weight.alias("w"))
    rows = each.groupBy("id").agg(F.collect_list(F.struct("i", "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select("id", F.transform("x", lambda s: s["i"]).alias("idx"), F.transform("x", lambda s: s["w"] / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w")), dims


def unit(raw: DataFrame) -> DataFrame:
    """Rows of each id divided by their root of summed squares: a window, so raw is worked out once."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("norm", norm).select("id", "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def display_forms(records: DataFrame, fields: Column, ord_: str = "ord") -> DataFrame:
    """term, display: the first raw word of each normal form."""
    words = records.select(ord_, F.posexplode(raw_words(fields)).alias("i", "word")).withColumn("term", normalize_token(F.col("word")))
    kept = words.where((F.length("term") > 2) & ~F.col("term").isin(STOP_WORDS))
    return kept.groupBy("term").agg(F.min_by("word", F.struct(ord_, "i")).alias("display"))


def topic_vectors(records: DataFrame, most: int = 6000) -> DataFrame:
    """id, term, w for the topic model: single words, weighted by field; df within bounds, the `most` most frequent terms."""
    n = records.count()
    fields = {"title": topic_text(F.col("title")), "abstract": topic_text(F.col("abstract")), "tags": F.array_join("category_tags", " ")}
    weighted = [F.transform(tokenize(c), _weigh(FIELD_WEIGHTS[k])) for k, c in fields.items()]
    each = records.repartition("id").select("id", F.explode(F.concat(*weighted)).alias("x"))
    counts = each.groupBy("id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))
    least, limit = max(2, -(-3 * n // 1000)), int(0.4 * n)
    kept = document_frequency(counts).where(F.col("df").between(least, limit)).orderBy(F.desc("df"), "term").limit(most)
    return unit(counts.join(F.broadcast(kept), "term").select("id", "term", ((1 + F.log("tf")) * F.log((F.lit(n) + 1.0) / (F.col("df") + 1)) + 1).alias("w")))


def concept_scores(records: DataFrame) -> DataFrame:
    """id, phrase, weight: title phrases count 2, abstract ones 1.4 if the title has them, else 0.6; rare ones more, common ones not at all."""
    n = records.count()
    toks = records.repartition("id").select("id", tokenize(F.col("title")).alias("t"), tokenize(F.col("abstract")).alias("a"))
    parts = toks.select("id", with_bigrams(F.col("t")).alias("t"), with_bigrams(F.col("a")).alias("a"))
    weigh_title = F.transform("t", _weigh(2.0))
    weigh_abstract = F.transform("a", lambda x: F.struct(x.alias("term"), F.when(F.array_contains(F.col("t"), x), 1.4).otherwise(0.6).alias("w")))
    scores = parts.select("id", F.explode(F.concat(weigh_title, weigh_abstract)).alias("x")).groupBy("id", F.col("x.term").alias("phrase")).agg(F.sum("x.w").alias("s"))
    scores = cut(scores)
    df = scores.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= 0.6 * n)
    return scores.join(df, "phrase").select("id", "phrase", (F.col("s") * F.log(1 + n / F.col("df"))).alias("weight"))


def hashed_vectors(texts: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """id, term (the bucket), w: signed hashed vectors of search tokens and pairs, of length 1."""
    toks = texts.repartition(F.col(id_col)).select(F.col(id_col).alias("id"), tokenize(F.col(text), SEARCH_STOP_WORDS).alias("ts"))
    counts = toks.select("id", F.explode(with_bigrams(F.col("ts"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
    h = fnv1a(F.col("token"))
    hashed = counts.withColumn("h", h)
    weight = F.when(F.contains("token", F.lit("_")), BIGRAM_WEIGHT).otherwise(1.0) * (1 + F.log1p("n") + F.when(F.length("token") > 8, LONG_BOOST).otherwise(0.0))
    signed = F.when(F.col("h").bitwiseAND(F.lit(0x10000)) == 0, weight).otherwise(-weight)
    return unit(hashed.groupBy("id", (F.col("h") % DIMENSIONS).alias("term")).agg(F.sum(signed).alias("w")))


def quantised(vectors: DataFrame) -> DataFrame:
    """id, vec array<tinyint>: hashed vectors as whole numbers up to SCALE, truncated towards 0."""
    cell = F.struct(F.col("term").cast("int").alias("i"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("w"))).alias("w"))
    maps = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) * SCALE).cast("tinyint"))
    return maps.select("id", dense.alias("vec"))


def imported(vec: Column) -> Column:
    """An imported vector of length 1 as whole numbers, halves rounded up; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vec, lambda x: F.greatest(F.lit(-SCALE), F.least(F.lit(SCALE), F.floor(x / F.when(norm == 0, 1.0).otherwise(norm) * SCALE + 0.5))).cast("int"))


def top_terms(vectors: DataFrame, members: DataFrame, n_all: int, most: int = 5) -> DataFrame:
    """cluster, term, score, rank: terms whose mean in the cluster most exceeds 0.6 of the corpus mean.

    Vectors are added up once, by term and by the clusters that a record is in; the corpus means come from these sums.
    """
    of = members.groupBy("id").agg(F.collect_list("cluster").alias("clusters"))
    sums = cut(vectors.join(of, "id", "left").groupBy("clusters", "term").agg(F.sum("w").alias("s")))
    corpus = sums.groupBy("term").agg((F.sum("s") / n_all).alias("base"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    own = sums.select(F.explode("clusters").alias("cluster"), "term", "s").groupBy("cluster", "term").agg(F.sum("s").alias("s")).join(sizes, "cluster")
    scored = own.join(corpus, "term").select("cluster", "term", F.round(F.col("s") / F.col("size") - 0.6 * F.col("base"), 6).alias("score"))
    return top(scored, ["cluster"], [F.desc("score"), F.asc("term")], most)
