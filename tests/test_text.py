from pyspark.sql import functions as F

from loomery.functions import text as T


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_tokens_drop_stop_words_short_ones_and_endings(spark):
    assert one(spark, T.tokenize(F.col("x")), x="We AI ML") == []
    assert one(spark, T.with_bigrams(T.tokenize(F.col("x"))), x="Neural language models") == ["neural", "language", "model", "neural_language", "language_model"]
    assert one(spark, T.with_bigrams(T.tokenize(F.col("x"))), x=None) == []


def test_white_space_and_null(spark):
    assert one(spark, T.normalize_whitespace(F.col("x")), x=" a ﻿ b\n\tc ") == "a b c"
    assert one(spark, T.normalize_whitespace(F.col("x")), x=None) == ""


def test_document_text_takes_tags_only_without_an_abstract(spark):
    tags = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, T.document_text(F.col("t"), F.col("a"), tags), t="T", a="") == "Title: T\nContext: x y"
    assert one(spark, T.document_text(F.col("t"), F.col("a"), tags), t="T", a="A") == "Title: T\nAbstract: A"


def test_search_form_spells_out_signs(spark):
    assert one(spark, T.search_normal(F.col("x")), x="C++ / C#: 日本!") == "c plusplus c sharp 日本"


def test_names_fold_marks(spark):
    assert one(spark, T.normalized_name(F.col("x")), x="Émile  Zolà-Ñu") == "emile zola nu"


def test_authors_are_parted_and_distinct(spark):
    assert one(spark, T.parse_authors(F.col("x")), x="A B, C and D; A B ⋅ Andrew") == ["A B", "C", "D", "Andrew"]


def test_concepts_leave_out_broad_and_repeated_ones(spark):
    xs = F.array(*[F.lit(v) for v in ("Deep Learning", "Vision  nets", "vision NETS", "b", "c", "d")])
    assert one(spark, T.concrete_concepts(xs, 3), x="") == ["Vision nets", "b", "c"]
    assert one(spark, T.concrete_concepts(xs, 6, F.array(F.lit("B"))), x="") == ["Vision nets", "c", "d"]


def test_slug_falls_back_to_a_hash(spark):
    assert one(spark, T.slugify(F.col("x")), x="A b--C!") == "a-b-c"
    assert one(spark, T.slugify(F.col("x")), x="日本").startswith("record-")


def test_fnv_of_known_strings(spark):
    assert one(spark, T.fnv1a(F.col("x")), x="a") == 0xE40C292C
    assert one(spark, T.fnv1a(F.col("x")), x="foobar") == 0xBF9CF968


def test_tags_are_stripped_and_entities_decoded(spark):
    assert one(spark, T.strip_tags(F.col("x")), x="<b>a &amp; b</b>&nbsp;&#233;<i>c</i>") == "a & b é c"


def test_the_slug_query_has_no_slug_without_letters_or_digits(spark, tmp_path):
    from loomery.plans import catalog

    rows = [(1, "日本 …", "en", "s", 4), (2, "A b--C!", "en", "s", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["slug"] for r in catalog.runs()["c11_slugify"](spark, str(tmp_path)).collect()}
    assert got == {"doc-1": "", "doc-2": "a-b-c"}
