"""The pipeline end to end, each stage on its own input, on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LANGS = {"en": "the of and to in is that thing with", "fr": "le la les des et que dans est une"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    vocabulary = {k: [*v.split(), *("".join(r.choice(v.replace(" ", "")) for _ in range(6)) for _ in range(400))] for k, v in LANGS.items()}
    prose = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, prose(lang, 120), lang, "s", 1) for i in range(40) for lang in [list(LANGS)[i % 2]]]
    item = prose("en", 30)
    rows.append((100, rows[0][1], "en", "s", 1))  # an exact copy
    rows.append((101, rows[2][1] + " tail", "en", "s", 1))  # a near copy
    rows.append((102, item, "en", "s", 1))  # a benchmark item
    rows.append((103, prose("en", 900) + " " + item, "en", "s", 1))  # a long text with one in it
    rows.append((104, prose("en", 80) + ' token = "abcdef0123456789"', "en", "s", 1))  # a secret
    rows.append((105, "12345 --- 67", None, "s", 1))  # no language
    rows.append((106, None, None, None, None))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_stages_do_what_they_are_named_for(spark, folder):
    path, item = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, path)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(40))
    assert set(seen["language"]) == clean | {100, 101, 102, 103, 104}
    assert set(seen["near_duplicates"]) == clean | {102, 103, 104}
    assert set(seen["decontamination"]) == clean | {103, 104}
    assert item not in seen["decontamination"][103]["text"]
    assert "abcdef0123456789" not in seen["secrets"][104]["text"] and "[secret]" in seen["secrets"][104]["text"]
    assert set(seen["bpe"]) == clean | {103, 104} and all(r["n_tokens"] > 0 for r in seen["bpe"].values())
    run = {r["doc_id"]: r["ids_sha256"] for r in P.run(spark, path).collect()}
    assert run == {i: r["ids_sha256"] for i, r in seen["bpe"].items()}


def test_clean_rows_pass_unchanged(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 40")
    for name, stage in P.STAGES[:-1]:
        assert sorted(map(tuple, stage(spark, docs, path).collect())) == sorted(map(tuple, docs.collect())), name


def test_empty_input(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_odd_rows(spark, folder):
    """Nulls in any column, repeated rows and ids, a very long text, columns whose names the stages use themselves."""
    path, item = folder
    r = random.Random(3)
    words = LANGS["en"].split()
    long = " ".join(r.choice(words) + str(r.randrange(10)) for _ in range(60_000))
    clean = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 40")
    texts = [" ".join(r.choice(words) for _ in range(50)) for _ in range(3)]
    rows = [(300, texts[0], None, None, None), (300, texts[0], None, None, None), (301, texts[1], "en", None, 1), (301, texts[2], "en", None, 1), (None, texts[0], "en", "s", 1), (None, None, None, None, None), (302, "", None, None, 0), (303, long, None, None, None), (None, item, "en", "s", 1)]
    docs = clean.unionByName(spark.createDataFrame(rows, SCHEMA))
    for name in ("node", "key", "p", "spans", "score", "lang_pred", "h_id", "k_id", "n_words", "found", "shared"):
        docs = docs.withColumn(name, F.lit(name))
    columns, out = docs.columns, docs
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, out, path)
        assert k == len(P.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{path}/odd{k}")
        out = spark.read.parquet(f"{path}/odd{k}")
    got = sorted((r["doc_id"] for r in out.collect()), key=lambda i: (i is None, i))
    assert got == [*range(40), 300, 301, 303, None]


def test_foreign_text_and_gibberish_go(spark, tmp_path):
    r = random.Random(2)
    clean = spark.createDataFrame([(i, " ".join(r.choice(LANGS[lang].split()) for _ in range(30 + 5 * i)), lang, "s", 1) for i in range(40) for lang in [list(LANGS)[i % 2]]], SCHEMA)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan heille on annettu järki omatunto toimittava toisiaan kohtaan".split()
    russian = "все люди рождаются свободными и равными в своем достоинстве".split()
    texts = [" ".join(r.choice(words) for _ in range(120)) for words in (finnish, russian)]
    texts += [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)) for n in (30, 120, 900)]
    foreign = spark.createDataFrame([(200 + i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = P.keep_known_languages(spark, clean.unionByName(foreign), str(tmp_path))
    assert {row["doc_id"] for row in kept.collect()} == set(range(40))
