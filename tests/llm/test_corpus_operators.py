"""Top-k, sharding, repeats, near duplicates, decontamination, pseudonyms: against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomery.llm import decontaminate, minhash, pii, sharding, suffix, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "the same " * 12, "en", "s", 8), (4, "the same " * 12, "en", "s", 8), (4, "the same " * 12, "en", "s", 8), (5, "12 34 --", None, "s", 8)]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("x")).withColumn("shard", F.lit(9)).withColumn("spans", F.lit(1)).withColumn("n_words", F.lit(0)).withColumn("k_id", F.lit("k"))


# top-k


def whole(x):
    return int(x) * 256 if abs(x) >= 2.0**52 else math.floor(256 * x)


def brute_top(rows, k):
    good = [(i, [whole(float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            scores = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q)]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "ties", "few", "large", "repeated", "shuffled"])
def test_top_k_agrees_with_sorting(spark, monkeypatch, case):
    rng = np.random.default_rng(6)
    n = 3 if case == "few" else 260
    vec = rng.normal(size=(n, 5)) * (1e4 if case == "large" else 1)
    if case == "ties":
        vec = np.round(vec[rng.integers(0, 4, n)])
    rows = [(i // 3 if case == "repeated" else i, v.tolist()) for i, v in enumerate(vec)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 5), (None, [1.0] * 5), (1150, [float("inf")] * 5)]
    if case == "large":
        rows += [(1200, [1e300, 0.0, 0.0, 0.0, -1.0]), (1201, [-1e300, 2.0, 0.0, 0.0, 0.0]), (1250, [3e15, 1.5, 0.0, 0.0, 0.0]), (1300, [1.0]), (1301, [2.0]), (1350, [])]
    if case == "repeated":
        rows += [(50, [0.5] * 5)] * 3
    if case == "shuffled":
        monkeypatch.setattr(topk, "BROADCAST", 0)
        monkeypatch.setattr(topk, "BLOCK", 2)
        monkeypatch.setattr(topk, "CHUNK", 30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5)


def test_top_k_of_nothing(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(v, F.lit(True), 5).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), F.lit(True), 5).count() == 0


# sharding


def test_shards_are_even_gapless_and_keep_every_row(spark):
    rows = [(i % 40, f"text {i % 9}" * (i % 5), "en", "s", i) for i in range(500)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shuffle_to_shards(docs, 7, bucket_bytes=2000).collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(rows)
    per = Counter(r["shard"] for r in out)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    first = [r["n_chars"] for r in sorted(out, key=lambda r: (r["slot"], r["shard"])) if r["n_chars"] is not None]
    assert first != sorted(first)  # shuffled


def test_fisher_yates_is_a_permutation_with_every_place_alike():
    rng = np.random.default_rng(0)
    counts = np.zeros((4, 4))
    for _ in range(4000):
        counts[np.arange(4), sharding.fisher_yates(4, rng)] += 1
    assert (abs(counts / 4000 - 0.25) < 0.04).all()
    assert len(sharding.fisher_yates(0, rng)) == 0


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))


def test_executors_hand_heap_back_between_passes(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    before = collections(spark)
    assert sharding.shuffle_to_shards(docs, 3).count() == 20
    between = collections(spark)
    assert between >= before + 2
    assert decontaminate.clean(docs, docs.select(F.col("doc_id").alias("item_id"), F.lit("something else").alias("text"))).count() == 20
    assert collections(spark) >= between + 2


def test_sharding_of_odd_and_no_rows(spark, tmp_path):
    out = sharding.shuffle_to_shards(odd(spark), 3)
    assert out.count() == len(ODD) and sharding.shuffle_to_shards(odd(spark).limit(0), 3).count() == 0
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ODD) and set(back.columns) == set(out.columns)


# repeats


def brute_kept(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for a in range(len(b) - 49):
            first.setdefault(b[a : a + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < i:
                cov[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out.append((i, len(b), sum(cov), len([x for x in bytes(cov).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeating_texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdé日") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))), r.choice(passages)[r.randint(0, 40) :], word() * r.choice([1, 30]), r.choice(["", "a" * 120, "ab" * 90, passages[0]])]
        r.shuffle(parts)
        rows.append((i * 3 % 61, " ".join(parts)))
    return rows + [(100, rows[0][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "a" * 400), (105, "a" * 49), (106, "a" * 50), (107, "b" + "a" * 300)]


def test_suffixes_are_sorted():
    r = random.Random(8)
    for _ in range(500):
        s = bytes(r.choice(r.choice([b"ab", b"abc", b"a", b"abcdefgh"])) for _ in range(r.choice([0, 1, 2, 5, 20, 80])))
        assert suffix.grouped_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("flush", [1500, 24_000_000])
def test_repeats_agree_with_brute_force(spark, monkeypatch, flush):
    rows = repeating_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)
    monkeypatch.setattr(suffix, "FLUSH", flush)
    got = suffix.without_repeats(docs).collect()
    assert sorted(map(tuple, got)) == brute_kept(rows)


def run_alone(rows):
    """The operator's functions one after the other, without Spark: what each document loses."""
    texts = pd.DataFrame({"k_id": [i for i, _ in rows], "k_text": 0, "text": [t or "" for _, t in rows]})
    frame = lambda parts: pd.concat(list(parts), ignore_index=True)
    sent = frame(suffix._send_minimisers(3)(iter([texts.iloc[:40], texts.iloc[40:]])))
    answers = frame(suffix._shared_minimisers(g.drop(columns="bucket")) for _, g in sent.groupby("bucket"))
    shared = frame(suffix._by_document(g) for _, g in answers.groupby("flush"))
    sent = frame(suffix._send_stretches(3)(iter([texts.merge(shared, on=["k_id", "k_text"])])))
    covered = frame(suffix._covered(g) for _, g in sent.groupby("bucket"))
    spans = frame(suffix._spans_by_document(g) for _, g in covered.groupby("flush")).set_index("k_id")["spans"]
    out = []
    for i, t in rows:
        rest, removed, runs = suffix.keep_and_span(t, spans.get(i))
        out.append((i, len(rest) + removed, removed, runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "hot", "colliding", "long", "small flushes"])
def test_parts_of_repeats_agree_with_brute_force(monkeypatch, case):
    import pyspark

    class Task:
        @staticmethod
        def get():
            return type("Context", (), {"partitionId": lambda self: 0})()

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    rows = repeating_texts()
    if case == "hot":  # each minimiser of more than one document is split
        monkeypatch.setattr(suffix, "HOT", 1)
    if case == "colliding":  # every stretch looks like every other
        monkeypatch.setattr(suffix, "span_hash", lambda data, a, b: np.zeros(len(a), np.uint64))
    if case == "long":  # every text is taken in overlapping pieces
        monkeypatch.setattr(suffix, "PIECE", 10)
    if case == "small flushes":
        monkeypatch.setattr(suffix, "FLUSH", 1500)
        monkeypatch.setattr(suffix, "ARRAY", 300)
    assert run_alone(rows) == brute_kept(rows)


def test_arrays_hold_only_what_may_repeat(monkeypatch):
    """Texts that share what stands before a minimiser with one text and what stands behind it with another, never 50 bytes."""
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 0})())}))
    sorted_, plain = [], suffix.equal_starts
    monkeypatch.setattr(suffix, "equal_starts", lambda text, length: sorted_.append(len(text)) or plain(text, length))
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    least = min((some(suffix.GRAM) for _ in range(3000)), key=lambda g: min([int(m) for m, n in zip(*suffix.stretches([some(34).encode() + g.encode() + some(34).encode()])[:1:-1], strict=True) if n == 35], default=1 << 48))
    rows = []
    for _ in range(5):
        before, behind = some(22), some(22)
        rows += [some(60) + before + least + behind + some(60), some(60) + before + least + some(60), some(60) + least + behind + some(60)]
    rows = [*enumerate(rows), (99, rows[0])]
    assert run_alone(rows) == brute_kept(rows) and not sorted_
    rows += [(100 + i, rows[3][1][30 + 9 * i : 120 + 9 * i] + some(50)) for i in range(4)]
    assert run_alone(rows) == brute_kept(rows) and 0 < sum(sorted_) < 1000


def test_repeats_of_odd_rows(spark):
    rows = {(r["doc_id"], r["n_removed"]) for r in suffix.without_repeats(odd(spark)).collect()}
    assert rows == {(1, 0), (2, 0), (None, 0), (4, 0), (5, 0)}
    assert suffix.without_repeats(odd(spark).limit(0)).count() == 0


# near duplicates


def near_texts():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    rows, n = [], 0
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([30, 120, 400]))]
        for c in range(r.choice([1, 2, 6])):
            words = list(base)
            for _ in range(c * len(words) // 90):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    return rows + [(n, rows[0][1]), (n + 1, "one two"), (n + 2, "one two"), (n + 3, "One, two!"), (n + 4, None), (n + 5, ""), (n + 6, "!!"), (n + 7, "!!")]


def brute_sets(rows):
    """Weighted sets of texts by the words of the docstring: shingles as strings, counts, logarithms."""
    shingled = []
    for _, t in rows:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        shingled.append(Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    df = Counter(x for c in shingled for x in c)
    return [{x: k * math.log1p(len(rows) / df[x]) for x, k in c.items()} for c in shingled]


def brute_links(rows):
    """All pairs of similarity 0.8 or more: every text against all that share a shingle with it."""
    sets, having = brute_sets(rows), {}
    total = [sum(s.values()) for s in sets]
    found = set()
    for b, own in enumerate(sets):
        least = Counter()
        for x, w in own.items():
            for a in having.get(x, ()):
                least[a] += min(w, sets[a][x])
        found |= {(a, b) for a, m in least.items() if m >= minhash.SIMILAR * (total[a] + total[b] - m) * (1 + 1e-12)}
        for x in own:
            having.setdefault(x, []).append(b)
    return found


def brute_classes(rows):
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    same = {}
    for k, (_, t) in enumerate(rows):
        same.setdefault(t or k, []).append(k)
    pairs = brute_links(rows) | {(x[0], y) for x in same.values() for y in x[1:]}
    for a, b in pairs:
        x, y = root(rows[a][0]), root(rows[b][0])
        label[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("small", [False, True])
def test_classes_agree_with_all_pairs(spark, monkeypatch, small):
    if small:  # blocks, flushes, buckets and hot groups of next to nothing
        for name, value in {"BLOCK": 2, "FLUSH_BYTES": 3000, "BUCKET_BYTES": 5000, "HOT": 1}.items():
            monkeypatch.setattr(minhash, name, value)
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0)).withColumn("key", F.lit(0)).withColumn("p", F.lit(0))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert got == brute_classes(rows)
    if not small:
        kept = {r["doc_id"] for r in minhash.keep_one(docs).collect()}
        assert kept == set(got.values())


def test_near_copies_within_a_large_group_are_found(spark):
    """The group makes its own shingles frequent, and what an edit changes rare; small groups are as before."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]

    def edited(words, edits):
        for at in r.sample(range(5, len(words) - 5), edits):
            words = [*words[:at], word(), *words[at + 1 :]]
        return " ".join(words)

    group = [" ".join(base)] * 20 + [edited(base, 7) for _ in range(30)]
    unlike = [edited(base, 40) for _ in range(3)]
    pair = [word() for _ in range(400)]
    others = [" ".join(word() for _ in range(40)) for _ in range(400)]
    texts = [*group, *unlike, " ".join(pair), edited(pair, 7), edited(pair, 7), *others]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert {i for i, c in got.items() if c == 0} == set(range(50))
    want = brute_classes(list(enumerate(texts)))
    assert all(got[i] == want[i] for i in range(50, len(texts))) and len({want[i] for i in range(50)}) > 10


def test_links_of_whole_documents_are_found(spark):
    """Recall against all pairs of sf0.01, which must be 0.99 or more; classes hold nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    links = brute_links(rows)
    found = sum(got[rows[a][0]] == got[rows[b][0]] for a, b in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    want = brute_classes(rows)
    assert sum(got[i] != want[i] for i in got) <= 0.01 * len(got) and all(got[i] == got[want[i]] or got[i] == i for i in got)


@pytest.mark.parametrize("words", [400, 20_000])
def test_samples_agree_as_often_as_sets_are_similar(words):
    """In short texts, and in those with many more shingles than a table of draws has."""
    sampler = minhash.WeightedSampler()
    hits, trials, rng = 0, 0, np.random.default_rng(1)
    for _ in range(6):
        h = np.sort(rng.integers(0, 1 << 63, words + words // 10, np.uint64))
        w = rng.choice([1.0, 2.0, 7.5], len(h))
        part = rng.permutation(len(h))
        own = [np.sort(part[words // 10 :]), np.sort(part[: len(h) - words // 10])]
        s = np.intersect1d(*own)
        similar = w[s].sum() / w.sum()
        of, at = np.repeat([0, 1], [len(x) for x in own]), np.concatenate(own)
        keys = sampler.band_keys(2, of, h[at], w[at])
        trials += len(keys[0])
        hits += int((keys[0] == keys[1]).sum()) - len(keys[0]) * similar**minhash.ROWS
    assert abs(hits / trials) < 0.15


def test_near_duplicates_of_odd_rows(spark):
    assert {(r["doc_id"], r["class_id"]) for r in minhash.classes(odd(spark)).collect()} == {(1, 1), (2, 2), (4, 4), (5, 5)}
    assert Counter(r["doc_id"] for r in minhash.keep_one(odd(spark)).collect()) == Counter([1, 2, 4, 5, None])
    assert minhash.keep_one(odd(spark)).columns == odd(spark).columns
    assert minhash.classes(odd(spark).limit(0)).count() == 0


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_verdicts(rows, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in rows:
        w = words_of(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= own
        ids = ",".join(sorted(str(i) for i in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("short", [False, True])
def test_verdicts_agree_with_brute_force(spark, short):
    r = random.Random(10)
    vocabulary = ["a", "b", "Cc", "É", "é", "日本", "x9"]
    make = lambda n: [r.choice(vocabulary) + r.choice(["", "", str(r.randrange(9))]) for _ in range(n)]
    items = [(i, " ".join(make(r.choice([13, 14, 20, 40])))) for i in range(12)] + [(12, None), (13, "--")]
    items += [(20, "É é日本"), (21, "a b CC x9 a1"), (22, " ".join(make(9)))] if short else []
    rows = []
    for i in range(60):
        parts = make(r.choice([0, 5, 30, 300]))
        for _ in range(r.randrange(3)):
            own = (r.choice(items)[1] or "").split()
            at = r.randrange(len(parts) + 1)
            parts[at:at] = own[r.randrange(3) :]
        rows.append((i, r.choice([" ", "-", ", \n"]).join(parts).swapcase() if i % 2 else " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "..."), (103, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(0)).withColumn("norm", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.verdicts(docs, bench).collect())) == brute_verdicts(rows, items)


def test_cleaning_cuts_hit_words_and_drops_contaminated_rows(spark):
    window = " ".join(f"w{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = spark.createDataFrame([(1, "A " + window.upper() + ", b. " + filler, None, "s", 1), (2, window, None, "s", 1), (3, "clean", None, "s", 5)], SCHEMA)
    bench = spark.createDataFrame([(0, window)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.clean(docs, bench).collect()}
    assert set(rows) == {1, 3}
    assert words_of(rows[1]["text"]) == ["a", "b", *filler.split()] and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[3]["text"] == "clean"


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(0, "the same the same the same the same the same the same the"), (None, "zz"), (None, None)], "item_id long, text string")
    rows = decontaminate.verdicts(odd(spark), bench).collect()
    assert Counter((r["doc_id"], r["n_hit"], r["contaminated"]) for r in rows) == Counter([(1, 0, False), (2, 0, False), (5, 0, False), (4, 23, True), (4, 23, True), (None, 23, True)])
    assert decontaminate.verdicts(odd(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.verdicts(odd(spark).limit(0), bench).count() == 0
    assert Counter(r["doc_id"] for r in decontaminate.clean(odd(spark), bench).collect()) == Counter([1, 2, 5])


# pseudonyms


def swap(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_card", F.lit(1)).withColumn("found", F.lit(1))
    return [r["text"] for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_values_keep_their_format_and_links(spark):
    a, b, c, d = swap(spark, "card 4111 1111-1111 1111 end", "4111111111111111, again", "no card: 4111111111111112", "mail Jo.B-9@x.org and jo.b-9@x.org")
    m = re.fullmatch(r"card (\d{4}) (\d{4})-(\d{4}) (\d{4}) end", a)
    number = "".join(m.groups())
    assert luhn(number) and number != "4111111111111111" and b == number + ", again"
    assert c == "no card: 4111111111111112"
    left, right = re.fullmatch(r"mail ([a-z0-9]{2}\.[a-z0-9]-[a-z0-9])@x\.org and (\S+)@x\.org", d).groups()
    assert left == right != "jo.b-9"


def test_dates_addresses_phones_and_numbers_of_people(spark):
    ip, iso, dmy, mdy, ssn, bad, phone, iban = swap(spark, "ip 10.2.3.4.", "on 2001-02-28!", "31/12/1999", "12.31.1999", "123-45-6789", "000-45-6789 2001-02-30 900-10-1000", "+1 (017) 555-7713 x", "DE89 3704 0044 0532 0130 00 y")
    assert all(0 <= int(x) <= 255 for x in re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+)\.", ip).groups()) and ip != "ip 10.2.3.4."
    import datetime as dt

    assert 1700 <= dt.date.fromisoformat(re.fullmatch(r"on (\S+)!", iso)[1]).year < 2100
    dt.datetime.strptime(dmy, "%d/%m/%Y"), dt.datetime.strptime(mdy, "%m.%d.%Y")
    area, group, serial = map(int, ssn.split("-"))
    assert 1 <= area <= 899 and area != 666 and 1 <= group <= 99 and 1 <= serial
    assert bad == "000-45-6789 2001-02-30 900-10-1000"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} x", phone) and phone != "+1 (017) 555-7713 x"
    x = iban[:-2].replace(" ", "")
    assert len(x) == 22 and int(x[4:] + "1314" + x[2:4]) % 97 == 1 and iban != "DE89 3704 0044 0532 0130 00 y"


def test_account_numbers_with_letters(spark):
    ibans = ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "DE89 3704 0044 0532 0130 00"]
    number = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    got = swap(spark, *[f"pay {x}, now" for x in ibans], "pay GB82WEST12345698765432, now", "pay GB83 WEST 1234 5698 7654 32, now", "BE68 5390 0754 7034 THEN", "FR76 CARD 4111 1111 1111 1111")
    for old, new in zip(ibans, got):
        value = re.fullmatch(r"pay (.*), now", new)[1]
        kinds = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", "A", x))
        assert kinds(value) == kinds(old) and value[:2] == old[:2] and value[4:] != old[4:] and number(value.replace(" ", "")) == 1
        assert re.sub("[^A-Z]", "", value[4:]) != re.sub("[^A-Z]", "", old[4:]) or not re.search("[A-Z]", old[4:])
    assert got[5] == got[0].replace(" ", "").replace("pay", "pay ").replace(",now", ", now")
    assert got[6] == "pay GB83 WEST 1234 5698 7654 32, now"
    assert got[7].endswith(" THEN") and got[7] != "BE68 5390 0754 7034 THEN" and number(got[7][:-5].replace(" ", "")) == 1
    assert got[8].startswith("FR76 CARD ") and luhn(re.sub("[^0-9]", "", got[8][10:])) and "4111 1111" not in got[8]


def test_different_values_stay_different(spark):
    days = [f"{y}-{m:02d}-01" for y in range(1950, 2000) for m in range(1, 13)]
    swapped = swap(spark, " ".join(days))[0].split()
    assert len(set(swapped)) == len(days) and swapped != days
    phones = [f"(555) 010-{i:04d}" for i in range(300)]
    got = re.findall(r"\(\d{3}\) \d{3}-\d{4}", swap(spark, "; ".join(phones))[0])
    assert len(set(got)) == 300
    assert swap(spark, "10.0.0.1", key="a") != swap(spark, "10.0.0.1", key="b")


def test_pseudonyms_of_odd_rows(spark):
    rows = pii.pseudonymise(odd(spark), "k").collect()
    assert Counter((r["doc_id"], r["text"], r["n_values"]) for r in rows) == Counter((d, t, 0) for d, t, *_ in ODD)
    assert pii.pseudonymise(odd(spark).limit(0), "k").count() == 0
    long = "a" * 200_000 + " x@y.org " + "1" * 100_000
    assert swap(spark, long)[0].endswith("@y.org " + "1" * 100_000)


class Twin:
    """The permutations in plain Python, forwards or backwards."""

    def __init__(self, key, back=False):
        self.key, self.rounds = key, range(pii.ROUNDS)[:: -1 if back else 1]
        self.sign = -1 if back else 1
        self.pattern = re.compile(pii._joined())
        self.kinds = {k: re.compile(p) for k, p in pii.PATTERNS.items()}

    def feistel(self, left, right, a, b, *salt):
        for i in self.rounds:
            half = right if i % 2 == 0 else left
            h = int(hashlib.sha256(":".join(map(str, (self.key, *salt, i, half))).encode()).hexdigest()[:15], 16)
            if i % 2 == 0:
                left = (left + self.sign * h) % a
            else:
                right = (right + self.sign * h) % b
        return left, right

    def string(self, x, alphabet, *salt):
        n, base = len(x), len(alphabet)
        half = n // 2
        number = lambda s: sum(alphabet.index(c) * base**i for i, c in enumerate(reversed(s)))
        text = lambda v, k: "".join(alphabet[v // base**i % base] for i in reversed(range(k)))
        a, b = self.feistel(number(x[:half]), number(x[half:]), base**half, base ** (n - half), salt[0], n, *salt[1:])
        return text(a, half) + text(b, n - half)

    @staticmethod
    def refill(form, fill, which):
        new = iter(fill)
        return "".join(next(new) if re.match(which, c) else c for c in form)

    def kind(self, m):
        import datetime as dt

        d = re.sub("[^0-9]", "", m)
        whole = lambda k: self.kinds[k].fullmatch(m)
        if whole("email"):
            return "email", None
        if whole("date"):
            for f in ["%Y%m%d"] if re.match("[0-9]{4}", m) else ["%d%m%Y", "%m%d%Y"]:
                try:
                    return "date", (f, dt.datetime.strptime(d, f).date())
                except ValueError:
                    pass
        if whole("ip"):
            return "ip", None
        if whole("ssn") and not re.search("^(?:000|666|9)|-00-|-0000$", m):
            return "ssn", None
        x = m.replace(" ", "")
        if whole("iban") and 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1:
            return "iban", None
        if whole("card") and luhn(d):
            return "card", None
        return ("phone" if whole("phone") else None), None

    def swap(self, m):
        import datetime as dt

        kind, more = self.kind(m)
        d, digits, small = re.sub("[^0-9]", "", m), "0123456789", "abcdefghijklmnopqrstuvwxyz"
        if kind == "email":
            name, host = m.split("@", 1)
            name = name.lower()
            plain = re.sub("[^a-z0-9]", "", name)
            pieces = [self.string(plain[i : i + pii.PIECE], digits + small, "email", i // pii.PIECE) for i in range(0, len(plain), pii.PIECE)]
            return self.refill(name, "".join(pieces), "[a-z0-9]") + "@" + host
        if kind == "date":
            n = (more[1] - dt.date(1700, 1, 1)).days
            a, b = self.feistel(n // 773, n % 773, 189, 773, "date")
            return self.refill(m, (dt.date(1700, 1, 1) + dt.timedelta(a * 773 + b)).strftime(more[0]), "[0-9]")
        if kind == "ip":
            o = list(map(int, m.split(".")))
            a, b = self.feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if kind == "ssn":
            area, group, serial = map(int, m.split("-"))
            a, b = self.feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
            return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
        if kind == "iban":
            land, tail = m[:2], m[4:]
            new = self.string(re.sub("[^0-9]", "", tail), digits, "iban", land) if re.search("[0-9]", tail) else ""
            letters = re.sub("[^A-Z]", "", tail)
            caps = "".join(self.string(letters[i : i + 12], small.upper(), "iban letters", i // 12, land) for i in range(0, len(letters), 12))
            tail = self.refill(self.refill(tail, new, "[0-9]"), caps, "[A-Z]")
            return f"{land}{98 - int(''.join(str(int(c, 36)) for c in tail.replace(' ', '') + land + '00')) % 97:02d}{tail}"
        if kind == "card":
            body = self.string(d[:-1], digits, "card")
            return self.refill(m, body + next(c for c in digits if luhn(body + c)), "[0-9]")
        if kind == "phone":
            code = re.match(r"\+[0-9]{1,3}(?=[ .-])|\+[0-9]|", m)[0]
            rest = m[len(code) :]
            return code + self.refill(rest, self.string(re.sub("[^0-9]", "", rest), digits, "phone", code), "[0-9]")
        return m

    def text(self, t):
        return self.pattern.sub(lambda m: self.swap(m[0]), t)


def values(r):
    """Values of every kind, valid ones and others, with e-mail names of 1 to 64 characters."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    out = ["".join(r.choice(letters) for _ in range(n)) + "@example.com" for n in range(1, 65)]
    out += ["z" * n + "@example.com" for n in range(1, 65)] + ["9" * 24 + "@x.org", "a.b-c_d+e%f" * 5 + "@mail.example.org", "...@x.org"]
    for _ in range(40):
        n = "".join(r.choice("0123456789") for _ in range(r.choice([12, 15, 18])))
        out.append(n + next(c for c in "0123456789" if luhn(n + c)))
        out.append(f"{r.randrange(1, 900):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}")
        out.append(".".join(str(r.randrange(256)) for _ in range(4)))
        out.append(f"{r.randrange(1700, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}")
        out.append(f"{r.randrange(1, 29):02d}/{r.randrange(1, 13):02d}/{r.randrange(1700, 2100)}")
        out.append(f"+{r.choice(['1', '44', '351'])} {r.randrange(10, 999)} {r.randrange(100, 9999)} {r.randrange(100, 9999)}")
        out.append(f"({r.randrange(100, 1000)}) {r.randrange(100, 1000)}-{r.randrange(1000, 10000)}")
        bban = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + "".join(r.choice("0123456789") for _ in range(14))
        out.append(f"GB{98 - int(''.join(str(int(c, 36)) for c in bban + 'GB00')) % 97:02d}{bban}")
    return out


def test_pseudonyms_agree_with_plain_python_and_can_be_undone_with_the_key(spark):
    r = random.Random(12)
    texts = [f"see {v}, end" for v in values(r)] + ["; ".join(r.sample(values(r), 30)) for _ in range(10)]
    got = swap(spark, *texts, key="some key")
    assert got == [Twin("some key").text(t) for t in texts]
    back = [Twin("some key", back=True).text(t) for t in got]
    assert back == [Twin("some key").pattern.sub(lambda m: m[0].split("@")[0].lower() + m[0][len(m[0].split("@")[0]) :] if "@" in m[0] else m[0], t) for t in texts]
    assert swap(spark, *texts[:5], key="other") != got[:5]


def test_long_names_are_permuted_one_to_one(spark):
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = sorted({f"{a}{b}{'z' * 22}" for a in letters for b in letters} | {f"{'z' * 22}{a}{b}" for a in letters for b in letters})
    got = [t.split("@")[0] for t in swap(spark, *[f"{n}@example.com" for n in names])]
    assert len(set(got)) == len(names) and {len(n) for n in got} == {24}


def test_pseudonyms_need_a_key(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(odd(spark), "")
