"""Near duplicates by improved consistent weighted sampling.

A text is a weighted set: shingles of five words, each weighted by its count times its inverse document frequency.  Two
texts are linked if their weighted Jaccard similarity, the sum of the smaller weights over the sum of the larger ones, is
0.8 or more; classes are what links connect.  In a large group of copies the group itself makes its shingles frequent, so
the few that an edit changes outweigh them, the more so the more documents there are.  Texts with half of their shingles in
FAMILY or more documents are therefore also linked with one another if they are as similar by counts alone.

* Exact copies are grouped first; one text stands for each group, and counts for all of it in what follows.
* Document frequencies are exact, over all documents.  Texts are dealt to flushes by a hash of their key; each flush sends the
  distinct shingles that it has, with counts, to buckets by hash range; a bucket adds up and answers only where a count
  differs from what the flush knows itself, that is for shingles that other flushes have too.  A flush is dealt anew, with
  the answers, to draw the samples: what it holds follows from keys alone, so a task that is tried again finds it the same.
* Each of 64 consistent weighted samples is one shingle (and level) that two texts share with a chance equal to their
  similarity.  Sixteen bands of four samples make the buckets: texts at 0.8 meet in one with a chance of 0.9998.
  Texts that may be linked by counts alone are sampled by these as well, into as many further buckets.
* In a bucket every text is compared with the first.  Where these links leave a bucket in several parts, its texts outside
  the largest part are compared with all others of the bucket, in blocks of bounded size, each by one pass over the
  block's shingles.  So no link between parts is missed, and of the links that a text has to one part a single one is
  kept: no group's pairs are ever written out.

Defined results: rows that share an id are one document; rows without an id are in no class; null or wordless texts are
in a class of their own (with exact copies, if not empty); a text of fewer than five words is one shingle; repeated rows
count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import cut, give_back, prepare, release
from loomery.llm.words import mix, shingles, slices

SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: Documents from which on a shingle's frequency may be owed to one group of copies.
FAMILY = 16
TABLE_BITS = 16
SEED = 17
#: Texts of a bucket that are compared with as many others in one task.
BLOCK = 500
#: Bytes of text in a flush, and for each bucket of shingles: a worker holds some ten times as much.
FLUSH_BYTES, BUCKET_BYTES = 6_000_000, 10_000_000
#: Documents up to which the side of a join that holds only ids is broadcast (16 MB).
ID_LIMIT = 1_000_000
#: Rows of one key beyond which its group is joined by broadcast; there are at most 100 000 such groups.
HOT = 1000


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _all_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for at, upto in slices(texts):
        of, h, count = shingles(texts[at:upto])
        parts.append((of + at, h, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))  # type: ignore[return-value]


def _own_counts(texts: list[str], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """of, hash and count of a flush's shingles; place of each in the distinct ones, in order; how many documents have them."""
    of, h, count = _all_shingles(texts)
    distinct, place = np.unique(h, return_inverse=True)
    return of, count, distinct, place, np.bincount(place, copies[of], len(distinct)).astype(np.uint64)


def _edges(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hash range begins among distinct hashes in order."""
    return np.searchsorted((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _send_counts(buckets: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "p"], ignore_index=True)
        _, _, distinct, _, own = _own_counts(list(pdf["text"]), pdf["copies"].to_numpy(np.float64))
        edges = _edges(distinct, buckets)
        flush = int(pdf["flush"].iloc[0]) if len(pdf) else 0
        rows = [(b, flush, pack(np.diff(distinct[s:e], prepend=np.uint64(0))), pack(own[s:e])) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "flush", "hashes", "counts"])

    return send


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each flush the places of shingles whose count is larger than its own, and their counts."""
    hashes = [np.cumsum(unpack(x)) for x in pdf["hashes"]]
    counts = [unpack(x) for x in pdf["counts"]]
    distinct, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts).astype(np.float64), len(distinct)).astype(np.uint64)
    rows, at = [], 0
    for flush, bucket, own in zip(pdf["flush"], pdf["bucket"], counts, strict=True):
        all_ = total[back[at : at + len(own)]]
        at += len(own)
        more = np.flatnonzero(all_ > own)
        if len(more):
            rows.append((flush, bucket, pack(np.diff(more, prepend=0)), pack(all_[more])))
    give_back()
    return pd.DataFrame(rows, columns=["flush", "bucket", "places", "counts"])


def _draw(buckets: int, n: int):
    sampler: list[WeightedSampler] = []

    def draw(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not sampler:
            sampler.append(WeightedSampler())
        texts = texts.sort_values(["node", "p"], ignore_index=True)
        of, count, distinct, place, own = _own_counts(list(texts["text"]), texts["copies"].to_numpy(np.float64))
        edges = _edges(distinct, buckets)
        for bucket, places, counts in zip(answers["bucket"], answers["places"], answers["counts"], strict=True):
            own[edges[bucket] + np.cumsum(unpack(places)).astype(np.int64)] = unpack(counts)
        df = own[place]
        keys = sampler[0].band_keys(len(texts), of, distinct[place], weigh(count, df, n))
        crowd = np.flatnonzero(crowded(len(texts), of, count, df))
        some = np.isin(of, crowd)
        for i, more in zip(crowd, sampler[0].band_keys(len(crowd), np.searchsorted(crowd, of[some]), distinct[place][some], count[some]), strict=True):
            keys[i] = np.append(keys[i], mix(~more.view(np.uint64)).view(np.int64))
        ends = np.searchsorted(of, np.arange(len(texts) + 1))
        rows = [(node, p, k, pack(df[s:e])) for node, p, k, s, e in zip(texts["node"], texts["p"], keys, ends[:-1], ends[1:], strict=True) if k is not None]
        give_back()
        return pd.DataFrame(rows, columns=["node", "p", "keys", "df"])

    return draw


def weigh(count: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF: the weight of shingles that a text has `count` times, and df of n documents have."""
    return count * np.log1p(n / df.astype(np.float64))


def crowded(texts: int, of: np.ndarray, count: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Whether half of a text's shingles or more stand in FAMILY documents."""
    many = np.bincount(of, count, texts)
    return (2 * np.bincount(of, np.where(df >= FAMILY, count, 0), texts) >= many) & (many > 0)


def signatures(reps: DataFrame, n: int) -> DataFrame:
    """node, p, keys array<long> (twice as many for crowded texts), df (packed document frequencies of its distinct shingles, by hash) of each text with words.

    reps: node, p (which name a text), copies (documents that have it), text; n: how many documents there are.
    """
    spark = reps.sparkSession
    total = reps.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flushes, buckets = max(tasks, -(-total // FLUSH_BYTES)), max(tasks, -(-total // BUCKET_BYTES))
    dealt = reps.withColumn("flush", F.pmod(F.xxhash64("node", "p"), F.lit(flushes)))
    sent = dealt.repartition(flushes, "flush").groupBy("flush").applyInPandas(_send_counts(buckets), "bucket long, flush long, hashes binary, counts binary")
    answers = cut(sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_add_up, "flush long, bucket long, places binary, counts binary"))
    del sent
    release(spark)
    drawn = dealt.repartition(flushes, "flush").groupBy("flush").cogroup(answers.repartition(flushes, "flush").groupBy("flush"))
    signed = cut(drawn.applyInPandas(_draw(buckets, n), "node long, p string, keys array<long>, df binary"))
    del drawn, answers, dealt
    release(spark)
    return signed


class WeightedSampler:
    """Improved consistent weighted sampling of BANDS * ROWS samples, from tables of seeded Gamma and uniform numbers."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        shape = (BANDS * ROWS, 1 << TABLE_BITS)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32) + np.float32(256)
        self.beta = rng.random(shape, np.float32)
        self.salts = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def band_keys(self, texts: int, of: np.ndarray, h: np.ndarray, w: np.ndarray) -> list[np.ndarray | None]:
        """BANDS bucket keys for each of `texts` texts, from text (in order), hash and weight of all shingles; None without any."""
        out: list[np.ndarray | None] = [None] * texts
        firsts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        at = 0
        while at < len(firsts) - 1:  # whole texts, some 30 000 shingles at a time: arrays stay in the processor's cache
            upto = max(at + 1, int(np.searchsorted(firsts, firsts[at] + 30_000, "right")) - 1)
            s, e = firsts[at], firsts[upto]
            for i, row in zip(of[firsts[at:upto]], self._keys(h[s:e], w[s:e], firsts[at:upto] - s), strict=True):
                out[i] = row.view(np.int64)
            at = upto
        return out

    def _keys(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(h)
        log_w = np.log(w).astype(np.float32)
        index = np.arange(n, dtype=np.uint64)
        samples = np.empty((len(starts), BANDS * ROWS), np.uint64)
        cell, packed = np.empty(n, np.uint64), np.empty(n, np.uint64)
        r, beta, level, log_a = (np.empty(n, np.float32) for _ in range(4))
        for j in range(BANDS * ROWS):
            np.multiply(h, self.salts[j], out=cell)
            np.right_shift(cell, np.uint64(64 - TABLE_BITS), out=cell)
            at_cell = cell.view(np.int64)
            np.take(self.r[j], at_cell, out=r, mode="clip")
            np.take(self.beta[j], at_cell, out=beta, mode="clip")
            np.take(self.log_c[j], at_cell, out=log_a, mode="clip")
            np.divide(log_w, r, out=level)
            np.add(level, beta, out=level)
            np.floor(level, out=level)
            np.subtract(level, beta, out=beta)
            np.add(beta, np.float32(1), out=beta)
            np.multiply(beta, r, out=beta)
            np.subtract(log_a, beta, out=log_a)  # log c - r * (level - beta + 1), moved above 0 so that its bits are in order
            packed[:] = log_a.view(np.uint32)
            np.left_shift(packed, np.uint64(32), out=packed)
            np.bitwise_or(packed, index, out=packed)
            best = (np.minimum.reduceat(packed, starts) & np.uint64(0xFFFFFFFF)).astype(np.intp)
            samples[:, j] = mix(h[best] + level[best].astype(np.int64).astype(np.uint64) * self.salts[j])
        keys = np.zeros((len(starts), BANDS), np.uint64)
        for k in range(ROWS):
            keys = mix(keys * np.uint64(31) + samples[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64)[None, :])
        return keys


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of two weighted sets of (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    common = a[0][at] == b[0]
    least = float(np.minimum(a[1][at[common]], b[1][common]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least)


def weighted_sets(texts: list[str], dfs: list[bytes], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sorted hashes, weights, counts) of texts, from the packed document frequencies of their shingles; counts are 0 unless crowded."""
    of, h, count = _all_shingles(texts)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    df = np.concatenate([np.zeros(0, np.uint64), *map(unpack, dfs)])
    weight, plain = weigh(count, df, n), np.where(crowded(len(texts), of, count, df)[of], count, 0)
    return [(h[s:e], weight[s:e], plain[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]


def linked(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
    """Whether two of weighted_sets() are similar, by weights or, if both are crowded, by counts."""
    if weighted_jaccard(a[:2], b[:2]) >= SIMILAR:
        return True
    return bool(a[2].any() and b[2].any()) and weighted_jaccard(a[::2], b[::2]) >= SIMILAR


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(ID_LIMIT + 1).count() <= ID_LIMIT else df


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: Column, n: int) -> DataFrame:
    """rows joined with their groups (one row a key); groups of many rows are broadcast, so no task gets a whole one.

    n bounds the sum of sizes: at most 100 000 groups are hot.
    """
    is_hot = size > max(HOT, n // 100_000)
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(~is_hot), key)
    return rows.join(hot, key).unionByName(cold)


def _texts(reps: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text, df of the texts of some nodes."""
    own = reps.select("node", "p", "text").join(_sized(nodes), "node", "left_semi")
    return own.join(signed.select("node", "p", "df"), ["node", "p"]).select("node", "text", "df")


def _links(pairs: DataFrame, reps: DataFrame, signed: DataFrame, n: int) -> DataFrame:
    """Those pairs (a, b) of ids whose texts are similar."""
    pairs = cut(pairs)
    needed = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    texts = _texts(reps, signed, needed)
    # the first of a large bucket is in many pairs: it gets a copy for each BLOCK of them
    many = _sized(cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where(F.col("parts") > 1)))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"), F.col("df").alias("da")).join(many, "a", "left")
    first = first.select("a", "ta", "da", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb"), F.col("df").alias("db")), "b").join(first, ["a", "part"])

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                some = b.iloc[at : at + 64]
                own = dict(zip([*some["ta"], *some["tb"]], [*some["da"], *some["db"]], strict=True))
                sets = dict(zip(own, weighted_sets(list(own), list(own.values()), n), strict=True))
                keep = [linked(sets[x], sets[y]) for x, y in zip(some["ta"], some["tb"], strict=True)]
                yield some.loc[keep, ["a", "b"]]
        give_back()

    return cut(both.select("a", "b", "ta", "tb", "da", "db").mapInPandas(similar, "a long, b long").distinct())


def _links_between_parts(buckets: DataFrame, labels: DataFrame, reps: DataFrame, signed: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between the parts (labels) of each bucket: one for each text outside the largest part and each other part."""
    spark = reps.sparkSession
    named = cut(buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part")))
    parts = named.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("core"), F.max("n").alias("largest"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), F.sum("sum").alias("sum"))
    open_ = open_.where(F.col("parts") > 1).groupBy("size", "sum", "core", "largest").agg(F.min("key").alias("key"))  # bands with the same texts once
    sizes = open_.select("key", "core", F.ceil(F.col("size") / BLOCK).alias("rows"), F.ceil((F.col("size") - F.col("largest")) / BLOCK).alias("cols"))
    own = named.join(_sized(cut(sizes)), "key").withColumn("outside", F.col("part") != F.col("core"))
    own = own.withColumns({"row": F.pmod(F.xxhash64("node"), F.col("rows")), "col": F.pmod(F.xxhash64(F.lit(1), "node"), F.col("cols"))})
    own = cut(own.select("key", "node", "part", "outside", "rows", "cols", "row", "col"))
    nodes = own.count()
    if not nodes:
        return spark.createDataFrame([], "a long, b long")
    all_ = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    against = own.select("key", "node", "part", "rows", "cols", "row", all_("cols").alias("col"), F.lit(False).alias("asks"))
    asking = own.where("outside").select("key", "node", "part", "rows", "cols", all_("rows").alias("row"), "col", F.lit(True).alias("asks"))
    packs = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), nodes // BLOCK)
    small = F.pmod(F.xxhash64("key"), F.lit(packs))  # buckets of one block share tasks
    dealt = against.unionByName(asking).withColumn("pack", F.when((F.col("rows") == 1) & (F.col("cols") == 1), small).otherwise(F.xxhash64("key", "row", "col")))
    texts = _texts(reps, signed, cut(own.select("node").distinct()))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in pdf.groupby(["key", "row", "col"], sort=False):
            found += _compare_block(rows, n)
        give_back()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    blocks = dealt.join(texts, "node").select("pack", "key", "row", "col", "node", "part", "asks", "text", "df")
    return cut(blocks.groupBy("pack").applyInPandas(compare, "a long, b long").distinct())


def _compare_block(rows: pd.DataFrame, n: int) -> list[tuple[int, int]]:
    """Of each asking text the first similar one in each other part among those that don't ask."""
    there, asking = rows[~rows["asks"]], rows[rows["asks"]]
    if not len(there) or not len(asking):
        return []
    nodes, parts = there["node"].to_numpy(), there["part"].to_numpy()
    sets = weighted_sets(list(there["text"]), list(there["df"]), n)
    sizes = np.array([len(s[0]) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    names, number = np.unique(np.concatenate([s[0] for s in sets] or [np.zeros(0, np.uint64)]), return_inverse=True)
    weight = np.concatenate([s[1] for s in sets] or [np.zeros(0)])
    total = np.bincount(of, weight, minlength=len(sets))
    plain = np.concatenate([s[2] for s in sets] or [np.zeros(0, np.int64)])
    crowd = np.flatnonzero(plain)
    many = np.bincount(of, plain, minlength=len(sets))
    found = []
    asked = weighted_sets(list(asking["text"]), list(asking["df"]), n)
    for node, part, (h, w, c) in zip(asking["node"], asking["part"], asked, strict=True):
        own = np.zeros(len(names) + 1)
        at = np.searchsorted(names, h)
        known = (at < len(names)) & (names[np.minimum(at, max(0, len(names) - 1))] == h) if len(names) else np.zeros(len(h), bool)
        own[at[known]] = w[known]
        least = np.bincount(of, np.minimum(own[number], weight), minlength=len(sets))
        alike = (least >= SIMILAR * (total + w.sum() - least)) & (least > 0)
        if len(crowd) and c.any():
            own[at[known]] = c[known]
            least = np.bincount(of[crowd], np.minimum(own[number[crowd]], plain[crowd]), minlength=len(sets))
            alike |= (least >= SIMILAR * (many + c.sum() - least)) & (least > 0)
        similar = np.flatnonzero(alike & (parts != part))
        _, first = np.unique(parts[similar], return_index=True)
        found += [(min(node, nodes[i]), max(node, nodes[i])) for i in similar[first]]
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, label: for each node of edges (a, b) the smallest node that it is connected with."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        near = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(jump, "label").select("node", F.least("label", "further").alias("label"), "old"))
        labels = new.select("node", "label")
        if not new.where(F.col("label") != F.col("old")).limit(1).count():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest id of the class) for each distinct id."""
    prepare(docs.sparkSession)
    with_id = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with_id = with_id.withColumn("p", F.when(F.col("text") != "", F.md5("text")).otherwise(F.concat(F.lit("id"), F.col("doc_id").cast("string"))))
    counted = cut(with_id.groupBy("doc_id", "p").agg(F.count(F.lit(1)).alias("times")))
    prints = counted.select("doc_id", "p")
    n = prints.count()
    firsts = cut(prints.groupBy("p").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))

    if counted.where(F.col("times") > 1).limit(1).count():
        with_id = with_id.dropDuplicates(["doc_id", "p"])
    reps = with_id.join(_sized(firsts.select(F.col("node").alias("doc_id"), "p", "copies")), ["doc_id", "p"]).select(F.col("doc_id").alias("node"), "p", "copies", "text")
    signed = signatures(reps, n)
    spread = signed.select("node", F.explode("keys").alias("key"))
    shared = cut(spread.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last")))
    buckets = cut(join_hot(spread, shared.select("key", "first", "n"), "key", F.col("n"), 2 * BANDS * n).select("node", "key", "first").distinct())

    tried = buckets.where(F.col("first") < F.col("node")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = _links(tried, reps, signed, n)
    labels = components(links)
    more = _links_between_parts(buckets, labels, reps, signed, n)
    if more.limit(1).count():
        labels = components(links.union(more))
    named = cut(firsts.join(labels, "node", "left").select("p", F.coalesce("label", "node").alias("label"), "copies"))
    joined = join_hot(prints, named, "p", F.col("copies"), n).select("doc_id", "label")
    # ids that stand on rows of several texts connect these
    several = joined.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where(F.col("a") < F.col("b"))
    several = cut(several.select("a", "b").distinct())
    if several.limit(1).count():
        again = components(several).select(F.col("node").alias("label"), F.col("label").alias("whole"))
        joined = joined.join(_sized(again), "label", "left").select("doc_id", F.coalesce("whole", "label").alias("label"))
    return joined.groupBy("doc_id").agg(F.min("label").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of its class, one row an id; rows without an id stay."""
    own = cut(classes(docs).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_loom_id")))
    ids = docs.where(F.col("doc_id").isNotNull())
    kept = docs.join(own, docs["doc_id"] == own["_loom_id"], "left").where(F.col("_loom_id").isNotNull() | F.col("doc_id").isNull()).drop("_loom_id")
    if ids.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count():
        repeated = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
        return repeated.unionByName(kept.where(F.col("doc_id").isNull()))
    return kept
