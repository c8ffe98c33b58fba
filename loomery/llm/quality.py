"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Each text becomes a row of numbers (kinds of characters, words, lines, repetition); the trees are grown from histograms
of binned statistics, then flattened into arrays, and a batch is scored by stepping all rows down all trees at once.

The labelled rows learned from are bounded by SAMPLE, chosen by a seeded hash; all rows are scored, over whole texts.

Defined results: null text counts as empty and gets the score of the empty text's statistics; with no labels every score
is 0.5; labels other than 0 and 1, or null, are not learned; a document with several labels is learned once for each;
repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import crc_of_id, give_back, prepare

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.2, 10, 1.0
SEED = 11

_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _WIDE = range(7)
_CLASS = np.full(256, _SYMBOL, np.int8)
_CLASS[97:123] = _LETTER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[44, 46, 33, 63]] = _STOP  # , . ! ?
_CLASS[128:] = _WIDE
_ODD = np.uint64(0x9E3779B97F4A7C15)

NAMES = ("log_bytes", "log_words", "letters", "upper", "digits", "stops", "symbols", "wide", "word_bytes", "word_spread", "distinct_words", "repeats_next", "top_word", "log_lines", "line_words", "distinct_lines", "bars", "hashes", "symbol_ends", "short_words")


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(data)
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    power[1:] = _ODD
    np.multiply.accumulate(power, out=power)
    inverse = np.empty(n + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(int(_ODD), -1, 1 << 64))
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of distinct hashes and the count of the most frequent one."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), top


def statistics(texts: list[str]) -> np.ndarray:
    """A row of statistics for each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    n, size = len(raw), np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    doc = np.repeat(np.arange(n), size + 1)
    kind = _CLASS[data]
    kinds = np.bincount(doc * 7 + kind, minlength=7 * n).reshape(n, 7).astype(float)
    kinds[:, _SPACE] -= 1  # the joint
    full = np.maximum(1.0, size)
    space = kind == _SPACE
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    words = doc[starts]
    count = np.bincount(words, minlength=n).astype(float)
    some = np.maximum(1.0, count)
    length = (ends - starts).astype(float)
    mean = np.bincount(words, length, minlength=n) / some
    spread = np.sqrt(np.maximum(0.0, np.bincount(words, length**2, minlength=n) / some - mean**2))
    h = _span_hash(data, starts, ends)
    distinct, top = _distinct(words, h, n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (words[1:] == words[:-1])
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    lines = doc[breaks]
    line_count = np.bincount(lines, minlength=n).astype(float)
    line_distinct, _ = _distinct(lines, _span_hash(data, line_starts, breaks), n)
    at_end = np.bincount(words, kind[ends - 1] == _SYMBOL, minlength=n)
    return np.column_stack([
        np.log1p(size), np.log1p(count), kinds[:, _LETTER] / full, kinds[:, _UPPER] / full, kinds[:, _DIGIT] / full, kinds[:, _STOP] / full,
        kinds[:, _SYMBOL] / full, kinds[:, _WIDE] / full, mean, spread, distinct / some, np.bincount(words, same, minlength=n) / some, top / some,
        np.log1p(line_count), count / line_count, line_distinct / line_count, np.bincount(doc, data == 124, minlength=n) / some,
        np.bincount(doc, data == 35, minlength=n) / some, at_end / some, np.bincount(words, length <= 3, minlength=n) / some,
    ])


def batched_statistics(texts: list[str], most: int = 4_000_000) -> np.ndarray:
    """statistics() over slices of about `most` characters."""
    out, at = [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= most):
            size += len(texts[upto])
            upto += 1
        out.append(statistics(texts[at:upto]))
        at = upto
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


class BoostedTrees:
    """Gradient-boosted trees for a 0/1 label, kept as arrays: feature, threshold, left child and value of each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]) if len(x) else np.zeros((0, x.shape[1]), int)
        rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, ...]] = []
        for _ in range(TREES if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(binned, cuts, y - p, p * (1 - p))
            f += step
            self.trees.append(tree)

    @staticmethod
    def _grow(binned, cuts, slope, curve):
        features, bounds, left, values = [0], [np.inf], [0], [0.0]
        node = np.zeros(len(slope), np.int64)
        level = [0]
        for depth in range(DEPTH + 1):
            place = np.full(len(features), -1)
            place[level] = np.arange(len(level))
            here = place[node]
            at = np.flatnonzero(here >= 0)
            g = np.bincount(here[at], slope[at], minlength=len(level))
            h = np.bincount(here[at], curve[at], minlength=len(level))
            for i, k in enumerate(level):
                values[k] = RATE * g[i] / (h[i] + RIDGE)
            if depth == DEPTH:
                break
            best = [(1e-6, None, None)] * len(level)
            for j in range(binned.shape[1]):
                key = here[at] * BINS + binned[at, j]
                shape = (len(level), BINS)
                hg = np.bincount(key, slope[at], minlength=shape[0] * BINS).reshape(shape).cumsum(axis=1)
                hh = np.bincount(key, curve[at], minlength=shape[0] * BINS).reshape(shape).cumsum(axis=1)
                hn = np.bincount(key, minlength=shape[0] * BINS).reshape(shape).cumsum(axis=1)
                rest_g, rest_h, rest_n = g[:, None] - hg, h[:, None] - hh, hn[:, -1:] - hn
                gain = hg**2 / (hh + RIDGE) + rest_g**2 / (rest_h + RIDGE) - (g**2 / (h + RIDGE))[:, None]
                gain[(hn < LEAST) | (rest_n < LEAST)] = -1
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    top = gain.argmax(axis=1)
                    best = [(gain[i, t], j, t) if gain[i, t] > best[i][0] else best[i] for i, t in enumerate(top)]
            level_next = []
            for i, k in enumerate(level):
                _, j, t = best[i]
                if j is None:
                    continue
                features[k], bounds[k], left[k] = j, cuts[j][t], len(features)
                own = node == k
                node[own] = left[k] + (binned[own, j] > t)
                for _ in range(2):
                    level_next.append(len(features))
                    features.append(0), bounds.append(np.inf), left.append(0), values.append(0.0)
            level = level_next
            if not level:
                break
        # a leaf is its own left child, with a bound that nothing exceeds
        left = [n if m else k for k, (n, m) in enumerate(zip(left, np.isfinite(bounds), strict=True))]
        tree = (np.array(features), np.array(bounds), np.array(left), np.array(values))
        return tree, tree[3][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The likelihood of label 1 for each row."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, left, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = left[node] + (x[rows, feature[node]] > bound[node])
            f += value[node]
        return 1 / (1 + np.exp(-f))


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(batched_statistics([t or "" for t in s])), dtype=object)

    return stats(text)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> BoostedTrees:
    """Trees from the rows of docs that have a label `quality` of 0 or 1 and where learn holds."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("_loom_y"))
    known = known.where(learn) if learn is not None else known
    n = known.count()
    space = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(space))
    known = known.where(place < min(space, space * sample // max(1, n)))  # the sample is bounded, so this side is
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "_loom_y", statistics_column(F.col("text")).alias("x"))
    got = rows.toPandas().sort_values(["doc_id", "_loom_y"], ignore_index=True)
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    return BoostedTrees(x, got["_loom_y"].to_numpy(float))


def score_column(docs: DataFrame, model: BoostedTrees, text: Column) -> Column:
    on = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(on.value.score(batched_statistics([t or "" for t in s])))
        give_back()

    return score(text)


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: rows whose crc32 of the id leaves 1 on division by 3 are never learned from."""
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    model = fit(docs, labels, ~held)
    scored = docs.select("doc_id", held.alias("held_out"), score_column(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
