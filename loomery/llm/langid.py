"""Language ID by string kernels.

A text's spectrum is the set of its byte n-grams of one to three bytes, lower-cased, with everything but letters as
spaces; presence counts, not frequency, so a long text weighs no more than a short one.  The kernel of two texts is the
cosine of their presence vectors.  Nystrom landmarks from the labelled rows give each text coordinates, one-versus-rest
ridge regression on them gives a score for each language, and scoring is two matrix products a batch.

The score tells languages apart, not whether a text is in any of them.  That is told by its mass: the share of a language's
rows that hold an n-gram, averaged over the text's n-grams, for the language where it is largest.  Learned rows, each left
out of its own language's shares, give the least mass by size; a text below it is not known.

The sample of labelled rows is bounded by SAMPLE rows a language, however many languages there are; rows are chosen by a
seeded hash of id and text, equal rows once.  Everything else covers all rows and whole texts.  The sample stays with the
executors: they add up what the regression needs, products of coordinates and a sum for each language, and the driver gets
these sums, the landmarks (LANDMARKS, or up to MOST_LANDMARKS where there are more languages), and the counts of n-grams by
language.  So the driver holds 64 KB a language and nothing a row but two numbers of the sample's masses.

Defined results: null text, or text without a letter, is `und` with score 0, as is every text if no label was learned;
labels that are null are never learned; ties go to the language that sorts first; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import crc_of_id, cut, give_back, prepare

SAMPLE = 300
LANDMARKS, MOST_LANDMARKS = 96, 1024
BITS = 14
RIDGE = 1e-2
SEED = 7
#: A text is foreign if its mass is below this share of what nearly all learned rows of its size have.
MASS_SHARE, MASS_QUANTILE = 0.65, 0.01
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_GAP = b"  "
#: Bytes of a text that are taken at once.
PIECE = 500_000


def presence(texts: list[str]) -> np.ndarray:
    """A row of 2^BITS presence flags for each text; bins 0 to 255 are single bytes, longer n-grams are hashed."""
    width = 1 << BITS
    pieces, of = [], []
    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "replace") + _GAP
        for at in range(0, max(1, len(raw) - len(_GAP)), PIECE):
            pieces.append(raw[at : at + PIECE + len(_GAP)])
            of.append(i)
    out = np.zeros((len(texts), width), bool)
    for at in range(0, len(pieces), 8):
        _mark(out, pieces[at : at + 8], np.array(of[at : at + 8], np.int64))
    return out


def _mark(out: np.ndarray, pieces: list[bytes], of: np.ndarray) -> None:
    """Sets the flags of the n-grams that start in the pieces; the last bytes of each are there for what starts before them."""
    width = out.shape[1]
    sizes = np.array([len(b) for b in pieces], np.int64)
    data = _KEEP[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.uint32)
    flat = out.ravel()
    rows = np.repeat(of, sizes) * width
    own = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    own[ends - 1] = own[ends - 2] = False
    starts = np.flatnonzero(own)
    rows = rows[starts]
    one = data[starts]
    two = one * np.uint32(257) + data[starts + 1]
    three = two * np.uint32(257) + data[starts + 2]
    flat[rows + one] = True
    for gram, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
        flat[rows + (gram * np.uint32(salt) >> np.uint32(32 - BITS))] = True


def _unit(flags: np.ndarray) -> np.ndarray:
    x = flags.astype(np.float32)
    return x / np.sqrt(np.maximum(1.0, x.sum(axis=1, keepdims=True)))


class Sums:
    """What the regression needs of some rows: own.T @ own, and sums of own, flags and rows by language."""

    def __init__(self, names: int, coordinates: int):
        self.products = np.zeros((coordinates, coordinates))
        self.own = np.zeros((names, coordinates))
        self.counts = np.zeros((names, 1 << BITS), np.int32)

    def add(self, index: np.ndarray, flags: np.ndarray, marks: np.ndarray, root: np.ndarray, rows: np.ndarray) -> None:
        own = (_unit(flags) @ marks.T) @ root
        self.products += own.T @ (own / rows[index][:, None])  # each language weighs alike
        np.add.at(self.own, index, own)
        np.add.at(self.counts, index, flags.astype(np.int32))


class KernelClassifier:
    """Landmarks, and what turns kernels with them into scores of the languages."""

    def __init__(self, names: list[str], rows: np.ndarray, marks: np.ndarray):
        """names in order, the sample's rows of each, and flags of the landmarks; regress() and tell() do the rest."""
        self.names, self.rows = np.array(names, dtype=object), rows
        self.marks = _unit(marks)
        among = self.marks @ self.marks.T
        values, vectors = np.linalg.eigh(among.astype(np.float64))
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T  # K^(-1/2) of the landmarks

    def regress(self, sums: Sums, ridge: float = RIDGE) -> None:
        """One-versus-rest ridge regression on targets of 1 and -1."""
        n = sums.products.shape[0]
        each = sums.own / self.rows[:, None]
        targets = 2 * each.T - each.sum(axis=0)[:, None]
        self.weights = (self.root @ np.linalg.solve(sums.products + ridge * np.eye(n) / n, targets)).astype(np.float32)
        self.shares = (sums.counts / self.rows[:, None]).T.astype(np.float32)

    def own_masses(self, index: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of learned rows, and their largest masses, each row left out of its own language's shares."""
        sizes, masses, rows = flags.sum(axis=1), self._masses(flags), self.rows[index]
        at = np.arange(len(index))
        among = masses[at, index] * sizes  # the row itself holds all of its n-grams
        masses[at, index] = np.where(rows > 1, (among * rows - sizes) / np.maximum(1, rows - 1) / np.maximum(1, sizes), 0.0)
        return sizes, masses.max(axis=1)

    def tell(self, sizes: np.ndarray, masses: np.ndarray) -> None:
        """Sets the least mass of known texts from the learned rows'."""
        self.largest, self.least = int(sizes.max()), self._least(sizes, masses)
        del self.root

    def _masses(self, flags: np.ndarray) -> np.ndarray:
        return (flags.astype(np.float32) @ self.shares).astype(np.float64) / np.maximum(1, flags.sum(axis=1, keepdims=True))

    @staticmethod
    def _least(sizes: np.ndarray, masses: np.ndarray) -> np.ndarray:
        """The least mass for each power of two of a text's size: of those without rows, that of the next larger; never rising."""
        power = np.log2(np.maximum(1, sizes)).astype(int)
        out = np.full(BITS + 1, np.inf)
        for b in np.unique(power):
            out[b] = MASS_SHARE * np.quantile(masses[power == b], MASS_QUANTILE)
        for b in range(power.max() - 1, -1, -1):
            out[b] = out[b] if out[b] < np.inf else out[b + 1]
        return np.minimum.accumulate(out)

    def known(self, flags: np.ndarray) -> np.ndarray:
        """Whether each text is in one of the languages; a text larger than any that was learned may thin its mass out."""
        sizes = np.maximum(1, flags.sum(axis=1))
        least = self.least[np.log2(sizes).astype(int)] * np.sqrt(np.minimum(1.0, self.largest / sizes))
        return self._masses(flags).max(axis=1) >= least

    def score(self, texts: list[str], batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its score from 0 to 1 for each text."""
        return self.judge(texts, batch)[:2]

    def judge(self, texts: list[str], batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score from 0 to 1, and whether the text is in any of the languages."""
        best, scores, known = [], [], []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and upto - at < batch and (size < 2_000_000 or upto == at):
                size += len(texts[upto])
                upto += 1
            flags = presence(texts[at:upto])
            f = (_unit(flags) @ self.marks.T) @ self.weights
            top = f.argmax(axis=1)
            best.append(top)
            scores.append(np.clip((1.0 + f[np.arange(len(top)), top]) / 2.0, 0.0, 1.0))
            known.append(self.known(flags))
            at = upto
        return (np.concatenate(best), np.concatenate(scores), np.concatenate(known)) if best else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))


def _flags(packed: pd.Series) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1).astype(bool)


def _sum_blobs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of arrays; they come in any order and are added in one."""
    parts = sorted(np.frombuffer(x, "<f8").tobytes() for x in pdf["sums"])
    return pd.DataFrame({"part": [key[0]], "sums": [np.sum([np.frombuffer(x, "<f8") for x in parts], axis=0).tobytes()]})


def sampled(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """lang, place, flags: at most `sample` rows of each language, by the smallest seeded hashes; equal rows count once."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    space = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(space))
    placed = rows.select("lang", place.alias("place"), "text")
    counts = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    bound = cut(counts.select("lang", F.least(F.lit(space), F.lit(2 * space * sample) / F.col("n") + 1).cast("long").alias("bound")))
    near = placed.join(F.broadcast(bound), "lang").where(F.col("place") < F.col("bound"))  # some twice as many as are needed, a row a language broadcast

    def flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                some = b.iloc[at : at + 64]
                packed = np.packbits(presence(list(some["text"])), axis=1)
                yield pd.DataFrame({"lang": some["lang"].to_numpy(), "place": some["place"].to_numpy(), "flags": [p.tobytes() for p in packed]})

    one = near.select("lang", "place", "text").mapInPandas(flags, "lang string, place long, flags binary").groupBy("lang", "place").agg(F.min("flags").alias("flags"))
    return cut(one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("rank") <= sample))


def fit(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> KernelClassifier | None:
    """A classifier from docs' text and non-null lang, of the rows where learn holds; None if there are none."""
    spark = prepare(docs.sparkSession)
    chosen = sampled(docs, learn, sample)
    found = sorted((r["lang"], r["n"]) for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a language
    if not found:
        return None
    names = [x for x, _ in found]
    each = max(1, landmarks // len(names))
    first = chosen.where(F.col("rank") <= each).orderBy("rank", F.xxhash64("lang"), "lang").limit(max(landmarks, MOST_LANDMARKS)).toPandas()
    first = first.sort_values(["lang", "place"], ignore_index=True)
    model = KernelClassifier(names, np.array([n for _, n in found], np.float64), _flags(first["flags"]))
    on = spark.sparkContext.broadcast((model, {x: i for i, x in enumerate(names)}))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, index = on.value
        sums = None
        for b in batches:
            sums = sums or Sums(len(index), len(own.marks))
            sums.add(b["lang"].map(index).to_numpy(), _flags(b["flags"]), own.marks, own.root, own.rows)
        if sums is not None:
            yield pd.DataFrame({"part": [-1], "sums": [sums.products.tobytes()]})
            for i in np.flatnonzero(sums.counts.any(axis=1) | sums.own.any(axis=1)):
                yield pd.DataFrame({"part": [int(i)], "sums": [np.concatenate([sums.own[i], sums.counts[i]]).astype("<f8").tobytes()]})
        give_back()

    total, m = Sums(len(names), len(model.marks)), len(model.marks)
    for r in chosen.mapInPandas(add, "part long, sums binary").groupBy("part").applyInPandas(_sum_blobs, "part long, sums binary").toLocalIterator():
        values = np.frombuffer(r["sums"], "<f8")
        if r["part"] < 0:
            total.products = values.reshape(m, m)
        else:
            total.own[r["part"]], total.counts[r["part"]] = values[:m], values[m:]
    model.regress(total)
    learned = spark.sparkContext.broadcast((model, {x: i for i, x in enumerate(names)}))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, index = learned.value
        for b in batches:
            sizes, masses = own.own_masses(b["lang"].map(index).to_numpy(), _flags(b["flags"]))
            yield pd.DataFrame({"size": sizes.astype(np.int32), "mass": masses.astype(np.float32)})
        give_back()

    masses = chosen.mapInPandas(weigh, "size int, mass float").toPandas()  # 8 bytes a row of the sample
    model.tell(masses["size"].to_numpy(), masses["mass"].to_numpy(np.float64))
    for x in (on, learned):
        x.unpersist()
    return model


def predict_column(docs: DataFrame, model: KernelClassifier | None, text: Column) -> Column:
    """struct(lang_pred, score, known) of a string column."""
    on = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = on.value
        for s in batches:
            names, scores, inside = np.full(len(s), "und", dtype=object), np.zeros(len(s)), np.zeros(len(s), bool)
            known = [i for i, t in enumerate(s) if own is not None and t is not None and _LETTER.search(t)]
            if known:
                top, score, inside[known] = own.judge([s.iloc[i] for i in known])
                names[known], scores[known] = own.names[top], score
            yield pd.DataFrame({"lang_pred": names, "score": scores, "known": inside})
        give_back()

    return predict(text)


def identify(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs with a column `_loom_lang`, struct(lang_pred, score, known); learned from docs itself."""
    model = fit(docs, learn)
    return docs.withColumn("_loom_lang", predict_column(docs, model, F.col("text")))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: rows whose crc32 of the id leaves 2 on division by 4 are never learned from."""
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "_loom_lang.lang_pred", "_loom_lang.score")
