"""Exact top-k search by distributed histogram selection.

Vectors are packed into chunks, queries into blocks, and each block meets each chunk once a pass: scores are one matrix
product.  Rather than sort the scores, each pass counts them in a histogram for each query, over all candidates; the bin
that holds the kth highest score becomes the next pass's range, and when bins are single scores the kth value is exact.  A
last pass keeps what reaches the kth value, and ties go to the smaller id.

A chunk's part of a histogram needs its highest bins only, down to where its own count reaches k: the kth highest of all
scores can't lie below the kth highest of a part.  So a chunk sends at most k bins a query, and in the last pass at most k
rows a query, however many candidates tie.  The number of passes follows from the range of the scores alone, and nothing is
gathered on the driver but counts.  Blocks are broadcast while all of them stay below BROADCAST bytes; beyond, blocks and
chunks are shuffled by (block, group of chunks).

Defined results: rows take part, not ids: an id on several rows stands for several candidates and several queries, and a
query leaves out its own row only.  Vectors that are null, or hold null or non-finite components, take no part; neither do
those of another length than the query's, nor rows without an id.  Scores are exact whole numbers; those beyond 64 bits
count as the largest, or smallest, number that 64 bits hold.  Fewer candidates than k give fewer rows; an empty table gives
none; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.common import cut, prepare

#: Vectors in a chunk, and queries in a block: 4096 vectors of 64 numbers are 2 MB.
CHUNK, BLOCK = 4096, 1024
#: Bins in a pass: two passes settle 20 bits of score.
BINS = 1024
#: Bytes of queries up to which all blocks are broadcast.
BROADCAST = 32_000_000
#: Scores that are held at once.
SCORES = 1 << 20
LARGEST = 2**63 - 1
#: What marks a query's own row; no score is as small.
OWN = -(2**63)
_CHUNK = "chunk long, dim int, ids binary, asks binary, rows binary, vectors binary"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of vectors of one length; `rows` names a row by its chunk and place."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: dict[int, list[tuple]] = {}

    def chunk(dim: int) -> pd.DataFrame:
        nonlocal number
        ids, asks, vectors = zip(*held.pop(dim), strict=True)
        rows = number + np.arange(len(ids), dtype=np.int64)
        number += len(ids)
        values = [np.array(ids, np.int64), np.array(asks, bool), rows, np.stack(vectors).astype("<f8")]
        return pd.DataFrame([(int(rows[0]), dim, *[v.tobytes() for v in values])], columns=["chunk", "dim", "ids", "asks", "rows", "vectors"])

    for b in batches:
        for i, a, v in zip(b["vec_id"], b["asks"], b["vector"], strict=True):
            dim = len(v)
            held.setdefault(dim, []).append((i, a, np.asarray(v, np.float64)))
            if len(held[dim]) == CHUNK:
                yield chunk(dim)
    for dim in list(held):
        yield chunk(dim)


def _blocks(chunks: DataFrame, blocks: int) -> DataFrame:
    """Queries as blocks: dim, block, ids, rows, vectors, lows (where each query's range begins)."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, ids, asks, rows, vectors in zip(b["dim"], b["ids"], b["asks"], b["rows"], b["vectors"], strict=True):
                own = np.frombuffer(asks, bool)
                if own.any():
                    v = np.frombuffer(vectors, "<f8").reshape(len(own), dim)[own]
                    yield pd.DataFrame({"dim": dim, "id": np.frombuffer(ids, np.int64)[own], "row": np.frombuffer(rows, np.int64)[own], "vector": [x.tobytes() for x in v]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        out = []
        for at in range(0, len(pdf), BLOCK):
            some = pdf.iloc[at : at + BLOCK]
            out.append((some["dim"].iloc[0], int(some["row"].iloc[0]), some["id"].to_numpy(np.int64).tobytes(), some["row"].to_numpy(np.int64).tobytes(), b"".join(some["vector"])))
        return pd.DataFrame(out, columns=["dim", "block", "ids", "rows", "vectors"])

    each = chunks.mapInPandas(asked, "dim int, id long, row long, vector binary")
    dealt = each.withColumn("_deal", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("dim", "_deal").applyInPandas(lambda pdf: block(pdf), "dim int, block long, ids binary, rows binary, vectors binary")


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's whole numbers, whatever their size; scale is a power of two."""
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        out[at] = int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale))
    return out


def _scores(q: np.ndarray, v: np.ndarray, scale: int) -> np.ndarray:
    """Exact scores of queries by candidates, held within 64 bits."""
    with np.errstate(over="ignore"):
        fq, fv = np.floor(q * scale), np.floor(v * scale)
        size = lambda x: np.sqrt((x * x).sum(axis=1))
        sq, sv = size(fq), size(fv)
        small_q, small_v = sq * max(1.0, sv.min(initial=np.inf)) < 2.0**52, sv * max(1.0, sq[sq < 2.0**52].max(initial=0)) < 2.0**52
    out = np.empty((len(q), len(v)), np.int64)
    small_q &= sq * sv[small_v].max(initial=0) < 2.0**52
    if small_q.all() and small_v.all():  # partial sums are below the product of the lengths, so doubles hold them exactly
        return (fq @ fv.T).astype(np.int64)
    out[np.ix_(small_q, small_v)] = (fq[small_q] @ fv[small_v].T).astype(np.int64)
    for rows, cols in ((~small_q, np.ones(len(v), bool)), (small_q, ~small_v)):
        if rows.any() and cols.any():
            exact = np.dot(_whole(q[rows], scale), _whole(v[cols], scale).T)
            out[np.ix_(rows, cols)] = np.clip(exact, -LARGEST, LARGEST).astype(np.int64)
    return out


def _products(row: tuple, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(candidate ids, scores) of a block with a chunk, some candidates at a time; a query's own row has OWN."""
    dim = row.dim
    q_rows, ids, rows = (np.frombuffer(x, np.int64) for x in (row.q_rows, row.ids, row.rows))
    q, v = np.frombuffer(row.q_vectors, "<f8").reshape(len(q_rows), dim), np.frombuffer(row.vectors, "<f8").reshape(len(ids), dim)
    step = max(1, SCORES // max(1, len(q)))
    for at in range(0, len(ids), step):
        s = _scores(q, v[at : at + step], scale)
        s[q_rows[:, None] == rows[None, at : at + step]] = OWN
        yield ids[at : at + step], s


def _meet(blocks: DataFrame, chunks: DataFrame, n_blocks: int, broadcast: bool, groups: int) -> DataFrame:
    """Each block beside each chunk of its length."""
    q = blocks.select("dim", "block", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"), "lows")
    c = chunks.select("dim", "chunk", "ids", "rows", "vectors")
    if broadcast:
        return c.join(F.broadcast(q), "dim")
    names = blocks.select("dim", "block")
    c = c.withColumn("_group", F.pmod(F.xxhash64("chunk"), F.lit(groups))).join(names, "dim")
    q = q.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return c.join(q, ["dim", "block", "_group"])


def _narrowed(blocks: DataFrame, met: DataFrame, width: int, k: int, scale: int) -> DataFrame:
    """blocks with lows moved up to the bin of `width` that holds each query's kth highest score."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                low = np.frombuffer(row.lows, np.int64)
                n = len(low)
                total = np.zeros(n * (BINS + 1), np.int64)
                for _, s in _products(row, scale):
                    at = (s >= low[:, None]) & (s != OWN)
                    above = (s.view(np.uint64) - low.view(np.uint64)[:, None]) // np.uint64(width)  # differences wrap round rightly
                    bins = np.minimum(above, np.uint64(BINS)).astype(np.int64) + np.arange(n)[:, None] * (BINS + 1)
                    total += np.bincount(bins[at], minlength=len(total))
                down = total.reshape(n, -1)[:, ::-1]
                before = np.cumsum(down, axis=1) - down
                place, col = np.nonzero((down > 0) & (before < k))
                yield pd.DataFrame({"block": row.block, "place": place.astype(np.int64), "bin": (BINS - col).astype(np.int64), "n": down[place, col]})

    parts = met.mapInPandas(count, "block long, place long, bin long, n long").groupBy("block", "place", "bin").agg(F.sum("n").alias("n"))
    # a query has at most k bins of each chunk, of BINS + 1 in all
    bins = parts.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
    start = F.struct(F.lit(0).cast("long").alias("passed"), F.lit(-1).cast("long").alias("bin"))

    def down_to(a: Column, x: Column) -> Column:
        return F.when(a["passed"] >= k, a).otherwise(F.struct((a["passed"] + x["n"]).alias("passed"), x["bin"].alias("bin")))

    found = bins.select("block", F.struct("place", F.aggregate("bins", start, down_to)["bin"].alias("bin")).alias("x")).groupBy("block").agg(F.collect_list("x").alias("found"))

    @F.pandas_udf("binary")
    def moved(lows: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for low, own in zip(lows, found, strict=True):
            new = np.frombuffer(low, np.int64).copy()
            for x in own if own is not None else ():
                if x["bin"] >= 0:
                    new[x["place"]] = min(int(new[x["place"]]) + int(x["bin"]) * width, LARGEST)
            out.append(new.tobytes())
        return pd.Series(out)

    return cut(blocks.join(found, "block", "left").withColumn("lows", moved("lows", "found")).drop("found"))


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `asks` holds the k best other rows.

    Scores are inner products of floor(scale * x), scale being a power of two.
    """
    spark = prepare(vectors.sparkSession)
    raw = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & raw.isNotNull() & F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), raw.alias("vector"))
    chunks = cut(rows.mapInPandas(_pack, _CHUNK))  # names of rows are fixed from here on

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, asks, vectors in zip(b["dim"], b["asks"], b["vectors"], strict=True):
                own = np.frombuffer(asks, bool)
                with np.errstate(over="ignore"):
                    x = np.floor(np.frombuffer(vectors, "<f8").reshape(len(own), dim) * scale)
                    size = np.sqrt((x * x).sum(axis=1)) if dim else np.zeros(len(own))
                yield pd.DataFrame({"q": [int(own.sum())], "bytes": [int(own.sum()) * dim * 8], "n": [1], "size": [float(size.max(initial=0))], "asked": [float(size[own].max(initial=0))]})

    m = chunks.mapInPandas(measured, "q long, bytes long, n long, size double, asked double").agg(F.sum("q"), F.sum("bytes"), F.sum("n"), F.max("size"), F.max("asked")).first()
    if not m[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = m[3] * m[4] * 1.0001 + 2  # no score is larger, by Cauchy and Schwarz
    reach = int(reach) if reach < 2.0**62 else LARGEST
    n_blocks = max(1, -(-m[0] // BLOCK))
    blocks = _blocks(chunks, n_blocks)

    @F.pandas_udf("binary")
    def begin(rows: pd.Series) -> pd.Series:
        return pd.Series([np.full(len(r) // 8, -reach, np.int64).tobytes() for r in rows])

    blocks = cut(blocks.withColumn("lows", begin("rows")))
    groups = max(1, min(int(m[2]), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    meet = lambda b: _meet(b, chunks, n_blocks, m[1] + 24 * m[0] <= BROADCAST, groups)
    width = 2 * reach + 1
    while width > 1:
        width = -(-width // BINS)
        blocks = _narrowed(blocks, meet(blocks), width, k, scale)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                low, q_ids, q_rows = (np.frombuffer(x, np.int64) for x in (row.lows, row.q_ids, row.q_rows))
                found = []
                for ids, s in _products(row, scale):
                    place, col = np.nonzero((s >= low[:, None]) & (s != OWN))
                    found.append((place, ids[col], s[place, col]))
                place, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((ids, -s.astype(object) if (s == OWN + 1).any() else -s, place))
                place, ids, s = place[order], ids[order], s[order]
                first = np.flatnonzero(np.diff(place, prepend=-1))
                own = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place)))) < k
                yield pd.DataFrame({"row": q_rows[place[own]], "query_id": q_ids[place[own]], "vec_id": ids[own], "score": s[own]})

    best = meet(blocks).mapInPandas(keep, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: every query against every other row, by an inner product of whole numbers.
ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
