"""Suffix arrays by linear grouping, and the substring dedup that uses them.

grouped_suffixes() sorts the suffixes of a string in two phases.  A suffix's Lyndon prefix reaches up to the next smaller
suffix.  Phase one groups suffixes by that prefix: groups start as first characters and are taken from the highest down;
each member of the group taken points to the previous suffix of a lower group, and what it points to moves up, within its
own group, by how many members point to it.  Phase two goes through the groups from the lowest up: whenever a suffix gets
its place, those whose Lyndon prefix ends where it begins get the next place of their group.  No string is renamed and
sorted recursively.

repeats() marks each byte covered by a 50-byte string that also starts in a document of a smaller id.  To bring equal
strings together without moving whole texts, a 50-byte string is known by its minimiser, the least hash of its 35 runs
of 16 bytes; neighbouring strings with the same minimiser form one stretch.  Minimisers that one document alone holds are
out after a first exchange of 8 bytes for each stretch; the stretches of the rest are grouped by minimiser, equal ones as
one, and the suffix array over the different ones of a bucket tells which 50-byte strings they share; what lies before the
first and after the last window whose hash others have too stays out of it.  Hashes only bring candidates together: equal
stretches are compared byte by byte.

Hot passages: a partition sends one copy of a stretch, with its smallest document; larger ones are decided where they are.
Hot minimisers, those of more than HOT documents, are split: their strings go by the pair of least and greatest hash, which
equal strings have in common too.  Buckets are dealt by counted bytes, so a task's share doesn't grow with the input.

Defined results: null counts as empty, texts below 50 bytes lose nothing; rows without an id neither lose nor take bytes;
rows of equal id don't take from each other; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import cut, prepare, release, row_key
from loomery.llm.words import mix, span_hash

LENGTH, GRAM = 50, 16
_PER = LENGTH - GRAM + 1
#: Windows in a stretch at most: periodic text has one minimiser throughout.
STRETCH = 128
#: Bytes of text that are hashed at once, and that a worker gathers before it sends.
PIECE, FLUSH = 1_000_000, 24_000_000
#: Bytes of text for each bucket of stretches, and documents of one minimiser beyond which its strings are split.
BUCKET_BYTES, HOT = 16_000_000, 4096
#: Bytes of spans up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST = 64_000_000
#: Bytes that one suffix array holds.
ARRAY = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grouped_suffixes(text: bytes | np.ndarray) -> list[int]:
    """The suffix array of text; 255 must not occur.  A shorter suffix sorts before the longer ones that it begins."""
    data = np.append(np.frombuffer(bytes(text), np.uint8).astype(np.int64) + 1, 0)  # the end sorts below all
    n = len(data)
    first = np.argsort(data, kind="stable")
    order = first.tolist()
    starts = np.flatnonzero(np.diff(data[first], prepend=-1))
    sizes = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)  # of a suffix: where its group starts in order
    group[first] = np.repeat(starts, sizes)
    at = np.empty(n, np.int64)
    at[first] = np.arange(n)
    group, at, size = group.tolist(), at.tolist(), [0] * (n + 1)
    for s, m in zip(starts.tolist(), sizes.tolist(), strict=True):
        size[s] = m
    prev = [-1] * n
    final = [0] * n

    end = n
    while end > 0:  # the group that ends here is the highest not yet taken
        g = group[order[end - 1]]
        members = order[g:end]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
            final[i] = g
        if pointed:
            most = max(pointed.values())
            levels: list[list[int]] = [[] for _ in range(most + 1)]
            if most == 1:
                levels[1] = list(pointed)
            else:
                for p, k in pointed.items():
                    levels[k].append(p)
            for k in range(most, 0, -1):
                moved: dict[int, int] = {}
                for p in levels[k]:
                    s = group[p]
                    last = s + size[s] - 1
                    q, a = order[last], at[p]
                    order[a], at[q] = q, a
                    order[last], at[p] = p, last
                    size[s] -= 1
                    moved[s] = moved.get(s, 0) + 1
                for s, m in moved.items():
                    new = s + size[s]
                    size[new] = m
                    if new != s:
                        for a in range(new, new + m):
                            group[order[a]] = new
        end = g

    out, place = [-1] * n, final[:]  # place[g]: the next free place of the group that starts at g
    taken = bytearray(n)
    nexts = list(range(n))
    out[0] = n - 1
    taken[n - 1] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not taken[s]:
            g = final[s]
            out[nexts[g]] = s
            nexts[g] += 1
            taken[s] = 1
            s = prev[s]
    return out[1:]


def equal_starts(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the class of each: suffixes of one class begin with the same `length` bytes.

    Suffixes shorter than that are in a class of their own.
    """
    order = np.array(grouped_suffixes(text), np.int64)
    data = np.frombuffer(text, np.uint8)
    whole = order + length <= len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = whole[1:] & whole[:-1]
        words = [np.ascontiguousarray(padded[j : j + len(data) + 8]) for j in range(8)]
        eight = np.zeros(len(data) + 8, np.uint64)
        for w in words:
            eight = (eight << np.uint64(8)) | w[: len(eight)].astype(np.uint64)
        eight = np.concatenate([eight, np.zeros(length, np.uint64)])
        for j in [*range(0, length - 8, 8), length - 8]:
            same[1:] &= eight[order[1:] + j] == eight[order[:-1] + j]
    return order, np.cumsum(~same) - 1


def stretches(texts: list[bytes], extreme=np.minimum) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of texts: text, first window, number of windows, minimiser (48 bits), or with np.maximum the greatest hash."""
    parts, at = [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= PIECE):
            size += len(texts[upto])
            upto += 1
        own = texts[at:upto]
        parts.append(_stretches(own, at, extreme) if size <= 16 * PIECE else _long_stretches(own[0], at, extreme))
        at = upto
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _long_stretches(text: bytes, at: int, extreme=np.minimum):
    """Those of one very long text, by pieces that overlap so that each window lies in one of them."""
    parts = []
    for s in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        of, first, n, m = _stretches([text[s : s + PIECE + LENGTH - 1]], at, extreme)
        parts.append((of, first + s, n, m))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _stretches(texts: list[bytes], first_text: int, extreme=np.minimum):
    size = np.array([len(b) for b in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h, base, n = data.astype(np.uint64) + np.uint64(1), np.array([_BASE]), 1
    while n < GRAM:
        h = h[:-n] * base + h[n:]
        base, n = np.multiply(base, base, dtype=np.uint64), 2 * n
    h = mix(h) >> np.uint64(16)
    n = 1
    while 2 * n <= _PER:
        h = extreme(h[:-n], h[n:])
        n *= 2
    h = extreme(h[: len(data) - LENGTH + 1], h[_PER - n :])
    ends = np.cumsum(size)
    doc = np.repeat(np.arange(len(texts)), size)[: len(h)]
    place = np.arange(len(h))
    fits = place + LENGTH <= ends[doc]
    place = place[fits]
    if not len(place):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    doc, h = doc[fits], h[fits]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    run = np.flatnonzero(new)
    into = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    begin = np.flatnonzero(into % STRETCH == 0)
    count = np.diff(np.append(begin, len(h)))
    return doc[begin] + first_text, place[begin] - (ends - size)[doc[begin]], count, h[begin]


def split_hot(texts: list[bytes], of: np.ndarray, begin: np.ndarray, n: np.ndarray, m: np.ndarray, hot: np.ndarray):
    """The stretches and their keys: the minimiser, or for hot minimisers parts of one greatest hash each and the pair of both."""
    is_hot = np.isin(m, hot)
    if not is_hot.any():
        return of, begin, n, m, m
    some = np.flatnonzero(is_hot)
    part, at, count, greatest = stretches([texts[of[i]][begin[i] : begin[i] + n[i] + LENGTH - 1] for i in some], np.maximum)
    whole, some = ~is_hot, some[part]
    key = np.concatenate([m[whole], mix(m[some] ^ mix(greatest)) >> np.uint64(16)])
    of, begin, n, m = (np.concatenate([x[whole], y]) for x, y in ((of, of[some]), (begin, begin[some] + at), (n, count), (m, m[some])))
    order = np.argsort(of, kind="stable")
    return of[order], begin[order], n[order], m[order], key[order]


def _flushes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size, rows = [], 0, 0
    for b in batches:
        held.append(b)
        size += int(b["text"].str.len().sum())
        rows += len(b)
        if size >= FLUSH or rows + len(b) >= _MANY:
            yield pd.concat(held, ignore_index=True)
            held, size, rows = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _flush_ids() -> Iterator[int]:
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 24
    while True:
        yield n
        n += 1


def _distinct(x: np.ndarray) -> np.ndarray:
    """What np.unique() returns, by sorting: its hash table takes ten times as long."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each x is one of some, which are in order."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _bytes_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans of data, one after the other."""
    return data[np.repeat(starts, sizes) + _within(sizes)]


def _packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, 5))


def _unpacked(b: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


_PARCEL = "bucket long, flush long, kind int, parcel binary"


def _parcels(bucket_of: np.ndarray, make) -> Iterator[tuple[int, bytes]]:
    """(bucket, pickled make(indices)) for each bucket that occurs."""
    if not len(bucket_of):
        return
    order = np.argsort(bucket_of, kind="stable")
    sorted_ = bucket_of[order]
    edges = np.flatnonzero(np.diff(sorted_, prepend=-1))
    for s, e in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(sorted_[s]), _packed(make(order[s:e]))


#: In the low 16 bits of a packed minimiser: the flush has it in several documents already.
_MANY = 0xFFFF
#: In the highest bit of a document's minimiser: it is hot.
_HOT = np.uint64(1 << 63)


def _send_minimisers(buckets: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Minimisers of a flush, each in 8 bytes with its document's place; those that it has in several documents are known to be shared."""
        for flush, b in zip(_flush_ids(), _flushes(batches)):
            of, _, _, m = stretches([t.encode("utf-8", "replace") for t in b["text"]])
            pairs = _distinct(m << np.uint64(16) | of.astype(np.uint64))
            m = pairs >> np.uint64(16)
            first = np.flatnonzero(np.diff(m, prepend=np.uint64(1 << 50)))
            count = np.diff(np.append(first, len(m)))
            several = pairs[np.repeat(count > 1, count)]
            keys = b[["k_id", "k_text"]].to_numpy(np.int64)
            rows = [(flush % buckets, flush, 1, _packed((keys, several)))]
            lead = np.where(count > 1, pairs[first] | np.uint64(_MANY), pairs[first])
            for bucket, parcel in _parcels(((lead >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64), lambda i, lead=lead, count=count: (lead[i], count[i].astype(np.uint16))):
                rows.append((bucket, flush, 0, parcel))
            yield pd.DataFrame(rows, columns=["bucket", "flush", "kind", "parcel"])

    return send


def _shared_minimisers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each flush the packed minimisers that other flushes have too, and (kind 2) the hot ones."""
    rows = [(f, 1, p) for f, k, p in zip(pdf["flush"], pdf["kind"], pdf["parcel"], strict=True) if k == 1]
    sent = [(f, _unpacked(p)) for f, k, p in zip(pdf["flush"], pdf["kind"], pdf["parcel"], strict=True) if k == 0]
    if sent:
        packed = np.concatenate([x[1][0] for x in sent])
        _, back, count = np.unique(packed >> np.uint64(16), return_inverse=True, return_counts=True)
        shared = (count[back] > 1) & (packed & np.uint64(_MANY) != _MANY)
        hot = np.bincount(back, np.concatenate([x[1][1] for x in sent]))[back] > HOT
        at = 0
        for f, (own, _) in sent:
            for kind, keep in ((0, own[shared[at : at + len(own)]]), (2, own[hot[at : at + len(own)]] >> np.uint64(16))):
                if len(keep):
                    rows.append((f, kind, _packed(keep)))
            at += len(own)
    return pd.DataFrame(rows, columns=["flush", "kind", "parcel"])


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one flush: the shared minimisers of each of its documents, hot ones marked."""
    ((keys, several),) = [_unpacked(p) for k, p in zip(pdf["kind"], pdf["parcel"], strict=True) if k == 1]
    packed = np.concatenate([several, *[_unpacked(p) for k, p in zip(pdf["kind"], pdf["parcel"], strict=True) if k == 0]])
    of, m = (packed & np.uint64(_MANY)).astype(np.int64), packed >> np.uint64(16)
    hot = [_unpacked(p) for k, p in zip(pdf["kind"], pdf["parcel"], strict=True) if k == 2]
    if hot:
        m = np.where(np.isin(m, np.concatenate(hot)), m | _HOT, m)
    order = np.lexsort((m, of))
    of, m = of[order], m[order]
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    return pd.DataFrame({"k_id": keys[of[edge], 0], "k_text": keys[of[edge], 1], "shared": [p.tobytes() for p in np.split(m, edge[1:])] if len(edge) else []})


def _send_stretches(buckets: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The stretches with shared minimisers; of equal ones the smallest document's, the others are known to be covered."""
        for flush, b in zip(_flush_ids(), _flushes(batches)):
            texts = [t.encode("utf-8", "replace") for t in b["text"]]
            of, begin, n, m = stretches(texts)
            wanted = [np.frombuffer(x, np.uint64) for x in b["shared"]]
            in_ = np.repeat(np.arange(len(texts), dtype=np.uint64), np.array([len(w) for w in wanted], np.int64))
            keep = _among(of.astype(np.uint64) << np.uint64(48) | m, np.sort(in_ << np.uint64(48) | np.concatenate([np.zeros(0, np.uint64), *wanted]) & ~_HOT))
            of, begin, n, m = of[keep], begin[keep], n[keep], m[keep]
            if not len(of):
                continue
            hot = np.unique(np.concatenate([w[w >= _HOT] for w in wanted]) & ~_HOT)
            of, begin, n, m, key = split_hot(texts, of, begin, n, m, hot)
            lengths = np.array([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), np.uint8)
            start, size = (np.cumsum(lengths) - lengths)[of] + begin, n + LENGTH - 1
            content = np.empty(len(of), np.uint64)
            for s in range(0, len(texts), 256):  # hashes of the stretches, some documents at a time
                lo, hi = np.searchsorted(of, [s, s + 256])
                if hi > lo:
                    base = int(lengths[:s].sum())
                    a = start[lo:hi] - base
                    content[lo:hi] = span_hash(data[base : base + int(lengths[s : s + 256].sum())], a, a + size[lo:hi])
            keys = b[["k_id", "k_text"]].to_numpy(np.int64)
            ids = keys[of, 0]
            body = lambda i: data[start[i] : start[i] + size[i]].tobytes()  # noqa: B023, E731
            order = np.lexsort((ids, content, key))
            of, begin, n, m, key, content, ids, start, size = (x[order] for x in (of, begin, n, m, key, content, ids, start, size))
            new = _starts(key, content)
            if not _equal(data, start, size, new):  # hashes met by chance: number the stretches by their bytes
                content = _numbers(body, len(of))
                order = np.lexsort((ids, content, key))
                of, begin, n, m, key, content, ids, start, size = (x[order] for x in (of, begin, n, m, key, content, ids, start, size))
                new = _starts(key, content)
            lead = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            least = ids[lead]
            later = ids > least[group]
            rows, small = [], int(lengths.max()) < 2**31
            if later.any():
                rows.append((flush % buckets, flush, 1, _packed((keys[of[later]], begin[later], begin[later] + size[later]))))
            held = np.bincount(group[~later], minlength=len(lead))  # in order of ids, so these come first in their group

            def parcel(i: np.ndarray) -> tuple:
                number = np.repeat(np.arange(len(i)), held[i])
                holders = lead[i][number] + _within(held[i])
                bodies = _bytes_at(data, start[lead[i]], size[lead[i]]).tobytes()
                docs, who = np.unique(of[holders], return_inverse=True)
                return m[lead[i]], key[lead[i]], content[lead[i]], least[i], n[lead[i]].astype(np.uint8), bodies, number.astype(np.int32), keys[docs], who.astype(np.uint16), begin[holders].astype(np.int32 if small else np.int64)

            for bucket, p in _parcels((key[lead] % np.uint64(buckets)).astype(np.int64), parcel):
                rows.append((bucket, flush, 0, p))
            yield pd.DataFrame(rows, columns=["bucket", "flush", "kind", "parcel"])

    return send


def _starts(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Where, in order of key and content, a new pair begins."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return new


def _equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, new: np.ndarray) -> bool:
    """Whether each span of data has the bytes of the one that its group begins with."""
    lead, rest = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(~new)
    if (size[rest] != size[lead[rest]]).any():
        return False
    some = (rest[s : s + 10_000] for s in range(0, len(rest), 10_000))
    return all(np.array_equal(_bytes_at(data, start[i], size[i]), _bytes_at(data, start[lead[i]], size[i])) for i in some)


def _numbers(body, n: int) -> np.ndarray:
    """A number for each body, the same for equal bytes."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(body(i), len(seen)) for i in range(n)], np.uint64)


def _covered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the spans of each flush's documents that a smaller document has too."""
    rows = [(f, p) for f, k, p in zip(pdf["flush"], pdf["kind"], pdf["parcel"], strict=True) if k == 1]
    sent = [(f, *_unpacked(p)) for f, k, p in zip(pdf["flush"], pdf["kind"], pdf["parcel"], strict=True) if k == 0]
    if not sent:
        return pd.DataFrame(rows, columns=["flush", "parcel"])
    sent = [(f, m, key, content, least, n.astype(np.int64), bodies, number, keys[who], begin.astype(np.int64)) for f, m, key, content, least, n, bodies, number, keys, who, begin in sent]
    m, key, content, least, n = (np.concatenate([x[j] for x in sent]) for j in range(1, 6))
    raw = b"".join(x[6] for x in sent)
    data, size = np.frombuffer(raw, np.uint8), n + LENGTH - 1
    start = np.cumsum(size) - size
    body = lambda i: raw[start[i] : start[i] + size[i]]
    order = np.lexsort((least, content, key))
    new = _starts(key[order], content[order])
    if not _equal(data, start[order], size[order], new):
        content = _numbers(body, len(n))
        order = np.lexsort((least, content, key))
        new = _starts(key[order], content[order])
    lead = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    smallest = least[lead]

    # stretches whose key others have: which of their windows do smaller documents have?
    _, back, count = np.unique(key[lead], return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[back] > 1)  # in order of their keys, as lead is
    of_run, run_from, run_to = _runs(_smaller_windows([body(i) for i in lead[several]], key[lead[several]], smallest[several]))
    of_run = several[of_run]

    base = 0
    for f, own_m, _, _, own_least, own_n, _, number, keys, begin in sent:
        g = group[base : base + len(own_m)]
        base += len(own_m)
        whole = (own_least > smallest[g])[number]
        j, part = np.flatnonzero(whole), np.flatnonzero(~whole)
        first = np.searchsorted(of_run, g[number[part]])
        runs = np.searchsorted(of_run, g[number[part]], "right") - first
        part, run = np.repeat(part, runs), np.repeat(first, runs) + _within(runs)
        if len(j) or len(part):
            s, e = np.append(begin[j], begin[part] + run_from[run]), np.append(begin[j] + own_n[number[j]] + LENGTH - 1, begin[part] + run_to[run])
            rows.append((f, _packed((keys[np.append(j, part)], s, e))))
    return pd.DataFrame(rows, columns=["flush", "parcel"])


def _runs(flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flags of windows: the body, first byte and end of each run of bytes that flagged windows cover."""
    sizes = np.array([len(x) for x in flags], np.int64)
    hit = np.flatnonzero(np.concatenate(flags)) if flags else np.zeros(0, np.int64)
    if not len(hit):
        return hit, hit, hit
    of = np.repeat(np.arange(len(flags)), sizes)[hit]
    at = hit - (np.cumsum(sizes) - sizes)[of]
    new = np.append(True, (of[1:] != of[:-1]) | (np.diff(at) > LENGTH))
    first = np.flatnonzero(new)
    return of[first], at[first], at[np.append(first[1:], len(hit)) - 1] + LENGTH


def _shared_part(bodies: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part (from, to) of each body between the first and the last window whose hash stands elsewhere under its key too.

    Bodies come in order of their keys; the part is empty if there is no such window.
    """
    low, high = np.zeros(len(bodies), np.int64), np.zeros(len(bodies), np.int64)
    size = np.array([len(b) for b in bodies], np.int64)
    upto, at = np.cumsum(size), 0
    while at < len(bodies):  # all bodies of some keys, about a piece of text at a time
        last = min(len(bodies), int(np.searchsorted(upto, upto[at] + PIECE)) + 1)
        end = int(np.searchsorted(keys, keys[last - 1], "right"))
        own, windows = size[at:end], size[at:end] - (LENGTH - 1)
        data = np.frombuffer(b"".join(bodies[at:end]), np.uint8)
        of, place = np.repeat(np.arange(end - at), windows), _within(windows)
        begin = (np.cumsum(own) - own)[of] + place
        h = span_hash(data, begin, begin + LENGTH) ^ mix(keys[at:end])[of]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        shared = np.zeros(len(h), bool)
        shared[order] = np.append(same, False) | np.append(False, same)
        some = np.flatnonzero(shared)
        first = np.flatnonzero(np.diff(of[some], prepend=-1))
        low[at + of[some[first]]] = place[some[first]]
        high[at + of[some[first]]] = place[some[np.append(first[1:], len(some)) - 1]] + LENGTH if len(some) else 0
        at = end
    return low, high


def _smaller_windows(bodies: list[bytes], keys: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """For each body a flag for each window: does a body of a smaller id, with the same key, have its bytes?"""
    flags = [np.zeros(len(b) - LENGTH + 1, bool) for b in bodies]
    if not bodies:
        return flags
    low, high = _shared_part(bodies, keys)
    cores: dict[tuple[int, bytes], int] = {}
    core_of = np.full(len(bodies), -1)
    for i in np.flatnonzero(high > low).tolist():
        core_of[i] = cores.setdefault((int(keys[i]), bodies[i][low[i] : high[i]]), len(cores))
    texts = [t for _, t in cores]
    some = core_of >= 0
    least = np.full(len(cores), np.iinfo(np.int64).max)
    np.minimum.at(least, core_of[some], ids[some])
    windows = _least_by_window(texts, np.array([k for k, _ in cores], np.uint64), least)
    for i in np.flatnonzero(some):
        w = windows[core_of[i]]
        flags[i][low[i] : low[i] + len(w)] = w < ids[i]
    return flags


def _least_by_window(texts: list[bytes], m: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each text the smallest id of a text that has it; texts come in order of their keys m."""
    out = [np.full(len(t) - LENGTH + 1, i) for t, i in zip(texts, ids, strict=True)]
    _, back, count = np.unique(m, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(count[back] > 1) if len(m) else np.zeros(0, np.int64)
    at = 0
    while at < len(open_):
        upto, size = at, 0
        while upto < len(open_) and (size < ARRAY or m[open_[upto]] == m[open_[upto - 1]]):
            size += len(texts[open_[upto]]) + 1
            upto += 1
        own = open_[at:upto]
        sizes = np.array([len(texts[i]) for i in own])
        start = np.cumsum(sizes + 1) - (sizes + 1)
        order, classes = equal_starts(b"\xfe".join(texts[i] for i in own) + b"\xfe", LENGTH)  # never in UTF-8
        body = np.repeat(np.arange(len(own)), sizes + 1)[order]
        real = order - start[body] + LENGTH <= sizes[body]
        smallest = np.full(int(classes[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, classes[real], ids[own][body[real]])
        found = np.zeros(int((sizes + 1).sum()), np.int64)
        found[order[real]] = smallest[classes[real]]
        for i, s, n in zip(own, start, sizes, strict=True):
            out[i] = found[s : s + n - LENGTH + 1]
        at = upto
    return out


def _spans_by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one flush: the united spans of each document, as pairs of 64-bit numbers."""
    got = [_unpacked(p) for p in pdf["parcel"]]
    key, s, e = (np.concatenate([x[j] for x in got]) for j in range(3))
    order = np.lexsort((s, key[:, 1], key[:, 0]))
    key, s, e = key[order], s[order], e[order]
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    out = []
    for a, b in zip(edge, np.append(edge[1:], len(s)), strict=True):
        reach = np.maximum.accumulate(e[a:b])
        fresh = np.append(True, s[a + 1 : b] > reach[:-1])
        begins = np.flatnonzero(fresh)
        pairs = np.stack([s[a:b][begins], reach[np.append(begins[1:] - 1, b - a - 1)]], axis=1)
        out.append(pairs.astype("<i8").tobytes())
    return pd.DataFrame({"k_id": key[edge, 0], "k_text": key[edge, 1], "spans": out})


def repeats(docs: DataFrame) -> DataFrame:
    """k_id, k_text, spans (binary pairs of 64-bit begin and end): the removed bytes of the documents that lose some."""
    spark = prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, flushes = max(tasks, -(-total // BUCKET_BYTES)), max(tasks, -(-total // FLUSH))
    rows = docs.where(F.col("doc_id").isNotNull()).select(*row_key(F.col("doc_id").cast("long"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    sent = rows.mapInPandas(_send_minimisers(buckets), _PARCEL)
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shared_minimisers, "flush long, kind int, parcel binary")
    shared = cut(answers.repartition(flushes, "flush").groupBy("flush").applyInPandas(_by_document, "k_id long, k_text long, shared binary").dropDuplicates(["k_id", "k_text"]))
    del sent, answers
    release(spark)
    # in order: a task that is tried again deals the same documents to the same flushes
    near = rows.join(shared, ["k_id", "k_text"]).sortWithinPartitions("k_id", "k_text").mapInPandas(_send_stretches(buckets), _PARCEL)
    covered = near.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_covered, "flush long, parcel binary")
    spans = covered.repartition(flushes, "flush").groupBy("flush").applyInPandas(_spans_by_document, "k_id long, k_text long, spans binary")
    spans = cut(spans.dropDuplicates(["k_id", "k_text"]))
    del near, covered, shared
    release(spark)
    return spans


def keep_and_span(text: str | None, spans: bytes | None) -> tuple[bytes, int, int]:
    """The kept bytes of a text, how many were removed, and in how many runs."""
    raw = (text or "").encode("utf-8", "replace")
    if not spans:
        return raw, 0, 0
    kept, at, removed = [], 0, 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    for s, e in pairs:
        kept.append(raw[at:s])
        removed += e - s
        at = e
    return b"".join([*kept, raw[at:]]), removed, len(pairs)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for each row of docs."""
    spans = repeats(docs)
    size = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()
    if size[0] * 64 + size[1] <= BROADCAST:
        spans = F.broadcast(spans)
    rows = docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), "text").join(spans, ["k_id", "k_text"], "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for t, s in zip(texts, spans, strict=True):
                rest, removed, runs = keep_and_span(t, s)
                out.append((len(rest) + removed, removed, runs, hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select(F.col("k_id").alias("doc_id"), kept("text", "spans").alias("r")).select("doc_id", "r.*")
