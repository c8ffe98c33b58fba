"""Secret scans: fixed patterns, and a token-efficiency test for random strings that no pattern knows.

The efficiency test takes runs of key-like characters and counts the tokens that a byte-level vocabulary needs for
them.  Text that the vocabulary was made from takes few tokens for its length; random strings take many, so a low ratio
of characters to tokens exposes them.  Digests of known lengths, UUIDs, and what the fixed patterns hold already are
set aside first, and so are runs made of numbers and of words of text alone; the ratio decides on all others, whatever their
letters and digits.  A run that isn't random as a whole is looked at again in windows of its tokens, so a readable prefix hides
nothing; UUIDs, and the parts between separators that a fixed pattern touches, are cut out of a run and the rest is tested.

Defined results: null is scanned as the empty text and has no spans; spans count code points, end exclusive; matches of
one kind never overlap, those of different kinds may; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import give_back, prepare

KINDS = ("assign", "access", "hex", "random")
# The patterns of the three base kinds, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that the efficiency test looks at, and the characters a token below which a run counts as random.
LEAST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
CHARS_PER_TOKEN = 2.0
DIGEST = re.compile("|".join(rf"(?i:[0-9a-f]{{{n}}})" for n in (32, 40, 56, 64, 96, 128)))
UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
#: What no ratio makes random by itself: numbers, and words that take as few tokens as text does.
_SEPARATORS = "+/_=-"
_PART, _NUMBER, _WORD = re.compile("[A-Za-z0-9]+"), re.compile("[0-9]+"), re.compile("[A-Z]?[a-z]+|[A-Z]+")


def load_ranks(path: str | None = None) -> bytes:
    """The vocabulary file of the efficiency test, read once by the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def make_encoding(ranks: bytes):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("secret-scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _ratio(s: str, encoding) -> float:
    return len(s) / max(1, len(encoding.encode_ordinary(s)))


def _plain(part: str, encoding, least: float) -> bool:
    """Whether a part between separators is a number or a word of text."""
    return bool(_NUMBER.fullmatch(part)) or bool(_WORD.fullmatch(part)) and _ratio(part, encoding) >= least


def _random(s: str, encoding, least: float) -> bool:
    if DIGEST.fullmatch(s) or _ratio(s, encoding) >= least:
        return False
    parts = _PART.findall(s)
    return 2 * sum(len(p) for p in parts if not _plain(p, encoding, least)) >= sum(map(len, parts)) > 0


def _pieces(run: re.Match, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The run without its UUIDs and without the parts that base spans touch; base holds those near the run."""
    text, first, last = run.string, run.start(), run.end()
    cuts = [(m.start(), m.end()) for m in UUID.finditer(text, first, last)]
    touched = [(max(s, first), min(e, last)) for s, _, e in base if s < last and first < e]
    for p in _PART.finditer(text, first, last) if touched else ():
        if any(s < p.end() and p.start() < e for s, e in touched):
            cuts.append(p.span())
    out, at = [], first
    for s, e in [*sorted(cuts + touched), (last, last)]:
        if s > at:
            start = at if at == first else at + len(text[at:s]) - len(text[at:s].lstrip(_SEPARATORS))
            if s - start >= LEAST:
                out.append((start, s))
        at = max(at, e)
    return out


def _windows(text: str, start: int, end: int, encoding, least: float) -> list[tuple[int, int]]:
    """Stretches of text[start:end] whose tokens, taken together LEAST characters or just more at a time, are random.

    A stretch ends where a part does; words of text at its ends are left out.
    """
    sizes = [len(x) for x in encoding.decode_tokens_bytes(encoding.encode_ordinary(text[start:end]))]
    found: list[list[int]] = []
    to, size, at = 0, 0, start
    for i, own in enumerate(sizes):
        while to < len(sizes) and size < LEAST:
            size += sizes[to]
            to += 1
        if size < LEAST:
            break
        if size < least * (to - i):
            if found and at <= found[-1][1]:
                found[-1][1] = at + size
            else:
                found.append([at, at + size])
        at, size = at + own, size - own
    parts = [p.span() for p in _PART.finditer(text, start, end)] if found else []
    out = []
    for s, e in found:
        own = [p for p in parts if p[0] < e and s < p[1]]
        word = lambda p: p[1] - p[0] >= 4 and bool(_WORD.fullmatch(text[p[0] : p[1]])) and _plain(text[p[0] : p[1]], encoding, least)
        inner = list(own)
        while inner and word(inner[0]):
            inner.pop(0)
        while inner and word(inner[-1]):
            inner.pop()
        for some in (inner, own):
            if some and some[-1][1] - some[0][0] >= LEAST and _random(text[some[0][0] : some[-1][1]], encoding, least):
                out.append((some[0][0], some[-1][1]))
                break
    return out


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, least: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Spans of random strings outside the base spans."""
    found = []
    by_kind = [[x for x in base if x[1] == k] for k in range(3)]  # of one kind none overlap: starts and ends are in order
    at = [0, 0, 0]
    for m in RUN.finditer(text):
        near = []
        for k, own in enumerate(by_kind):
            while at[k] < len(own) and own[at[k]][2] <= m.start():
                at[k] += 1
            i = at[k]
            while i < len(own) and own[i][0] < m.end():
                near.append(own[i])
                i += 1
        for s, e in _pieces(m, sorted(near)):
            spans = [(s, e)] if _random(text[s:e], encoding, least) else _windows(text, s, e, encoding, least)
            for a, b in spans:
                if found and a < found[-1][2]:
                    found[-1] = (found[-1][0], 3, max(b, found[-1][2]))
                else:
                    found.append((a, 3, b))
    return found


def write_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_ENCODINGS: dict[int, object] = {}


def _encoding(ranks: bytes):
    key = hash(ranks)
    if key not in _ENCODINGS:
        _ENCODINGS[key] = make_encoding(ranks)
    return _ENCODINGS[key]


def scan_column(spark: SparkSession, text: Column, ranks: bytes | None = None) -> Column:
    """struct(n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted) of a string column.

    redacted is the text with every span, overlapping ones as one, replaced by [secret]; null where the text has none.
    """
    import hashlib

    prepare(spark)
    ranks_on = spark.sparkContext.broadcast(ranks or load_ranks())

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks_on.value)
        for s in batches:
            out = []
            for t in s:
                t = t or ""
                base = base_spans(t)
                every = sorted(base + random_spans(t, base, encoding))
                n = [sum(k == i for _, k, _ in every) for i in range(4)]
                out.append((*n, hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(every), redact(t, every) if every else None))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"])
        del encoding
        give_back(_ENCODINGS)

    return scan(text)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, redacted for each row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), scan_column(docs.sparkSession, F.col(text_col)).alias("r")).select("doc_id", "r.*")
