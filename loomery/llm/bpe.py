"""BPE encoding and decoding with a published tokenizer file.

A text above LEAF_CHARS characters is encoded by tree concatenation.  It is cut into leaves of that many characters,
wherever the cuts fall, in words too.  The leaves are encoded by themselves, all those of a batch of texts together, and
neighbours are joined level by level.  At each join a window around it is encoded anew, and grown until its outermost pieces
have the ids that both sides had already.  Pieces are what stands between white space, which always separates what the
tokenizer merges; so what lies beyond agreed pieces can't change, and the joined list is exactly what encoding the whole
would give.  Distinct pieces are encoded once and kept in a table of bounded size.

A single piece may be long too: text without spaces, base64, one repeated character.  Above SPLIT_ABOVE characters it isn't
encoded by joins of texts but by a tree of its own over tokens: windows grow until their outer tokens are those that both
sides had; every pair of neighbouring tokens is then one that BPE itself produces.

Defined results: null is encoded as the empty text; empty text has no tokens and decodes to the empty text; strings of
special tokens in a text become those tokens, as the library does by default; repeated rows get equal results.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import give_back, prepare

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Characters of a leaf, of texts and of long pieces alike; pieces above SPLIT_ABOVE have a tree of their own.
LEAF_CHARS = 512
SPLIT_ABOVE = 2048
#: Pieces, and words, in the newer of two generations that a worker keeps; when it is full, the older one goes.
CACHE_ENTRIES = 150_000
#: Pieces in a call of the library, and texts whose pieces are held at once: what is held is small and of one size.
CALL, TEXTS = 5_000, 200
#: str.split() parts at these too, but the tokenizer takes them for ordinary symbols.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[^\\S\x1c-\x1f]+")
#: Letters whose lower case is one letter that composes with nothing: ASCII and Latin-1.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class Generations:
    """A table of bounded size that keeps what is asked for often: what was asked for since the last change is in `newer`."""

    def __init__(self, size: int):
        self.size, self.newer, self.older = size, {}, {}

    def turn(self) -> None:
        """To be called between batches: a full newer generation becomes the older one."""
        if len(self.newer) > self.size:
            self.newer, self.older = {}, self.newer

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; those of the older one move to the newer."""
        out = []
        for k in keys:
            if k not in self.newer:
                v = self.older.get(k)
                if v is None:
                    out.append(k)
                else:
                    self.newer[k] = v
        return out


class _Node:
    """A stretch of a text: its pieces, and whether white space stands at its head and at its tail."""

    __slots__ = ("head", "pieces", "tail")

    def __init__(self, pieces: list[str], head: bool, tail: bool):
        self.pieces, self.head, self.tail = pieces, head, tail

    @classmethod
    def leaf(cls, text: str) -> _Node:
        if _NOT_SPACE.search(text):
            return cls([p for p in _SPACES.split(text) if p], bool(_SPACES.match(text)), bool(_SPACES.match(text[-1])))
        return cls(text.split(), text[0].isspace(), text[-1].isspace())

    def window(self, right: _Node, reach: int) -> list[str]:
        """The pieces, parted anew, of the last `reach` pieces here and the first ones there."""
        a, b = self.pieces[-reach:], right.pieces[:reach]
        if self.tail or right.head or not a or not b:
            return a + b
        return [*a[:-1], a[-1] + b[0], *b[1:]]


class TreeBpe:
    """Encodes and decodes with the tokenizer described by spec (the text of its JSON file)."""

    def __init__(self, spec: str, split_above: int = SPLIT_ABOVE, leaf_chars: int = LEAF_CHARS, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a batch is shared among these; cores are shared among tasks
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)  # the file isn't parsed in Python: that would take, and scatter, far more memory
        self.split_above, self.leaf_chars = split_above, leaf_chars
        self.special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.suffix = getattr(self.whole.model, "end_of_word_suffix", None) or ""
        self.spec = spec
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.names = [self.whole.id_to_token(i) or "" for i in range(size)]
        self.cache, self.words = Generations(cache_entries), Generations(cache_entries)
        #: Joining words into one call needs tokens that show where a word ends.
        self.closes = np.array([bool(self.suffix) and n.endswith(self.suffix) for n in self.names])
        self.joins = bool(self.suffix) and "\\p{L}" in str(self.whole.pre_tokenizer)

    @functools.cached_property
    def plain(self) -> list[str]:
        """What each token stands for: its name without the mark of a word's end."""
        cut = len(self.suffix)
        return [n[:-cut] if cut and n.endswith(self.suffix) else n for n in self.names]

    def _model(self, **changes) -> "Tokenizer":
        """The model alone: nothing is normalised or parted."""
        from tokenizers import Tokenizer

        parts = json.loads(self.spec)
        bare = parts | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        return Tokenizer.from_str(json.dumps(bare | {"model": parts["model"] | changes}))

    @functools.cached_property
    def ends(self) -> "Tokenizer":
        """For what reaches the end of a word.  Made only when a long piece comes, as it is as large as the tokenizer."""
        return self._model()

    @functools.cached_property
    def inner(self) -> "Tokenizer":
        """For what lies inside a word."""
        return self._model(end_of_word_suffix=None)

    def encode_long(self, word: str) -> list[int]:
        """The ids of one unsplit word, already normalised and byte-mapped, by tree concatenation."""
        n = self.leaf_chars
        leaves = [word[i : i + n] for i in range(0, len(word), n)]
        nodes = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)]
        nodes.append(self.ends.encode(leaves[-1], add_special_tokens=False).ids)
        while len(nodes) > 1:
            nodes = self._join_level(nodes)
        return nodes[0]

    def _join_level(self, nodes: list[list[int]]) -> list[list[int]]:
        pairs = [(nodes[i], nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
        joined: list[list[int] | None] = [None] * len(pairs)
        at_end = len(nodes) - 2 if len(nodes) % 2 == 0 else -1  # only the last pair of an even level reaches the word's end
        reach, open_joins = [1] * len(pairs), list(range(len(pairs)))
        while open_joins:
            windows = []
            for j in open_joins:
                left, right = pairs[j]
                k = reach[j]
                windows.append("".join(self.plain[t] for t in left[-k:]) + "".join(self.plain[t] for t in right[:k]))
            final = [2 * j == at_end and reach[j] >= len(pairs[j][1]) for j in open_joins]
            new: list[Sequence[int]] = [()] * len(windows)
            for coder, which in ((self.inner, False), (self.ends, True)):
                own = [i for i, f in enumerate(final) if f is which]
                for i, e in zip(own, coder.encode_batch([windows[i] for i in own], add_special_tokens=False), strict=True):
                    new[i] = e.ids
            still = []
            for j, ids in zip(open_joins, new, strict=True):
                left, right = pairs[j]
                k = reach[j]
                if (k >= len(left) or ids[0] == left[-k]) and (k >= len(right) or ids[-1] == right[k - 1]):
                    joined[j] = left[: max(0, len(left) - k)] + list(ids) + right[k:]
                else:
                    reach[j] = 2 * k
                    still.append(j)
            open_joins = still
        return [*joined, *([nodes[-1]] if len(nodes) % 2 else [])]  # type: ignore[list-item]

    def _encode_piece(self, piece: str) -> list[int]:
        """A piece too long for one call: parted at special tokens and by the tokenizer's own rules, long words joined."""
        ids: list[int] = []
        for part in self.special_re.split(piece) if self.special_re else [piece]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                text = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                words = [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]
                short = iter(self.ends.encode_batch([w for w in words if len(w) <= self.split_above], add_special_tokens=False))
                for w in words:
                    ids += next(short).ids if len(w) <= self.split_above else self.encode_long(w)
        return ids

    def _encode_words(self, pieces: list[str]) -> list[str]:
        """Caches the pieces that are one word of plain Latin letters, or one with full stops or commas behind; returns the rest."""
        rest, found = [], []
        for p in pieces:
            core = p.rstrip(".,")
            if core.isalpha() and _LATIN.fullmatch(core):
                found.append((p, core.lower(), p[len(core) :]))
            else:
                rest.append(p)
        new = self.words.missing({x for _, w, tail in found for x in (w, tail) if x})
        words, cache = self.words.newer, self.cache.newer
        for at in range(0, len(new), CALL):
            some = new[at : at + CALL]
            ids = np.asarray(self.whole.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            for w, own in zip(some, np.split(ids, np.flatnonzero(self.closes[ids])[:-1] + 1), strict=True):
                words[w] = own.tobytes()
        for p, w, tail in found:
            cache[p] = words[w] + words[tail] if tail else words[w]
        return rest

    def encode_batch(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        return [ids for ids, _ in self.encode_and_count(texts)]

    def encode_and_count(self, texts: Sequence[str]) -> list[tuple[np.ndarray, int]]:
        """Ids of each text, and how many joins of leaves they came through."""
        return [a for at in range(0, len(texts), TEXTS) for a in self._encode_some(texts[at : at + TEXTS])]

    def _learn(self, pieces: set[str]) -> None:
        """Sees to it that the ids of these pieces are in the newer generation; those of long pieces are left out."""
        new = self.cache.missing({p for p in pieces if len(p) <= self.split_above})
        usual = self._encode_words(new) if self.joins else new
        for at in range(0, len(usual), CALL):
            some = usual[at : at + CALL]
            for p, e in zip(some, self.whole.encode_batch(some, add_special_tokens=False), strict=True):
                self.cache.newer[p] = np.asarray(e.ids, "<u4").tobytes()

    def _encode_some(self, texts: Sequence[str]) -> list[tuple[np.ndarray, int]]:
        self.cache.turn()
        self.words.turn()
        n = self.leaf_chars
        levels = [[_Node.leaf(t[i : i + n]) for i in range(0, len(t), n)] for t in texts]
        self._learn({p for nodes in levels for x in nodes for p in x.pieces})
        joins = [max(0, len(nodes) - 1) for nodes in levels]
        open_ = [i for i, k in enumerate(joins) if k]
        while open_:
            pairs = [(nodes[j], nodes[j + 1]) for nodes in (levels[i] for i in open_) for j in range(0, len(nodes) - 1, 2)]
            joined = iter(self._join_texts(pairs))
            for i in open_:
                levels[i] = [next(joined) for _ in range(len(levels[i]) // 2)] + levels[i][len(levels[i]) // 2 * 2 :]
            open_ = [i for i in open_ if len(levels[i]) > 1]
        out = []
        for nodes, k in zip(levels, joins, strict=True):
            ids = [self.cache.newer[p] if len(p) <= self.split_above else np.asarray(self._encode_piece(p), "<u4").tobytes() for p in (nodes[0].pieces if nodes else ())]
            out.append((np.frombuffer(b"".join(ids), "<u4"), k))
        return out

    def _join_texts(self, pairs: list[tuple[_Node, _Node]]) -> list[_Node]:
        """Each pair as one node; windows of all pairs are encoded together, and those that don't agree yet are grown."""
        joined: list[_Node | None] = [None] * len(pairs)
        open_, reach = range(len(pairs)), 1
        ids = self.cache.newer.get
        while open_:
            windows = [pairs[j][0].window(pairs[j][1], reach) for j in open_]
            self._learn({p for w in windows for p in w})
            still = []
            for j, w in zip(open_, windows, strict=True):
                left, right = pairs[j]
                agrees = reach >= len(left.pieces) or (same := ids(w[0])) is not None and same == ids(left.pieces[-reach])
                agrees = agrees and (reach >= len(right.pieces) or (same := ids(w[-1])) is not None and same == ids(right.pieces[reach - 1]))
                if agrees:
                    joined[j] = _Node(left.pieces[: max(0, len(left.pieces) - reach)] + w + right.pieces[reach:], left.head, right.tail)
                else:
                    still.append(j)
            open_, reach = still, 2 * reach
        return joined  # type: ignore[return-value]

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The library's decoding with special tokens kept: with no decoder in the file, token names joined by spaces."""
        if self.whole.decoder is not None:
            return self.whole.decode(list(ids), skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, np.asarray(ids).tolist()))


def load_spec(path: str | None = None) -> str:
    """The tokenizer file's text, read once by the driver; by default the word BPE of the installed tokenizer files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


_CODERS: dict[int, TreeBpe] = {}


def _coder(key: int, spec: str, cache_entries: int = CACHE_ENTRIES) -> TreeBpe:
    """One coder for each task and tokenizer, with the pieces it has met."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TreeBpe(spec, cache_entries=cache_entries)
    return _CODERS[key]


def encode_column(spark: SparkSession, text: Column, spec: str | None = None) -> Column:
    """array<int> of token ids of a string column (null: empty)."""
    spec_on = spark.sparkContext.broadcast(spec or load_spec())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(hash(spec_on.value), spec_on.value)
        for s in batches:
            yield pd.Series([a.astype("int32") for a in coder.encode_batch([x or "" for x in s])], dtype=object)
        del coder
        give_back(_CODERS)

    return ids(text)


def decode_column(spark: SparkSession, ids: Column, spec: str | None = None) -> Column:
    """The string of an array<int> column of token ids (null: empty)."""
    spec_on = spark.sparkContext.broadcast(spec or load_spec())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(hash(spec_on.value), spec_on.value)
        for s in batches:
            yield pd.Series(["" if x is None else coder.decode(x) for x in s], dtype=object)
        del coder
        give_back(_CODERS)

    return text(ids)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: str | None = None) -> DataFrame:
    """Encodes and decodes: id, ids array<int>, decoded string.  Other columns are left out, so names can't clash."""
    spark = prepare(docs.sparkSession)
    spec_on = spark.sparkContext.broadcast(spec or load_spec())

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(hash(spec_on.value), spec_on.value)
        for s in batches:
            ids = coder.encode_batch([x or "" for x in s])
            yield pd.DataFrame({"ids": pd.Series([a.view("<i4") for a in ids], dtype=object), "decoded": pd.Series([coder.decode(a) for a in ids], dtype=object)})
        del coder
        give_back(_CODERS)

    rows = docs.select(F.col(id_col).alias("doc_id"), both(F.col(text_col)).alias("r"))
    return rows.select("doc_id", "r.ids", "r.decoded")


def token_digests(docs: DataFrame, spec: str | None = None, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins: the same encoding and decoding, reduced to digests by the worker.

    n_joins is the number of joins of leaves that a text's ids came through.  Fewer cache entries take less memory and more time.
    """
    import hashlib

    spark = prepare(docs.sparkSession)
    spec_on = spark.sparkContext.broadcast(spec or load_spec())

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(hash(spec_on.value), spec_on.value, cache_entries)
        for s in batches:
            found = coder.encode_and_count([x or "" for x in s])
            ids = [a for a, _ in found]
            yield pd.DataFrame({
                "n_tokens": [len(a) for a in ids],
                "ids_sha256": [hashlib.sha256(a.tobytes()).hexdigest() for a in ids],
                "decoded_sha256": [hashlib.sha256(coder.decode(a).encode("utf-8", "replace")).hexdigest() for a in ids],
                "n_joins": [k for _, k in found],
            })
        del coder
        give_back(_CODERS)

    return docs.select("doc_id", digests(F.col("text")).alias("r")).select("doc_id", "r.*")
