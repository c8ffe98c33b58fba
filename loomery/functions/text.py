"""Text functions as column expressions: white space, tokens, sentences, labels, keys and hashes.

Null counts as the empty string throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, the stop words of the corpus tokenizer and of the search tokenizer.
WHITE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
STOP_WORDS = """
about after again against all also and any are based been before between both can down during each either for from has
have how into its least less many may more most much neither new novel not our over others paper per poster record
results same several that the their this three through top toward towards two under up using various via well what when
where which while whose with within without workshop across show shown propose proposed approach method methods present
presented however further among other such than then abstract keywords
""".split()
SEARCH_STOP_WORDS = """
about after again against also and are based been between both can from have into its more most not our over paper
poster record results that the their this through toward towards using via with workshop
""".split()
WORD = "[a-z0-9][a-z0-9+\\-]+"


def present(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(present(x), WHITE + "+", " "))


def normalize_token(t: Column) -> Column:
    """A token without signs at its edges and without one common ending."""
    bare = F.regexp_replace(t, "^[-+]+|[-+]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "ies$", "y"), "(ing|ers|er|ed|s)$", "")


def raw_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(present(x)), F.lit(WORD), F.lit(0))


def tokenize(x: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Normalised words of more than two characters that aren't stop words, in order.

    Words are normalised as one text with a space between: three passes of a pattern over a text, not over each word.
    """
    text = F.array_join(raw_words(x), " ")
    bare = F.regexp_replace(text, "[-+]+(?= |$)", "")  # words begin with a letter or digit
    short = F.regexp_replace(F.regexp_replace(bare, "ies(?= |$)", "y"), "(?:ing|ers|er|ed|s)(?= |$)", "")
    return F.filter(F.split(short, " "), lambda t: (F.length(t) > 2) & ~t.isin(stop))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by each pair of neighbours, joined by an underscore."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(tokens, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def string_array(x: Column) -> Column:
    """The non-empty strings of an array."""
    return F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def document_text(title: Column, abstract: Column, tags: Column) -> Column:
    """Labelled parts on lines of their own; tags only where there is no abstract."""
    t, a = normalize_whitespace(title), normalize_whitespace(abstract)
    context = F.when((a == "") & (F.size(tags) > 0), F.concat(F.lit("Context: "), F.array_join(tags, " ")))
    return F.concat_ws("\n", F.when(t != "", F.concat(F.lit("Title: "), t)), F.when(a != "", F.concat(F.lit("Abstract: "), a)), context)


def split_sentences(x: Column) -> Column:
    """Sentences of 31 to 599 characters, parted behind . ! ? and before a capital or digit."""
    parts = F.split(F.regexp_replace(present(x), WHITE + "+", " "), "(?<=[.!?])\\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (F.length(s) > 30) & (F.length(s) < 600))


def title_case(x: Column) -> Column:
    """Words, parted at spaces and underscores, each with its first letter in upper case."""
    words = F.filter(F.split(present(x), "[\\s_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def fingerprint(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def code_units(x: Column) -> Column:
    """The 16-bit units of a string: two for a character beyond the first 65 536."""
    high = lambda p: F.floor((p - 0x10000) / 0x400) + 0xD800
    units = F.transform(F.split(x, ""), lambda c: F.when(F.ascii(c) < 0x10000, F.array(F.ascii(c).cast("long"))).otherwise(F.array(high(F.ascii(c)), (F.ascii(c) - 0x10000) % 0x400 + F.lit(0xDC00).cast("long"))))
    ascii_only = F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("long"))
    return F.when(F.octet_length(x) == F.length(x), ascii_only).otherwise(F.flatten(units))


def poly_hash(x: Column, seed: int = 7) -> Column:
    """A rolling hash by 31 in signed 32 bits, of a string's code units."""
    h = F.aggregate(code_units(x), F.lit(seed).cast("long"), lambda a, c: ((a * 31 + c) + F.lit(1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31))
    return h


def fnv1a(x: Column) -> Column:
    """The 32-bit FNV-1a hash of a string's code units, as an unsigned number."""
    mask = F.lit((1 << 32) - 1)
    return F.aggregate(code_units(x), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(mask))


def bare_slug(x: Column) -> Column:
    """Letters and digits in lower case, parted by hyphens; empty if there are none."""
    return F.regexp_replace(F.regexp_replace(F.lower(present(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(x: Column, prefix: str = "record") -> Column:
    """The bare slug, or the prefix and a hash where that is empty."""
    slug = bare_slug(x)
    return F.when(slug != "", slug).otherwise(F.concat(F.lit(f"{prefix}-"), F.abs(poly_hash(present(x))).cast("string")))


def search_normal(x: Column) -> Column:
    """Lower case, ++ and # spelt out, everything but letters and digits as single spaces."""
    spelt = F.regexp_replace(F.regexp_replace(F.lower(present(x)), "\\+\\+", " plusplus "), "#", " sharp ")
    return F.trim(F.regexp_replace(spelt, "[^\\p{L}\\p{N}]+", " "))


def contains_phrase(hay: Column, needle: Column) -> Column:
    return (needle == "") | F.contains(hay, needle)


def topic_text(x: Column) -> Column:
    """Without HTML entities and macros."""
    return F.regexp_replace(F.regexp_replace(present(x), "(?i)&#x?[0-9a-f]+;|&[a-z]+;", " "), "(?i)\\\\[a-z]+\\b", " ")


def work_key(title: Column, id_: Column) -> Column:
    """What makes two records the same work: the title's letters and digits, else the id."""
    bare = F.regexp_replace(F.lower(present(title)), "(?i)\\\\[a-z]+\\b", "")
    key = F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", " "))
    return F.when(key != "", key).otherwise(present(id_))


# Latin letters with marks and what they are without.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalized_name(x: Column) -> Column:
    """Without marks, in lower case, everything but letters and digits as single spaces."""
    bare = F.regexp_replace(F.translate(present(x), _MARKED, _PLAIN), "\\p{M}", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^\\p{L}\\p{N}]+", " "))


def parse_authors(x: Column) -> Column:
    """Distinct names, in order, parted at commas, semicolons, dots of separation or the word and."""
    names = F.split(present(x), "(?i)\\s*(?:⋅|,|;|\\band\\b)\\s*")
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, "\\s+", " "))), lambda n: n != ""))


def reference_key(x: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(present(x)), "[^a-z0-9]+", " ")), 1, 240)


def strip_tags(html: Column) -> Column:
    """Text of HTML: tags as spaces, common and numeric entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(present(html), "<[^>]+>", " ")), WHITE + "+", " "))


# Named entities and what they stand for.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "\u2013", "&mdash;": "\u2014"}


def decode_entities(x: Column) -> Column:
    """Named entities, and numeric ones of one or two bytes, as characters."""
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    pieces, codes = F.split(x, "&#\\d{1,5};", -1), F.regexp_extract_all(x, F.lit("&#(\\d{1,5});"), F.lit(1))
    chars = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 4, "0")), "UTF-16BE"))
    return F.concat(pieces[0], F.array_join(F.zip_with(chars, F.slice(pieces, 2, F.size(pieces)), lambda c, p: F.concat(c, p)), ""))


def match_title(x: Column) -> Column:
    """A title's letters and digits, for exact matches."""
    return F.trim(F.regexp_replace(F.lower(present(x)), "[^a-z0-9]+", " "))


def query_title(x: Column) -> Column:
    """A title as a search query: without quotes, letters and digits parted by spaces, 220 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(present(x), '"', ""), "[^\\p{L}\\p{N}]+", " ")), 1, 220)


def safe_file_id(x: Column) -> Column:
    safe = F.substring(F.regexp_replace(present(x), "[^A-Za-z0-9_-]+", "_"), 1, 120)
    return F.when(safe != "", safe).otherwise(F.lit("record"))


def ordered_distinct_ignoring_case(xs: Column) -> Column:
    """Trimmed, non-empty values; of those that differ in case alone the first."""
    clean = F.filter(F.transform(xs, lambda v: F.trim(v)), lambda v: v != "")
    start = F.array().cast("array<string>")
    return F.aggregate(clean, start, lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)))


# Concepts too broad to tell records apart.
BROAD_CONCEPTS = [
    "ai", "artificial intelligence", "computer vision", "data science", "deep learning", "generative ai", "large language models",
    "machine learning", "natural language processing", "optimization", "reinforcement learning", "statistics", "theory",
]


def concrete_concepts(xs: Column, limit: int, excluded: Column | None = None) -> Column:
    """The first `limit` distinct concepts that aren't broad, nor among the excluded, whatever their case."""
    kept = F.filter(ordered_distinct_ignoring_case(F.transform(F.coalesce(xs, F.array().cast("array<string>")), normalize_whitespace)), lambda v: ~F.lower(v).isin(BROAD_CONCEPTS))
    if excluded is not None:
        kept = F.filter(kept, lambda v: ~F.exists(excluded, lambda e: F.lower(e) == F.lower(v)))
    return F.slice(kept, 1, limit)


# What tells introductory and applied texts, and texts that hold something like an e-mail address.
INTRO = r"(?i)\b(survey|review|tutorial|overview|foundation|background|introduction)\b"
APPLIED = r"(?i)\b(appl(y|ies|ied|ication|ications)|deploy|real.world|production|practical|clinical|industr)\b"
EMAIL = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
