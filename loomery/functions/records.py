"""Labels and keys of records, as column expressions over the columns of a corpus row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.text import normalize_whitespace, present, search_normal


def type_label(t: Column) -> Column:
    return F.when(t == "paper", "Paper").when(t == "poster", "Poster").when(t == "workshop", "Workshop").when(t == "map", "Map").otherwise(t)


def presentation_kind(t: Column, kind: Column, labels: Column) -> Column:
    return F.when(t != "paper", present(kind)).when(F.array_contains(labels, "Oral"), "Oral").when(F.array_contains(labels, "Spotlight"), "Spotlight").otherwise("")


def presentation_mode(t: Column, kind: Column, session: Column) -> Column:
    return F.when((t == "paper") & F.concat_ws(" ", kind, session).rlike("(?i)poster"), "Poster session").otherwise("")


def viewer_kind(t: Column, kind: Column, labels: Column, group: Column, category: Column) -> Column:
    shown = presentation_kind(t, kind, labels)
    return F.when(t == "paper", F.concat(F.lit("Paper · "), F.when(shown != "", shown).otherwise(group))).otherwise(F.concat(type_label(t), F.lit(" · "), category))


def asset_label(pdf: Column, slide: Column, poster: Column) -> Column:
    return F.when(pdf, "PDF").when(slide, "Slides").when(poster, "Poster").otherwise("Metadata")


def status_class(t: Column, status: Column) -> Column:
    return F.when(status == "downloaded", "good").when((t == "paper") & (status == "blocked"), "warn").when(status == "blocked", "bad").when(status == "unavailable", "warn").otherwise("")


# Shown names of the states of a record.
STATUS_NAMES = {
    "accepted_public": "Accepted public", "metadata_only": "Metadata only", "downloaded": "Downloaded", "blocked": "Blocked",
    "unavailable": "Unavailable", "failed": "Failed", "skipped": "Skipped",
}


def status_label(status: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STATUS_NAMES.items() for x in pair])
    return F.coalesce(names[status], status)


def result_details(session: Column, room: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(session, F.lit("")), F.nullif(room, F.lit("")))


def presentation_id(*fields: Column) -> Column:
    found = [F.nullif(F.regexp_extract(f, "(?:icml:|/poster/)(\\d+)", 1), F.lit("")) for f in fields]
    return F.coalesce(*found, F.lit(""))


def forum_id(*fields: Column) -> Column:
    found = [F.nullif(F.when(~f.rlike("(?i)openreview\\.net/group\\?"), F.regexp_extract(f, "(?:[?&]id=|openreview:)([^;&]+)", 1)), F.lit("")) for f in fields]
    return F.coalesce(*[F.try_url_decode(f) for f in found], F.lit(""))


def availability(status: Column) -> Column:
    return F.when(status == "downloaded", "Downloaded").otherwise("Metadata only")


def display_availability(t: Column, status: Column, label: Column, pdf_url: Column) -> Column:
    return F.when((t == "paper") & (status == "blocked"), F.when(pdf_url != "", "OpenReview PDF").otherwise("PDF pending")).otherwise(F.coalesce(F.nullif(label, F.lit("")), F.lit("Metadata only")))


def search_parts(title: Column, authors: Column, abstract: Column, tags: Column) -> dict[str, Column]:
    return {"title": search_normal(title), "authors": search_normal(authors), "abstract": search_normal(abstract), "tags": search_normal(tags)}


def matched_field(parts: dict[str, Column], needle: Column) -> Column:
    """The first field, in order of weight, that holds the phrase."""
    found = [F.when(F.contains(parts[f], needle), f) for f in ("title", "authors", "abstract", "tags")]
    return F.when(needle == "", "").otherwise(F.coalesce(*found, F.lit("")))


def overlap_strength(shared: Column, score: Column) -> Column:
    return F.when((shared >= 5) | (score >= 0.12), "strong").when((shared >= 3) | (score >= 0.06), "moderate").otherwise("weak")


def similarity_band(score: Column) -> Column:
    return F.when(score >= 0.9, "tight local neighborhood").when(score >= 0.75, "clear related neighborhood").otherwise("broad topical neighborhood")


def work_share(n: Column, total: Column) -> Column:
    share = n * 100.0 / total
    return F.when(total == 0, "0.0").when((share > 0) & (share < 0.1), "<0.1").otherwise(F.format_number(share, 1))


def embedding_text(title: Column, abstract: Column, *tags: Column) -> Column:
    """What a record's search vector is made of, a part a line."""
    t = normalize_whitespace(title)
    parts = [t, normalize_whitespace(F.regexp_replace(t, "[$^~\\\\]", " ")), normalize_whitespace(abstract), normalize_whitespace(F.concat_ws(" ", *tags))]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def client_embedding_text(title: Column, search: dict[str, Column], areas: Column, domains: Column, categories: Column, cluster: Column) -> Column:
    """What the client makes a record's search vector of: the plain title, the search parts, tags and the cluster's label, a part a line."""
    parts = [title, search["title"], search["abstract"], search["tags"], *[F.array_join(x, " ") for x in (areas, domains, categories)], cluster]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def scale_map_value(v: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, 50.0).otherwise(5 + (v - low) / (high - low) * 90)


# Hosts whose pages don't show inside others.
CLOSED_HOSTS = ("icml.cc", "openreview.net", "docs.google.com", "drive.google.com", "sites.google.com")


def embeddable(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), "^www\\.", "")
    closed = F.lit(False)
    for h in CLOSED_HOSTS:
        closed = closed | (host == h) | host.endswith("." + h)
    return (host != "") & ~closed
