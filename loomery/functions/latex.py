"""Titles and abstracts with LaTeX in them, as plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.text import ordered_distinct_ignoring_case, present

# Greek letters by name, and macros whose argument stands for itself.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "theta": "θ"}
STYLES = "texttt|textbf|textit|mathrm|mathbf|mathsf|operatorname"
# Macros of text, and then those of mathematics, that abstracts lose; in two passes, in this order.
TEXT_STYLES = "textit|texttt|textbf|textrm|textsc|emph|text"
MATH_STYLES = "mathbb|mathbf|mathrm|mathsf|mathcal"
# Plain text between dollar signs, and lines that are no titles.
PLAIN_MATH = r"""^[A-Za-z0-9][A-Za-z0-9\s.,;:'"!?+\-/]*(?:\^[0-9]+)?$"""
NO_TITLES = (
    r"(?i)^(url\s+https?:|https?:|arxiv preprint|openreview\.net|association for computational linguistics)$",
    r"(?i)^(and|[a-z]\.)\s+",
    r"^[A-Za-z]{1,3},\s*[A-Z]\.",
    r"[a-z]{3,}[A-Z]\.,",
    r"^(?:[A-Z][\w'\u2019.-]+,\s*(?:[A-Z]\.|[A-Z][a-z]+|et al\.?)\s*){2,}$",
    r"^[A-Z]\.,?\s+",
    r"^[A-Z][\w'\u2019.-]+,\s+[A-Z]\.?[, ]",
)


def plain_math_title(x: Column) -> Column:
    """Macros unwrapped, Greek letters by name, dollar signs gone, a space behind a colon."""
    t = F.replace(F.replace(present(x), F.lit("\\mathbb{R}"), F.lit("ℝ")), F.lit("\\mathcal{O}"), F.lit("O"))
    t = F.regexp_replace(t, rf"\\(?:{STYLES})\{{([^{{}}]+)\}}", "$1")
    for name, letter in GREEK.items():
        t = F.regexp_replace(t, rf"\\{name}(?![a-zA-Z])", letter)
    t = F.regexp_replace(F.regexp_replace(t, r"\\([a-zA-Z]+)", "$1"), r"\$([^$]+)\$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, ":([A-Za-z])", ": $1"), r"\s+", " "))


def clean_abstract(x: Column) -> Column:
    """Without citations, styles unwrapped, plain text between dollar signs freed of them, no space before punctuation."""
    t = F.regexp_replace(F.regexp_replace(present(x), r"(?i)\[cite:\s*\d+(?:\s*,\s*\d+)*\]", ""), r"\\cite[tp]?\{[^{}]*\}", "")
    for styles in (TEXT_STYLES, MATH_STYLES):
        t = F.regexp_replace(t, rf"\\(?:{styles})\{{([^{{}}]*)\}}", "$1")

    def shown(inside: Column) -> Column:
        return F.when(inside.rlike(PLAIN_MATH), inside).otherwise(F.concat(F.lit("$"), inside, F.lit("$")))

    formula = r"\$([^$]+)\$"
    between, formulas = F.split(t, formula, -1), F.regexp_extract_all(t, F.lit(formula), F.lit(1))
    behind = F.zip_with(formulas, F.slice(between, 2, F.size(between)), lambda f, rest: F.concat(shown(F.trim(f)), rest))
    joined = F.concat(between[0], F.array_join(behind, ""))
    return F.regexp_replace(F.regexp_replace(joined, r"\s+([,.;:])", "$1"), r"\s{2,}", " ")


def looks_like_citation_title(x: Column) -> Column:
    """Long enough for a title, of three words or more, and not an address, a publisher or a run of names."""
    t = F.trim(present(x))
    odd = F.lit(False)
    for p in NO_TITLES:
        odd = odd | t.rlike(p)
    return (F.length(t) >= 18) & ~odd & (F.size(F.split(t, r"\s+")) >= 3) & t.rlike("(?i)[a-z]{3,}")


def shown_references(titles: Column, limit: int = 12) -> Column:
    """The first distinct titles, whatever their case, that look like ones."""
    return F.slice(F.filter(ordered_distinct_ignoring_case(titles), looks_like_citation_title), 1, limit)
