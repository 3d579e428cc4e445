"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column, kind: str = r"\p{L}") -> Column:
    """The runs of letters (or of another class of characters) in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{kind}]+"), F.lit(0))


def spaced_words(text: Column, kind: str = r"\p{L}") -> Column:
    """The same words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{kind}]+", " "))


def tokens(text: Column) -> Column:
    """The lexical analyzer: split at blanks, every punctuation mark its own token, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{Punct}]|[^\s\p{Punct}]+)"), F.lit(1))


def normalized(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, also at the ends."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#])", r"\\$1")


def longest_ticks(text: Column) -> Column:
    """The length of the longest run of backticks."""
    return F.coalesce(F.array_max(F.transform(F.split(text, "[^`]+"), F.length)), F.lit(0))


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^", "> ")


def valid_symbol(text: Column) -> Column:
    """Whether the whole text is a qualified identifier."""
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)+$") & (F.octet_length(text) <= 256)


def valid_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def unit_vector(vector: Column) -> Column:
    """The vector divided by its length; null where it has none or is not finite."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    fit = (length > 0) & (length < float("inf")) & ~F.isnan(length)
    return F.when(fit, F.transform(vector, lambda x: x / length))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm(a) * norm(b))))
