"""Text functions as column expressions: tokenizers, token estimate, sentences, lineage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks taken off both ends of a retrieval token, and the text that marks a cut.
TRIMMED_MARKS = ".,;:!?()[]{}\"'"
TRUNCATED = " [truncated]"


def fields(text: Column) -> Column:
    """Runs of characters that aren't white space, by Unicode; null and blank give an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def search_tokens(text: Column) -> Column:
    """Tokens of BM25, structure scores and reranking: lower case, without marks at their ends."""
    bare = F.transform(fields(F.lower(text)), lambda t: F.trim(t, F.lit(TRIMMED_MARKS)))
    return F.filter(bare, lambda t: t != "")


def answer_tokens(text: Column) -> Column:
    """Tokens of answer scores and community choice: lower case, marks kept."""
    return fields(F.lower(text))


def estimated_tokens(text: Column) -> Column:
    """Han characters plus 1.3 per word, cut to a whole number; at least 1 unless the text is blank, 0 for null."""
    known = F.coalesce(text, F.lit(""))
    han = F.regexp_count(known, F.lit(r"\p{IsHan}"))
    words = F.regexp_count(known, F.lit(r"[\p{L}\p{Nd}&&[^\p{IsHan}]]+"))
    total = (han + F.floor(words * F.lit(1.3))).cast("long")
    blank = F.regexp_replace(known, r"(?U)\s+", "") == ""
    return F.when((total <= 0) & ~blank, F.lit(1).cast("long")).otherwise(total)


def overlap_score(query: Column, content: Column) -> Column:
    """How many tokens of the query, repeated ones counted, the content has."""
    have = search_tokens(content)
    return F.size(F.filter(search_tokens(query), lambda t: F.array_contains(have, t)))


def sentences(text: Column) -> Column:
    """Sentences with the mark that ends them, trimmed; blank ones are dropped."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def lineage(metadata: Column, **values: Column) -> Column:
    """metadata with the values that are neither null nor empty; those replace what was there."""
    names = list(values)
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), values[n].cast("string").alias("value")) for n in names])
    given = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    kept = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def union_kept(*arrays: Column) -> Column:
    """Strings of several arrays in order, each once, without empty ones."""
    whole = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(whole, lambda x: F.coalesce(x, F.lit("")) != ""))
