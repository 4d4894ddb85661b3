"""Character n-grams and weighted feature tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harmonia.fixed_values import NGRAM_SIZES
from harmonia.functions.text import normalize


def ngrams_of(compact: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """All n-grams of a normalised text; one shorter than the smallest size is its own n-gram.

    A zero-width match at every position keeps this linear in the length of the
    text, where cutting substrings by position would be quadratic.
    """
    grams = F.concat(*[F.regexp_extract_all(compact, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in sizes])
    return (
        F.when(F.length(compact) >= min(sizes), grams)
        .when(compact != "", F.array(compact))
        .otherwise(F.array().cast("array<string>"))
    )


def char_ngrams(value: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """N-grams of the normalised form of any text."""
    return ngrams_of(normalize(value), sizes)


def weighted_tokens(prefix: str, value: Column, weight: int, compact: Column | None = None) -> Column:
    """The value and its n-grams as (token, weight), prefixed; nothing for an empty value.

    ``compact`` is the normalised value, where the caller has it as a column:
    long texts should be normalised once, in a projection of their own.
    """
    grams = ngrams_of(normalize(value) if compact is None else compact)
    tokens = F.concat(
        F.array(F.concat(F.lit(f"{prefix}:"), value)),
        F.transform(grams, lambda gram: F.concat(F.lit(f"{prefix}:ngram:"), gram)),
    )
    weighted = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(weight).cast("bigint").alias("weight")))
    nothing = F.array().cast("array<struct<token:string,weight:bigint>>")
    return F.when(F.coalesce(value, F.lit("")) == "", nothing).otherwise(weighted)


def weighted_list_tokens(prefix: str, values: Column, weight: int) -> Column:
    """`weighted_tokens` of every normalised text of an array."""
    present = F.coalesce(values, F.array().cast("array<string>"))
    return F.flatten(F.transform(present, lambda value: weighted_tokens(prefix, value, weight, value)))
