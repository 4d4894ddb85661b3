"""Scores between names, types and values of columns and target fields."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from harmonia import fixed_values as fixed
from harmonia.functions.text import normalize


def name_ratio(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two names; Spark has no such function."""

    # Defined here so that it travels to the executors by value.
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return pandas_udf(ratios, DoubleType())(left, right)


def edit_ratio(left: Column, right: Column) -> Column:
    """1 less the edit distance over the longer length: a ratio without Python."""
    return F.lit(1.0) - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right), F.lit(1))


def best_ratio(name: Column, others: Column) -> Column:
    """Best ratio of a name with any of the others; 0 without others."""

    def best(names: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series(
            [
                max((difflib.SequenceMatcher(None, n, o).ratio() for o in others_), default=0.0)
                for n, others_ in zip(names, lists, strict=True)
            ],
            dtype="float64",
        )

    return pandas_udf(best, DoubleType())(name, others)


def best_alias_score(name: Column, aliases: Column) -> Column:
    """1 for an equal alias, 0.92 for a containing or contained one, else the ratio; the best counts.

    Names and aliases are normalised.  Only aliases that are neither go to Python.
    """

    def contains(alias: Column) -> Column:
        return alias.contains(name) | F.contains(name, alias)

    contained = F.when(F.exists(aliases, contains), 0.92).otherwise(0.0)
    ratio = best_ratio(name, F.filter(aliases, lambda alias: ~contains(alias)))
    return F.when(F.array_contains(aliases, name), 1.0).otherwise(F.greatest(contained, ratio))


def levenshtein_score(name: Column, aliases: Column) -> Column:
    """The same ladder with edit distance in place of the ratio: no Python, for data-sized inputs."""
    scores = F.transform(
        aliases,
        lambda alias: F.when(alias == name, 1.0)
        .when(alias.contains(name) | F.contains(name, alias), 0.92)
        .otherwise(1.0 - F.levenshtein(name, alias) / F.greatest(F.length(name), F.length(alias))),
    )
    return F.array_max(scores)


def types_compatible(source: Column, target: Column) -> Column:
    pair = F.concat_ws(">", source, target)
    return pair.isin(*[f"{a}>{b}" for a, b in fixed.COMPATIBLE_TYPES])


def type_score(source: Column, target: Column) -> Column:
    return F.when(source == target, 1.0).when(types_compatible(source, target), 0.65).otherwise(0.25)


def target_type_compatible(source: Column, target: Column) -> Column:
    """Unknown types go with every type."""
    unknown = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "")
    return unknown | (source == target) | types_compatible(source, target)


def value_evidence(examples: Column, inferred_type: Column, field: Column) -> Column:
    """How far the first values of a column speak for a target field."""
    seen = F.transform(examples, normalize)

    def any_of(*words: str) -> Column:
        return F.arrays_overlap(seen, F.array(*map(F.lit, words)))

    return (
        F.when((field == "sexe") & any_of("f", "m", "femme", "homme"), 1.0)
        .when(field.contains("date") & (inferred_type == "date"), 1.0)
        .when(field.contains("annee") & (inferred_type == "year"), 1.0)
        .when(field.contains("region") & F.exists(seen, lambda v: v.rlike("auvergne|rhone")), 1.0)
        .when(field.contains("naf") & F.exists(seen, lambda v: v.rlike("^[0-9]{4}.$")), 1.0)
        .when(field.contains("flag") & any_of("oui", "non", "true", "false"), 0.9)
        .otherwise(0.5)
    )


def uniqueness_ratio(distinct: Column, rows: Column) -> Column:
    return F.bround(distinct / F.greatest(rows, F.lit(1)), 3)
