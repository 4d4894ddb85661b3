"""Text folding: compatibility decomposition without accents, as JVM expressions.

Spark has no NFKD function.  The fold tables are generated from ``unicodedata``
once per process: characters that fold to one character go through
``translate``; the few that fold to several (ligatures, fractions, ...) take a
per-character lookup that only the rows holding such a character pay for.
ASCII rows skip the folding altogether.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _char_class(codes: list[int]) -> str:
    """A regex for one character of sorted code points, as ranges.

    The look-ahead lets every character below the first one fail at once,
    instead of being held against hundreds of ranges.
    """
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    listed = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"(?=[\\x{{{codes[0]:x}}}-\\x{{10ffff}}])[{listed}]"


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[str, str], list[int]]:
    """Characters beyond ASCII that fold to letters or digits of ASCII, and code points that fold to nothing."""
    folds: dict[str, str] = {}
    marks: list[int] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(code)
            continue
        folded = _fold(char)
        if folded == "":
            marks.append(code)
        elif re.search("[A-Za-z0-9]", folded) and folded != char:
            folds[char] = folded
    return folds, marks


def folded_chars() -> dict[str, str]:
    return _folds()[0]


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    folds, marks = _folds()
    single = {char: folded for char, folded in folds.items() if len(folded) == 1}
    multiple = {char: folded for char, folded in folds.items() if len(folded) > 1}
    return "".join(single), "".join(single.values()), multiple, _char_class(marks)


def fold(value: Column) -> Column:
    """Accent-free compatibility form of a text."""
    source, target, multiple, marks = _fold_tables()
    # One text literal, folded into a map constant by the optimizer.
    lookup = F.str_to_map(
        F.lit("\x02".join(f"{char}\x01{folded}" for char, folded in multiple.items())), F.lit("\x02"), F.lit("\x01")
    )
    spelled = F.concat_ws(
        "",
        F.transform(
            F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1)),
            lambda char: F.coalesce(F.element_at(lookup, char), char),
        ),
    )
    expanded = F.when(value.rlike(_char_class(sorted(map(ord, multiple)))), spelled).otherwise(value)
    folded = F.regexp_replace(F.translate(expanded, source, target), marks, "")
    return F.when(value.rlike("[^\\x00-\\x7f]"), folded).otherwise(value)


# What is neither letter nor digit of ASCII.
_ASCII_MARKS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def normalize(value: Column) -> Column:
    """Folded, lower case, letters and digits only; a text in ASCII needs no pattern."""
    folded = F.regexp_replace(F.lower(fold(value)), "[^a-z0-9]+", "")
    return F.when(value.rlike("[^\\x00-\\x7f]"), folded).otherwise(F.translate(F.lower(value), _ASCII_MARKS, ""))


def normalize_upper(value: Column) -> Column:
    """Folded, upper case, every other run of characters one underscore, none at the ends."""
    joined = F.regexp_replace(fold(value), "[^A-Za-z0-9]+", "_")
    # A text in ASCII needs a pattern only where such characters follow one another.
    marked = F.translate(value, _ASCII_MARKS, "_" * len(_ASCII_MARKS))
    plain = F.when(marked.contains("__"), F.regexp_replace(marked, "_+", "_")).otherwise(marked)
    return F.upper(F.btrim(F.when(value.rlike("[^\\x00-\\x7f]"), joined).otherwise(plain), F.lit("_")))


def normalize_key(value: Column) -> Column:
    """Lower case, letters and digits of any script; accents stay."""
    return F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]", "")


def text(value: Column) -> Column:
    """NULL read as the empty text."""
    return F.coalesce(value, F.lit(""))


def plain_normalize(value: object) -> str:
    """`normalize` for plan-time constants such as filter values and aliases."""
    return re.sub("[^a-z0-9]+", "", _fold(str(value)).lower())


def plain_normalize_upper(value: object) -> str:
    """`normalize_upper` for plan-time constants."""
    return re.sub("[^A-Za-z0-9]+", "_", _fold(str(value))).strip("_").upper()
