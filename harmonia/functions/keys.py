"""Pseudonyms and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id(prefix: str, *parts: Column, salt: str, length: int = 10) -> Column:
    """``prefix_`` and the first hex digits of sha256 over salt and key parts.

    Ten digits (40 bits) are the compatible default; with more than about a
    million keys use 16 or more, since 40 bits then start to collide.
    """
    joined = F.concat_ws("|", F.lit(salt), *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, length))


def stable_id(*parts: Column) -> Column:
    """First twelve hex digits of sha1 over the parts joined by ``|``."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(part, F.lit("")) for part in parts])), 1, 12)
