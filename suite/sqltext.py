"""Pieces of SQL shared by the registered queries."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '', 'g')"


def upper(x: str) -> str:
    return f"trim(upper(regexp_replace(strip_accents({x}), '[^A-Za-z0-9]+', '_', 'g')), '_')"


def pseudonym(prefix: str, *parts: str, salt: str = "suite-salt") -> str:
    joined = " || '|' || ".join([f"'{salt}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
    return f"'{prefix}_' || substr(sha256({joined}), 1, 10)"


def size_band(x: str) -> str:
    return (
        f"CASE WHEN trunc({x}) < 11 THEN 'TPE_1_10' WHEN trunc({x}) < 50 THEN 'PME_11_49' "
        f"WHEN trunc({x}) < 250 THEN 'ETI_50_249' ELSE 'GE_250_PLUS' END"
    )


def flag(x: str) -> str:
    return f"{norm(x)} NOT IN ('', 'non', 'false', '0', 'aucun', 'aucune')"
