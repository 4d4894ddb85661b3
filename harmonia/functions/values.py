"""Value tests, value transforms and their statuses, all as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions.text import (
    normalize,
    normalize_upper,
    plain_normalize,
    plain_normalize_upper,
    text,
)


# --- tests ------------------------------------------------------------------------
def is_year(value: Column) -> Column:
    return value.rlike("^(19|20)[0-9]{2}$")


def is_date(value: Column) -> Column:
    """ISO, day/month/year or day-month-year; one-digit days and months are fine."""
    iso = F.when(value.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(value, "yyyy-M-d"))
    french = F.when(
        value.rlike("^[0-9]{1,2}(/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}$"),
        F.try_to_date(F.translate(value, "-", "/"), "d/M/yyyy"),
    )
    return F.coalesce(iso, french).isNotNull()


_NUMBER = (
    "^\\s*[+-]?(([0-9]+(_[0-9]+)*)(\\.([0-9]+(_[0-9]+)*)?)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\\s*$"
    "|^\\s*[+-]?(?i:inf|infinity|nan)\\s*$"
)


def number(value: Column) -> Column:
    """Number with a decimal point or comma, NULL for any other text."""
    pointed = F.translate(value, ",", ".")
    return F.when(pointed.rlike(_NUMBER), F.trim(F.translate(pointed, "_", "")).try_cast("double"))


def is_number(value: Column) -> Column:
    return number(value).isNotNull()


def is_code(value: Column) -> Column:
    return value.rlike("^[0-9]{2,4}[a-zA-Z]?$")


def parse_date(value: Column) -> Column:
    """Calendar date of an ISO date or timestamp, or of the two French forms.

    The date is cut out of the text, never cast from a timestamp, so the session
    time zone cannot move it.
    """
    trimmed = F.trim(value)
    iso = F.regexp_extract(
        trimmed, "^([0-9]{4}-[0-9]{2}-[0-9]{2})($|[T ][0-9]{2}([:0-9.,]*)(Z|[+-][0-9:]{2,8})?$)", 1
    )
    loose = F.when(trimmed.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(trimmed, "yyyy-M-d"))
    basic = F.regexp_extract(trimmed, "^([0-9]{8})($|T[0-9]{2}[0-9:.,]*(Z|[+-][0-9:]{2,8})?$)", 1)
    french = F.when(
        trimmed.rlike("^[0-9]{1,2}(/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}$"),
        F.try_to_date(F.translate(trimmed, "-", "/"), "d/M/yyyy"),
    )
    return F.coalesce(
        F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
        loose,
        F.try_to_date(F.nullif(basic, F.lit("")), "yyyyMMdd"),
        french,
    )


# --- transforms ---------------------------------------------------------------------
def _has(normalized: Column, *words: str) -> Column:
    return normalized.rlike("|".join(words))


def _has_none(normalized: Column, *words: str) -> Column:
    """True for most values: asked first, it spares them the other questions, each of which would fold the text again."""
    return ~_has(normalized, *words)


def normalize_sex(value: Column) -> Column:
    n = normalize(value)
    return (
        F.when(n.isin("f", "femme"), "F")
        .when(n.isin("m", "h", "homme"), "M")
        .when(text(value) != "", "INCONNU")
        .otherwise("")
    )


def classify_size(value: Column) -> Column:
    size = number(value)
    whole = F.when(~F.isnan(size), F.when(size < 0, F.ceil(size)).otherwise(F.floor(size)))
    return (
        F.when(whole.isNull(), "")
        .when(whole < 11, "TPE_1_10")
        .when(whole < 50, "PME_11_49")
        .when(whole < 250, "ETI_50_249")
        .otherwise("GE_250_PLUS")
    )


def age_at(year: Column, reference_year: int) -> Column:
    return F.lit(reference_year) - F.trim(year).try_cast("int")


def age_class(year: Column, reference_year: int) -> Column:
    age = age_at(year, reference_year)
    return (
        F.when(~is_year(text(year)), "")
        .when(age < 30, "AGE_18_29")
        .when(age < 45, "AGE_30_44")
        .when(age < 55, "AGE_45_54")
        .otherwise("AGE_55_PLUS")
    )


def normalize_visit_type(value: Column) -> Column:
    n = normalize(value)
    return (
        F.when(_has_none(n, "^vr$", "reprise", "period", "vip"), normalize_upper(value))
        .when(n.isin("vr", "visitereprise"), "REPRISE")
        .when(_has(n, "pre") & _has(n, "reprise"), "PRE_REPRISE")
        .when(_has(n, "reprise"), "REPRISE")
        .when(_has(n, "period", "vip"), "VIP_PERIODIQUE")
        .otherwise(normalize_upper(value))
    )


def normalize_conclusion(value: Column) -> Column:
    n = normalize(value)
    return (
        F.when(_has_none(n, "pdp", "restriction", "apte"), normalize_upper(value))
        .when(_has(n, "pdp"), "ORIENTATION_PDP")
        .when(_has(n, "restriction"), "APTE_AVEC_RESTRICTION")
        .when(_has(n, "inapte"), "INAPTE")
        .when(_has(n, "apte"), "APTE")
        .otherwise(normalize_upper(value))
    )


_DUST = ("bois", "chim", "poussiere")
_REPETITIVE = ("repetitif", "gestes")


def normalize_exposure(value: Column) -> Column:
    n = normalize(value)
    return (
        F.when(_has_none(n, *_DUST, "manutention", *_REPETITIVE), normalize_upper(value))
        .when(_has(n, *_DUST), "POUSSIERES_BOIS")
        .when(_has(n, "manutention"), "MANUTENTION_MANUELLE")
        .when(_has(n, *_REPETITIVE), "GESTES_REPETITIFS")
        .otherwise(normalize_upper(value))
    )


def exposure_category(value: Column) -> Column:
    n = normalize(value)
    return (
        F.when(_has_none(n, *_DUST, "manutention", *_REPETITIVE, "bruit"), "AUTRE")
        .when(_has(n, *_DUST), "CHIMIQUE")
        .when(_has(n, "manutention", *_REPETITIVE), "BIOMECANIQUE")
        .when(_has(n, "bruit"), "BRUIT")
        .otherwise("AUTRE")
    )


def flag(value: Column) -> Column:
    """Silver form of a yes/no text: anything that is not a known "no" is true."""
    return ~text(normalize(value)).isin(fixed.FLAG_FALSE)


def to_flag(value: Column) -> Column:
    return F.when(flag(value), "true").otherwise("false")


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "normalize_sex": normalize_sex,
    "normalize_visit_type": normalize_visit_type,
    "normalize_conclusion": normalize_conclusion,
    "normalize_exposure": normalize_exposure,
    "exposure_category": exposure_category,
    "to_flag": to_flag,
    "classify_size": classify_size,
}


def apply_transform(name: str | None, value: Column) -> Column:
    """The named transform; unknown names leave the value as it is."""
    return TRANSFORMS.get(name or "", lambda column: column)(value)


def apply_transform_column(name: Column, value: Column) -> Column:
    """Transform chosen per row by a column of names."""
    chain = F.when(F.lit(False), value)
    for transform, build in TRANSFORMS.items():
        chain = chain.when(name == transform, build(value))
    return chain.otherwise(value)


def value_mapping_status(transform: Column, source: Column, target: Column) -> Column:
    unknown = F.lit(False)
    for name, concepts in fixed.KNOWN_CONCEPTS.items():
        unknown = unknown | ((transform == name) & ~target.isin(concepts))
    for name, concept in fixed.UNKNOWN_CONCEPTS.items():
        unknown = unknown | ((transform == name) & (target == concept))
    return (
        F.when(text(source) == "", "ignore_empty")
        .when(F.coalesce(unknown, F.lit(False)), fixed.TO_REVIEW)
        .otherwise("auto")
    )


# --- comparison form used by event filters ---------------------------------------------
def boolean_text(value: Column) -> Column:
    n = text(normalize(value))
    return F.when(n.isin(fixed.TRUE_WORDS), "true").when(n.isin(fixed.FALSE_WORDS), "false").otherwise(n)


def normalized_scalar(value: Column) -> Column:
    n = text(normalize(value))
    return (
        F.when(n.isin(fixed.TRUE_WORDS), "true")
        .when(n.isin(fixed.FALSE_WORDS), "false")
        .otherwise(text(normalize_upper(value)))
    )


def plain_boolean_text(value: object) -> str:
    n = plain_normalize(value)
    if n in fixed.TRUE_WORDS:
        return "true"
    return "false" if n in fixed.FALSE_WORDS else n


def plain_scalar(value: object) -> str:
    boolean = plain_boolean_text(value)
    return boolean if boolean in ("true", "false") else plain_normalize_upper(value)


# --- arrays of values -----------------------------------------------------------------
def values_are_boolean_like(values: Column) -> Column:
    return F.coalesce(
        F.forall(values, lambda v: (text(v) == "") | normalize(v).isin(fixed.BOOLEAN_LIKE)), F.lit(True)
    )


def suggestion_status(score: Column) -> Column:
    return (
        F.when(score >= fixed.STRONG_SCORE, "strong_candidate")
        .when(score >= fixed.REVIEW_SCORE, "review_candidate")
        .otherwise("low_confidence")
    )


def value_mapping_label(status: Column) -> Column:
    return (
        F.when(status.isin(*fixed.POSITIVE_VALUE_STATUSES), "positive")
        .when(status == fixed.TO_REVIEW, "needs_review")
        .when(status == fixed.REJECTED, "rejected")
        .when(text(status) == "", "unknown")
        .otherwise(status)
    )
