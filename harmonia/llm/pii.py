"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is built-in column functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35
LEAST_SCORE = 0.5


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _octets(found: Column) -> Column:
    """All four numbers are at most 255, whatever their leading zeros."""
    return F.forall(
        F.split(found, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
        & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
    )


def _card(found: Column) -> Column:
    digits = _digits(found)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def _mod97(found: Column) -> Column:
    """The account number's check: its first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _always(found: Column) -> Column:
    return found.isNotNull()


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``score`` is what a confirmed span has by itself; one of the ``context``
    words in the CONTEXT_CHARS characters before it, or for kinds that are not
    ``base`` after it, adds CONTEXT_GAIN.  Spans below LEAST_SCORE are dropped,
    but never those of ``base`` kinds.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


# Length of an account number by country (the registry of ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# A country's number ends at its length, whatever follows it; else the longest run that stops before such a number is tried.
IBAN_KNOWN = "|".join(
    f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_LENGTHS.items()
)

# Runs are scanned once: a run that fails from its first character fails from
# every later one, so a match may begin only at a run's start or after the match
# before.  Possessive repeats accept the same texts without deep recursion.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.9,
         "mail|contact|write to|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", _octets, 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.7, "card|visa|credit|payment|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7,
         "phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{IBAN_KNOWN}|[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{IBAN_KNOWN})(?![A-Za-z0-9])))?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])", _mod97, 0.8,
         "iban|account|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _always, 0.3,
         "ssn|social security|insurance|tax id", base=False),
    Kind("secret", r"(?<![A-Za-z0-9_])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9_])", _always, 0.2,
         "token|key|secret|password|passwd|credential", base=False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)


# Texts are read in pieces of so many code points, so a span's surroundings cost the same wherever it stands.
PIECE_CHARS = 64
# Sums over long arrays run block by block: an array grows within a block and over the blocks only.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each place of an array of counts, its value combined with all before it."""
    nothing = F.array().cast("array<int>")

    def grown(block: Column) -> Column:
        return F.aggregate(
            block, nothing, lambda acc, v: F.concat(acc, F.array(combine(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), v)))
        )

    def joined(blocks: Column) -> Column:
        return _let(
            grown(F.transform(blocks, lambda block: F.get(block, F.size(block) - 1))),
            lambda sums: F.flatten(F.transform(blocks, lambda block, i: _let(
                F.coalesce(F.get(sums, i - 1), F.lit(0)), lambda before: F.transform(block, lambda v: combine(before, v))
            ))),
        )

    return _let(values, lambda held: F.when(F.size(held) == 0, nothing).otherwise(_let(
        F.transform(F.sequence(F.lit(0), F.size(held) - 1, F.lit(BLOCK)), lambda at: grown(F.slice(held, at + 1, BLOCK))), joined
    )))


def _cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` on of a text in pieces."""
    first = F.floor(start / PIECE_CHARS).cast("int")
    last = F.floor((start + length - 1) / PIECE_CHARS).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE_CHARS + 1, length)


def _spans(text: Column, pieces: Column, found: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind: code points, end exclusive.

    What lies between the matches gives each match its place.
    """
    between = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
    ends = _running(F.zip_with(between, found, lambda gap, match: F.length(gap) + F.length(match)), lambda a, b: a + b)
    confirmed = F.filter(
        F.arrays_zip(found.alias("found"), ends.alias("end")), lambda m: F.coalesce(kind.confirm(m["found"]), F.lit(False))
    )

    def near(start: Column, length: Column) -> Column:
        return F.lower(_cut(pieces, start, length)).rlike(f"(?:{kind.context})")

    def scored(m: Column) -> Column:
        start = m["end"] - F.length(m["found"])
        met = near(F.greatest(start - CONTEXT_CHARS, F.lit(0)), F.least(start, F.lit(CONTEXT_CHARS)))
        if not kind.base:
            met = met | near(m["end"], F.lit(CONTEXT_CHARS))
        gain = F.when(met, CONTEXT_GAIN).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), m["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(kind.score) + gain).alias("score"),
        )

    spans = F.transform(confirmed, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def with_spans(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the spans of all kinds, by kind as listed and then by start, as column ``into``.

    ``<into>_pieces`` holds the text in pieces of PIECE_CHARS code points, where
    there are spans; names that begin with ``into`` and an underscore are used on the way.
    """
    held = docs
    for kind in KINDS:
        held = held.withColumn(f"{into}_{kind.name}", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(kind.pattern), 0))
    matches = [F.col(f"{into}_{kind.name}") for kind in KINDS]
    some = F.greatest(*(F.size(found) for found in matches)) > 0
    held = held.withColumn(
        f"{into}_pieces",
        F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), 0)).otherwise(F.array().cast("array<string>")),
    )
    nothing = F.array().cast(_SPAN)
    parts = [
        F.when(F.size(found) > 0, _spans(F.col(text), F.col(f"{into}_pieces"), found, kind)).otherwise(nothing)
        for kind, found in zip(KINDS, matches, strict=True)
    ]
    return held.withColumn(into, F.concat(*parts)).drop(*(f"{into}_{kind.name}" for kind in KINDS))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans: str, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long")


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data in every row of ``docs`` (``doc_id, text``).

    ``n_<kind>`` and ``base_sha256`` cover the base kinds (email, ip, card,
    phone), leftmost and non-overlapping per kind; ``spans`` lists those and the
    added ones (accounts by mod-97, numbers and secrets that need a context
    word) as kind:start:end.  Spans of different kinds may overlap.  NULL and
    empty texts have none.  Repeated rows each get their result; a NULL
    ``doc_id`` is carried through; other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_spans(narrow, "text", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count("spans", name).alias(f"n_{name}") for name in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redacted(text: Column, pieces: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become the first of them."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def marked(rows: Column, reach: Column) -> Column:
        # A span begins a group where all before it have ended.
        heads = F.filter(
            F.transform(rows, lambda s, i: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("low")
            )),
            lambda h: h["start"] >= h["low"],
        )
        parts = F.transform(heads, lambda h: F.concat(
            _cut(pieces, h["low"], h["start"] - h["low"]), F.lit("["), F.upper(h["kind"]), F.lit("]")
        ))
        end = F.get(reach, F.size(reach) - 1)
        return F.concat(F.array_join(parts, ""), _cut(pieces, end, F.length(text) - end))

    whole = _let(ordered, lambda rows: _let(
        _running(F.transform(rows, lambda s: s["end"]), F.greatest), lambda reach: marked(rows, reach)
    ))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced; NULL texts and all other columns, whatever their names, stay as they are."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("row"), F.col("text").cast("string").alias("text"))
    found = with_spans(rows, "text", "spans")
    text = redacted(F.col("text"), F.col("spans_pieces"), F.col("spans"))
    return found.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
