"""Scalar functions against plain-Python definitions."""

import hashlib
import random
import re
import unicodedata
from datetime import date, datetime

from pyspark.sql import functions as F

from harmonia.functions import keys, text, values


def column(spark, items, *columns):
    df = spark.createDataFrame([(i, item) for i, item in enumerate(items)], "i int, v string")
    return [tuple(row)[1:] for row in df.select("i", *columns).orderBy("i").collect()]


def py_fold(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def py_normalize(value):
    return re.sub("[^a-z0-9]+", "", py_fold(value).lower())


def py_upper(value):
    return re.sub("[^A-Za-z0-9]+", "_", py_fold(value)).strip("_").upper()


SAMPLES = [
    "", "Été à la plage", "œuvre ﬁnale ½", "Łódź İstanbul", "  a--b  ", "m²/kg²", "éa", "ＦＵＬＬ１", "①②",
    "Straße", "ｱ", "№ 5", "𝐀𝐁c", "🄀x", "a҈b", "Ⅻ", "__x__", "ĳ", "ǆ", "K", "x‍y", "Ω α ά",
]


def test_normalize_matches_unicode_definition(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000] + list("abcXYZ019 _-")
    pool += [chr(c) for c in range(0x1D400, 0x1D500)] + [chr(c) for c in range(0xFB00, 0xFB10)]
    items = SAMPLES + ["".join(rng.choice(pool) for _ in range(12)) for _ in range(600)]
    got = column(spark, items, text.normalize(F.col("v")), text.normalize_upper(F.col("v")))
    assert got == [(py_normalize(v), py_upper(v)) for v in items]
    assert [text.plain_normalize(v) for v in items] == [py_normalize(v) for v in items]
    assert [text.plain_normalize_upper(v) for v in items] == [py_upper(v) for v in items]


def test_normalize_key_keeps_accents(spark):
    assert column(spark, ["Clé_Adh", "ID 1"], text.normalize_key(F.col("v"))) == [("cléadh",), ("id1",)]


def test_hash_and_stable_ids(spark):
    got = column(
        spark, ["S001", "é"],
        keys.hash_id("T", F.col("v"), salt="pepper"),
        keys.hash_id("UT", F.lit("E10"), F.col("v"), salt="pepper", length=16),
        keys.stable_id(F.lit("f.csv"), F.col("v"), F.lit("e")),
    )
    want = [
        (
            "T_" + hashlib.sha256(f"pepper|{v}".encode()).hexdigest()[:10],
            "UT_" + hashlib.sha256(f"pepper|E10|{v}".encode()).hexdigest()[:16],
            hashlib.sha1(f"f.csv|{v}|e".encode()).hexdigest()[:12],
        )
        for v in ["S001", "é"]
    ]
    assert got == want


def test_tests_of_values(spark):
    items = ["1974", "2074", "1874", "2024-02-12", "1/2/2024", "31-12-2024", "32/01/2024", "1,5", "1e5", "nan",
             "inf", "1_000", "1d", "0x10", "12a", "8610Z", "123456", "", " 7 ", "2024-13-01", "-3.5", "."]

    def py_date(v):
        for form in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y"):
            try:
                datetime.strptime(v, form)
                return bool(v)
            except ValueError:
                continue
        return False

    def py_number(v):
        try:
            float(v.replace(",", "."))
            return True
        except ValueError:
            return False

    v = F.col("v")
    got = column(spark, items, values.is_year(v), values.is_date(v), values.is_number(v), values.is_code(v))
    assert got == [
        (bool(re.match("^(19|20)[0-9]{2}$", x)), py_date(x), py_number(x), bool(re.match("^[0-9]{2,4}[a-zA-Z]?$", x)))
        for x in items
    ]


def test_parse_date(spark):
    d = date(2024, 2, 12)
    cases = {
        "2024-02-12": d, " 2024-02-12 ": d, "2024-02-12T23:30:00Z": d, "2024-02-12T23:30:00+05:00": d,
        "2024-02-12 08:15:00.25": d, "20240212": d, "12/02/2024": d, "12-02-2024": d, "2024-2-12": d,
        "12-02/2024": None, "2024-02-12x": None, "": None, "2024-02-30": None, "soon": None,
    }
    got = column(spark, list(cases), values.parse_date(F.col("v")))
    assert got == [(x,) for x in cases.values()]


def test_transforms(spark):
    v = F.col("v")

    def one(build, items):
        return [row[0] for row in column(spark, items, build(v))]

    assert one(values.normalize_sex, ["F", "Femme", "h", "M", "homme", "x", ""]) == ["F", "F", "M", "M", "M", "INCONNU", ""]
    assert one(values.classify_size, ["8", "10,9", "11", "49.9", "50", "249", "250", "x", "", "nan"]) == [
        "TPE_1_10", "TPE_1_10", "PME_11_49", "PME_11_49", "ETI_50_249", "ETI_50_249", "GE_250_PLUS", "", "", ""]
    assert one(lambda c: values.age_class(c, 2026), ["2000", "1990", "1974", "1960", "74"]) == [
        "AGE_18_29", "AGE_30_44", "AGE_45_54", "AGE_55_PLUS", ""]
    assert one(values.normalize_visit_type, ["VR", "pré reprise", "préreprise", "visite de reprise", "VIP", "périodique", "à la demande"]) == [
        "REPRISE", "PRE_REPRISE", "PRE_REPRISE", "REPRISE", "VIP_PERIODIQUE", "VIP_PERIODIQUE", "A_LA_DEMANDE"]
    assert one(values.normalize_conclusion, ["orientation PDP", "apte avec restrictions", "inapte", "apte", "à voir"]) == [
        "ORIENTATION_PDP", "APTE_AVEC_RESTRICTION", "INAPTE", "APTE", "A_VOIR"]
    assert one(values.normalize_exposure, ["Poussières de bois", "Manutention", "gestes", "Charge mentale"]) == [
        "POUSSIERES_BOIS", "MANUTENTION_MANUELLE", "GESTES_REPETITIFS", "CHARGE_MENTALE"]
    assert one(values.exposure_category, ["chimique", "répétitif", "bruit", "x"]) == ["CHIMIQUE", "BIOMECANIQUE", "BRUIT", "AUTRE"]
    assert one(values.to_flag, ["", "non", "0", "Aucune", "Port de charges", "oui", None]) == [
        "false", "false", "false", "false", "true", "true", "false"]
    assert one(values.boolean_text, ["1", "Vrai", "faux", "0", "peut-être"]) == ["true", "true", "false", "false", "peutetre"]
    assert one(values.normalized_scalar, ["1", "Très haut", None]) == ["true", "TRES_HAUT", ""]
    assert [values.plain_scalar(x) for x in [True, "oui", 0, "Très haut"]] == ["true", "true", "false", "TRES_HAUT"]
    assert one(lambda c: values.apply_transform("unknown", c), ["a"]) == ["a"]


def test_value_mapping_status(spark):
    df = spark.createDataFrame(
        [("normalize_sex", "x", "INCONNU"), ("normalize_sex", "f", "F"), ("classify_size", "z", ""),
         ("normalize_visit_type", "q", "Q"), ("exposure_category", "q", "AUTRE"), ("to_flag", "q", "true"),
         ("to_flag", "", "false")], "t string, s string, r string")
    got = [r[0] for r in df.select(values.value_mapping_status(F.col("t"), F.col("s"), F.col("r"))).collect()]
    assert got == ["a_revoir", "auto", "a_revoir", "a_revoir", "a_revoir", "auto", "ignore_empty"]


def test_texts_in_ascii_fold_as_all_others_without_their_pattern(spark):
    """Every character of ASCII, alone, doubled and at either end; the fold pattern is left to other texts."""
    parts = [chr(c) for c in range(0x80)] + ["é", "ﬁ", "語", ""]
    given = [a + x + b for x in parts for a in ("", "a", "-", "Pre") for b in ("", "Z", "__", "-reprise", " vip")] + ["VR", "vr\n", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    found = df.select("t", text.normalize(F.col("t")), text.normalize_upper(F.col("t")), values.normalize_visit_type(F.col("t"))).collect()
    for value, lower, upper, visit in found:
        if value is None:
            assert (lower, upper, visit) == (None, None, None)
            continue
        n = text.plain_normalize(value)
        assert (lower, upper) == (n, text.plain_normalize_upper(value)), repr(value)
        kind = (
            "REPRISE" if n in ("vr", "visitereprise") else "PRE_REPRISE" if "pre" in n and "reprise" in n else "REPRISE" if "reprise" in n
            else "VIP_PERIODIQUE" if "period" in n or "vip" in n else upper
        )
        assert visit == kind, repr(value)
    plan = df.select(text.normalize(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "translate(lower(t" in plan
