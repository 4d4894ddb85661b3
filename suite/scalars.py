"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonia import fixed_values as fixed
from harmonia.functions import keys, text, values
from harmonia.operators.matching import map_values
from harmonia.operators.profiling import infer_entities, infer_sensitivity
from harmonia.session import parallel
from suite import query
from suite.sqltext import flag, norm, pseudonym, size_band, upper
from suite.views import read


@query(
    "normalize_text",
    f"""
SELECT doc_id, md5({norm('text')}) AS normalized_md5, md5({upper('text')}) AS upper_md5,
       length({norm('text')}) AS normalized_length
FROM documents
""",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("n"), text.normalize_upper(F.col("text")).alias("u")
    )
    return docs.select(
        "doc_id", F.md5("n").alias("normalized_md5"), F.md5("u").alias("upper_md5"),
        F.length("n").cast("bigint").alias("normalized_length"),
    )


@query(
    "normalize_names",
    f"""
SELECT p_partkey, {norm('p_name')} AS normalized, {upper('p_name')} AS upper_name,
       regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand_key
FROM part
""",
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.normalize(F.col("p_name")).alias("normalized"),
        text.normalize_upper(F.col("p_name")).alias("upper_name"),
        text.normalize_key(F.col("p_brand")).alias("brand_key"),
    )


@query(
    "pseudonymize_keys",
    f"""
SELECT c_custkey, {pseudonym('T', 'c_custkey')} AS worker_id,
       'V_' || substr(sha256('suite-salt|' || c_custkey || '|' || c_name || '|' || c_mktsegment), 1, 16) AS visit_id,
       substr(sha1(c_name || '|' || c_mktsegment || '|' || c_custkey), 1, 12) AS stable_id
FROM customer
""",
)
def pseudonymize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        keys.hash_id("T", key, salt="suite-salt").alias("worker_id"),
        keys.hash_id("V", key, F.col("c_name"), F.col("c_mktsegment"), salt="suite-salt", length=16).alias("visit_id"),
        keys.stable_id(F.col("c_name"), F.col("c_mktsegment"), key).alias("stable_id"),
    )


@query(
    "classify_size_bands",
    f"""
SELECT p_partkey, {size_band('p_size')} AS size_band, {size_band('p_retailprice')} AS price_band,
       CASE WHEN 2026 - (1950 + p_size) < 30 THEN 'AGE_18_29' WHEN 2026 - (1950 + p_size) < 45 THEN 'AGE_30_44'
            WHEN 2026 - (1950 + p_size) < 55 THEN 'AGE_45_54' ELSE 'AGE_55_PLUS' END AS age_class,
       2026 - (1950 + p_size) AS age,
       CASE WHEN p_type = 'PROMO' THEN 'F' WHEN p_type = 'SMALL' THEN 'M' WHEN p_type = 'LARGE' THEN '' ELSE 'INCONNU' END AS sex
FROM part
""",
)
def classify_size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.lit(1950) + F.col("p_size")).cast("string")
    civil = (
        F.when(F.col("p_type") == "PROMO", "Femme").when(F.col("p_type") == "SMALL", "h")
        .when(F.col("p_type") == "LARGE", "").otherwise(F.col("p_type"))
    )
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        values.classify_size(F.col("p_size").cast("string")).alias("size_band"),
        values.classify_size(F.translate(F.col("p_retailprice").cast("string"), ".", ",")).alias("price_band"),
        values.age_class(year, 2026).alias("age_class"),
        values.age_at(year, 2026).alias("age"),
        values.normalize_sex(civil).alias("sex"),
    )


# Free text made of the table's own words, so that every branch of the concept rules is taken.
SPARK_PHRASE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN concat('Visite de pré-reprise ', o_orderstatus) "
    "WHEN '2-HIGH' THEN concat('VIP ', o_orderstatus) WHEN '3-MEDIUM' THEN concat('apte, restriction n°', o_orderstatus) "
    "WHEN '4-NOT SPECIFIED' THEN concat('Poussières de bois / ', o_orderstatus) ELSE concat('bruit & gestes: ', o_orderstatus) END"
)
DUCK_PHRASE = SPARK_PHRASE


@query(
    "concept_mapping_ordered",
    f"""
WITH p AS (SELECT o_orderkey, {DUCK_PHRASE} AS phrase, o_orderpriority, o_orderstatus FROM orders),
n AS (SELECT *, {norm('phrase')} AS n, {upper('phrase')} AS u FROM p)
SELECT o_orderkey,
  CASE WHEN n IN ('vr', 'visitereprise') THEN 'REPRISE' WHEN contains(n, 'pre') AND contains(n, 'reprise') THEN 'PRE_REPRISE'
       WHEN contains(n, 'reprise') THEN 'REPRISE' WHEN contains(n, 'period') OR contains(n, 'vip') THEN 'VIP_PERIODIQUE' ELSE u END AS visit_type,
  CASE WHEN contains(n, 'pdp') THEN 'ORIENTATION_PDP' WHEN contains(n, 'restriction') THEN 'APTE_AVEC_RESTRICTION'
       WHEN contains(n, 'inapte') THEN 'INAPTE' WHEN contains(n, 'apte') THEN 'APTE' ELSE u END AS conclusion,
  CASE WHEN contains(n, 'bois') OR contains(n, 'chim') OR contains(n, 'poussiere') THEN 'POUSSIERES_BOIS'
       WHEN contains(n, 'manutention') THEN 'MANUTENTION_MANUELLE'
       WHEN contains(n, 'repetitif') OR contains(n, 'gestes') THEN 'GESTES_REPETITIFS' ELSE u END AS exposure,
  CASE WHEN contains(n, 'bois') OR contains(n, 'chim') OR contains(n, 'poussiere') THEN 'CHIMIQUE'
       WHEN contains(n, 'manutention') OR contains(n, 'repetitif') OR contains(n, 'gestes') THEN 'BIOMECANIQUE'
       WHEN contains(n, 'bruit') THEN 'BRUIT' ELSE 'AUTRE' END AS category,
  CASE WHEN {flag("CASE WHEN o_orderstatus = 'O' THEN 'Aucune' WHEN o_orderstatus = 'F' THEN '' ELSE phrase END")} THEN 'true' ELSE 'false' END AS flag,
  CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'false' ELSE 'p' END AS boolean_text,
  CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'false' ELSE 'P' END AS scalar
FROM n
""",
)
def concept_mapping_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase, status = F.col("phrase"), F.col("o_orderstatus")
    mark = F.when(status == "O", "Aucune").when(status == "F", "").otherwise(phrase)
    yes_no = F.when(status == "O", "Vrai").when(status == "F", "non").otherwise("P ")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.expr(SPARK_PHRASE).alias("phrase")).select(
        "o_orderkey",
        values.apply_transform("normalize_visit_type", phrase).alias("visit_type"),
        values.apply_transform("normalize_conclusion", phrase).alias("conclusion"),
        values.apply_transform("normalize_exposure", phrase).alias("exposure"),
        values.apply_transform("exposure_category", phrase).alias("category"),
        values.apply_transform("to_flag", mark).alias("flag"),
        values.boolean_text(yes_no).alias("boolean_text"),
        values.normalized_scalar(yes_no).alias("scalar"),
    )


@query(
    "value_mapping_status",
    f"""
WITH p AS (SELECT {DUCK_PHRASE} AS source_value, o_orderstatus AS s FROM orders),
t AS (SELECT CASE s WHEN 'O' THEN 'normalize_visit_type' WHEN 'F' THEN 'normalize_exposure' ELSE 'to_flag' END AS transform,
             source_value, count(*) AS count FROM p GROUP BY 1, 2),
m AS (SELECT *, {norm('source_value')} AS n, {upper('source_value')} AS u FROM t),
v AS (SELECT transform, source_value, count,
  CASE transform
    WHEN 'to_flag' THEN 'true'
    WHEN 'normalize_exposure' THEN CASE WHEN contains(n, 'bois') OR contains(n, 'chim') OR contains(n, 'poussiere') THEN 'POUSSIERES_BOIS'
       WHEN contains(n, 'manutention') THEN 'MANUTENTION_MANUELLE'
       WHEN contains(n, 'repetitif') OR contains(n, 'gestes') THEN 'GESTES_REPETITIFS' ELSE u END
    ELSE CASE WHEN contains(n, 'pre') AND contains(n, 'reprise') THEN 'PRE_REPRISE' WHEN contains(n, 'reprise') THEN 'REPRISE'
       WHEN contains(n, 'period') OR contains(n, 'vip') THEN 'VIP_PERIODIQUE' ELSE u END END AS target_value FROM m),
s AS (SELECT *, CASE
    WHEN transform = 'normalize_visit_type' AND target_value NOT IN ('REPRISE', 'PRE_REPRISE', 'VIP_PERIODIQUE') THEN 'a_revoir'
    WHEN transform = 'normalize_exposure' AND target_value NOT IN ('POUSSIERES_BOIS', 'MANUTENTION_MANUELLE', 'GESTES_REPETITIFS')
      THEN 'a_revoir' ELSE 'auto' END AS status FROM v)
SELECT transform, source_value, target_value, count, status,
       CASE WHEN bool_or(status = 'a_revoir') OVER (PARTITION BY transform) THEN 'a_revoir' ELSE 'auto_draft' END AS group_status
FROM s
""",
)
def value_mapping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    counted = (
        read(spark, sf_dir, "orders")
        .select(
            F.when(status == "O", "normalize_visit_type").when(status == "F", "normalize_exposure").otherwise("to_flag").alias("transform"),
            F.expr(SPARK_PHRASE).alias("source_value"),
        )
        .groupBy("transform", "source_value")
        .agg(F.count("*").alias("count"))
    )
    items = map_values(counted)
    groups = items.groupBy("transform").agg(
        F.when(F.bool_or(F.col("status") == "a_revoir"), "a_revoir").otherwise("auto_draft").alias("group_status")
    )
    return items.join(groups, "transform").select("transform", "source_value", "target_value", "count", "status", "group_status")


@query(
    "parse_mixed_dates",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS event_date,
       o_orderkey % 6 IN (0, 1, 2) AS is_date
FROM orders
""",
)
def parse_mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, form = F.col("o_orderdate"), F.col("o_orderkey") % 6
    written = (
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(form == 2, F.date_format(day, "d-M-yyyy"))
        .when(form == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59+05:00")))
        .when(form == 4, F.date_format(day, "yyyyMMdd"))
        .otherwise(F.date_format(day, "MMM yyyy"))
    )
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", values.parse_date(written).alias("event_date"), values.is_date(written).alias("is_date")
    )


@query(
    "value_tests",
    r"""
SELECT event_id, regexp_matches(k, '^(19|20)[0-9]{2}$') AS is_year, TRY_CAST(k AS DOUBLE) IS NOT NULL AS is_number,
       regexp_matches(k, '^[0-9]{2,4}[a-zA-Z]?$') AS is_code, false AS is_date
FROM (SELECT event_id, CASE event_type
        WHEN 'view' THEN CAST(1890 + event_id % 300 AS VARCHAR) WHEN 'click' THEN CAST(value AS VARCHAR)
        WHEN 'error' THEN CAST(user_id AS VARCHAR) || 'z' WHEN 'signup' THEN props ELSE event_type END AS k FROM events)
""",
)
def value_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    made = (
        F.when(kind == "view", (F.lit(1890) + F.col("event_id") % 300).cast("string"))
        .when(kind == "click", F.translate(F.col("value").cast("string"), ".", ","))
        .when(kind == "error", F.concat(F.col("user_id").cast("string"), F.lit("z")))
        .when(kind == "signup", F.col("props"))
        .otherwise(kind)
    )
    return read(spark, sf_dir, "events").select("event_id", made.alias("k")).select(
        "event_id", values.is_year(F.col("k")).alias("is_year"), values.is_number(F.col("k")).alias("is_number"),
        values.is_code(F.col("k")).alias("is_code"), values.is_date(F.col("k")).alias("is_date"),
    )


@query(
    "suggestion_labels",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_quantity / 50 >= 0.65 THEN 'strong_candidate' WHEN l_quantity / 50 >= 0.35 THEN 'review_candidate'
            ELSE 'low_confidence' END AS suggestion,
       CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'rejected' ELSE 'needs_review' END AS label
FROM lineitem
""",
)
def suggestion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "auto").when(F.col("l_returnflag") == "R", "rejected").otherwise("a_revoir")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        values.suggestion_status(F.col("l_quantity") / 50).alias("suggestion"),
        values.value_mapping_label(status).alias("label"),
    )


@query(
    "boolean_like_values",
    """
SELECT user_id, bool_and(event_type IN ('view', 'click')) AS all_boolean
FROM events GROUP BY user_id
""",
)
def boolean_like_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("event_type") == "view", "Oui").when(F.col("event_type") == "click", "NON").otherwise(F.col("event_type"))
    distinct = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(word).alias("words"))
    return distinct.select("user_id", values.values_are_boolean_like(F.col("words")).alias("all_boolean"))


_S4 = "nom|prenom|mail|email|telephone|tel|adresse|nir|ins|siret|siren|raisonsociale|commentairemedical|commentaire|adherent|nomusuel|courrier|pdf|note|cr"
_S2C = "idsal|idtravailleur|idsalarie|matricule|clepers|anneen|civilitesexe|libemploi|utlib"
_S3 = "visite|avis|conclusion|restriction|amenagement|adaptation|reserve|decision|nature|raison|inaptitude|nuisance|risque|exposition|motif|pdp|sante|niveau|classe|origine"
_S2 = "sal|salarie|travailleur|poste|service|ut|suivi|sexe|naiss"


@query(
    "sensitivity_scan",
    f"""
WITH t AS (SELECT doc_id, {norm('text')} AS n, {norm("source || '.csv ' || text")} AS c FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(n, '{_S4}') THEN 'S4' WHEN regexp_matches(n, '{_S2C}') THEN 'S2'
                    WHEN regexp_matches(c, '{_S3}') THEN 'S3' WHEN regexp_matches(c, '{_S2}') THEN 'S2' ELSE 'S1' END AS sensitivity
FROM t
""",
)
def sensitivity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        "doc_id", infer_sensitivity(F.col("text"), F.concat("source", F.lit(".csv"))).alias("sensitivity")
    )


def entity_sql(file: str, names: str) -> str:
    """Entities of a file name and its column names, from the fixed words."""
    hints = dict(fixed.FILE_HINTS)
    scored = []
    for entity in fixed.ENTITIES:
        points = [f"CASE WHEN contains({file}, '{text.plain_normalize(h)}') THEN {fixed.HINT_POINTS} ELSE 0 END" for h in hints[entity]]
        points += [
            f"CASE WHEN regexp_matches({names}, '{'|'.join(map(text.plain_normalize, f.aliases))}') THEN {fixed.ALIAS_POINTS} ELSE 0 END"
            for f in fixed.TARGET_FIELDS
            if f.entity == entity
        ]
        scored.append(f"{{'minus': -({' + '.join(points)}), 'entity': '{entity}'}}")
    ranked = (
        f"array_to_string(list_transform(list_filter(list_sort([{', '.join(scored)}]), lambda x: x.minus <= -{fixed.ENTITY_MIN_POINTS}), "
        "lambda x: x.entity), ',')"
    )
    shortcuts = " ".join(f"WHEN contains({file}, '{word}') THEN '{','.join(entities)}'" for word, entities in fixed.FILE_SHORTCUTS)
    return f"CASE {shortcuts} ELSE {ranked} END"


@query(
    "entity_inference",
    f"""
WITH named AS (SELECT p_partkey, {norm("p_brand || CASE p_size % 3 WHEN 0 THEN ' poste.csv' WHEN 1 THEN ' salaries.csv' ELSE '.csv' END")} AS file,
       {norm('p_name')} || ' ' || {norm('p_type')} || ' visite clepers site' AS names FROM part)
SELECT p_partkey, {entity_sql('file', 'names')} AS entities FROM named
""",
)
def entity_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By word of the file name where one holds, else by points of hints and aliases."""
    names = F.concat_ws(" ", text.normalize(F.col("p_name")), text.normalize(F.col("p_type")), F.lit("visite clepers site"))
    form = F.col("p_size") % 3
    file = F.concat("p_brand", F.when(form == 0, " poste.csv").when(form == 1, " salaries.csv").otherwise(".csv"))
    parts = parallel(read(spark, sf_dir, "part"))
    return parts.select("p_partkey", F.concat_ws(",", infer_entities(file, names)).alias("entities"))
