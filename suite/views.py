"""The given tables read as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standard_tables(spark: SparkSession, sf_dir: str, needed: list[str]) -> dict[str, DataFrame]:
    """Customers as workers, nations as sites, orders as visits, line items as conclusions."""
    return {name: STANDARD_VIEWS[name](spark, sf_dir) for name in needed}


def _workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("travailleur_id"),
        (F.lit(1950) + F.col("c_nationkey") * 2).cast("string").alias("annee_naissance"),
        F.when(F.col("c_acctbal") < 0, "F").otherwise("M").alias("sexe"),
        F.col("c_mktsegment").alias("suivi_type_concept_id"),
    )


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("etablissement_id"), F.col("r_name").alias("region")
    )


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("travailleur_id"),
        F.col("c_nationkey").cast("string").alias("etablissement_id"),
    )


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("visite_id"),
        F.col("o_custkey").cast("string").alias("travailleur_id"),
        F.col("o_orderdate").alias("date_visite"),
        F.col("o_orderpriority").alias("type_visite_concept_id"),
    )


def _conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("visite_id"),
        F.col("l_returnflag").alias("conclusion_concept_id"),
        (F.col("l_linestatus") == "F").alias("restriction_flag"),
        F.when(F.col("l_discount") > 0.05, "oui").otherwise("non").alias("amenagement_flag"),
    )


def _exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("travailleur_id"),
        F.col("event_type").alias("exposition_concept_id"),
        F.col("value").alias("niveau_classe"),
        F.col("ts").alias("date_debut"),
    )


STANDARD_VIEWS = {
    "travailleur": _workers,
    "etablissement": _sites,
    "episode_poste": _jobs,
    "visite_sante_travail": _visits,
    "conclusion_medicale": _conclusions,
    "exposition_professionnelle": _exposures,
}
