"""Policies from files: a CSV of rules that names predicate and PET files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = "app string, section string, predicate_file string, pet_file string, priority int"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule CSV (header: app, section, predicate file, PET file, priority)."""
    return spark.read.option("header", True).schema(COLUMNS).csv(path)


def read_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder as ``name, text``."""
    return (spark.read.text(folder, wholetext=True)
            .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")))


def resolve_rules(rules: DataFrame, predicates: DataFrame, pets: DataFrame) -> DataFrame:
    """Replace file names by the files' text and number the rules of each (app, section).

    All rows of an application belong to one policy, wherever they stand in the file.
    """
    named = (rules
             .join(predicates.select(F.col("name").alias("predicate_file"),
                                     F.col("text").alias("predicate")), "predicate_file", "left")
             .join(pets.select(F.col("name").alias("pet_file"), F.col("text").alias("pet")),
                   "pet_file", "left"))
    order = Window.partitionBy("app", "section").orderBy("priority", "predicate_file", "pet_file")
    return named.withColumn("rule_no", F.row_number().over(order))


def missing_files(resolved: DataFrame) -> DataFrame:
    """Distinct names of files that the rules refer to but that do not exist."""
    return (resolved.where(F.col("predicate").isNull()).select(F.col("predicate_file").alias("name"))
            .union(resolved.where(F.col("pet").isNull()).select(F.col("pet_file").alias("name")))
            .distinct())


def load_policy(spark: SparkSession, path: str, predicate_dir: str, pet_dir: str) -> DataFrame:
    """The policy table; names of missing files are reported as an error."""
    resolved = resolve_rules(read_rules(spark, path), read_descriptions(spark, predicate_dir),
                             read_descriptions(spark, pet_dir))
    missing = [row.name for row in missing_files(resolved).orderBy("name").collect()]
    if missing:
        raise FileNotFoundError(f"no such predicate or PET file: {', '.join(missing)}")
    return resolved.select("app", "section", "rule_no", "priority", "predicate", "pet")
