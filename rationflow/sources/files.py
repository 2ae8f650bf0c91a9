"""File sources (A1-A3, A6, A7): declared schemas, no inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_table, write_table

CATALOG_CSV_SCHEMA = T.StructType([
    T.StructField("Ingredient", T.StringType()),
    T.StructField("CP", T.DoubleType()),
    T.StructField("Energy", T.DoubleType()),
    T.StructField("Fiber", T.DoubleType()),
    T.StructField("Cost", T.DoubleType()),
])

TRIALS_CSV_SCHEMA = T.StructType([
    T.StructField("Animal_Type", T.StringType()),
    T.StructField("Breed", T.StringType()),
    T.StructField("Age_Weeks", T.IntegerType()),
    T.StructField("Body_Weight_kg", T.DoubleType()),
    T.StructField("CP_Requirement_%", T.DoubleType()),
    T.StructField("Energy_Requirement_Kcal", T.DoubleType()),
    T.StructField("Feed_Intake_kg", T.DoubleType()),
    T.StructField("Ingredient_CP_%", T.DoubleType()),
    T.StructField("Ingredient_Energy", T.DoubleType()),
    T.StructField("Expected_Daily_Gain_g", T.DoubleType()),
])

TRIAL_RENAMES = {
    "Animal_Type": "animal_type", "Breed": "breed", "Age_Weeks": "age_weeks", "Body_Weight_kg": "body_weight_kg",
    "CP_Requirement_%": "cp_requirement_pct", "Energy_Requirement_Kcal": "energy_requirement_kcal",
    "Feed_Intake_kg": "feed_intake_kg", "Ingredient_CP_%": "ingredient_cp_pct",
    "Ingredient_Energy": "ingredient_energy", "Expected_Daily_Gain_g": "expected_daily_gain_g",
}


def with_file_position(df: DataFrame) -> DataFrame:
    """Adds ``pos``, the row's number inside its file.  Rows are numbered
    inside each block of a file as it was split for reading; the offset of a
    block is the number of rows in the blocks before it (one row a block), so
    no file is gathered in one task."""
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_seq"))
    df = write_table(df, "file_rows")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_file", "_block").orderBy("_seq")
    out = df.join(blocks, ["_file", "_block"]).withColumn("pos", (F.col("_off") + F.row_number().over(inside)).cast("bigint"))
    return out.drop("_file", "_block", "_seq", "_off")


def read_catalog_csv(spark: SparkSession, path: str, species: str, with_fiber: bool = True) -> DataFrame:
    """A1: one species' catalog file -> (species, pos, ingredient, cp,
    energy, fiber, cost); ``pos`` is the file order (first-wins key)."""
    fields = [f for f in CATALOG_CSV_SCHEMA.fields if with_fiber or f.name != "Fiber"]
    df = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return with_file_position(df).select(
        F.lit(species).alias("species"), "pos", F.col("Ingredient").alias("ingredient"), F.col("CP").alias("cp"),
        F.col("Energy").alias("energy"), (F.col("Fiber") if with_fiber else F.lit(None).cast("double")).alias("fiber"),
        F.col("Cost").alias("cost"))


def read_catalogs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """A1 + H4: every species file stacked by name with a ``species`` column."""
    frames = [read_catalog_csv(spark, p, sp) for sp, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_trials_csv(spark: SparkSession, path: str) -> DataFrame:
    """A2: growth-trial table with snake-case column names."""
    df = spark.read.schema(TRIALS_CSV_SCHEMA).option("header", True).csv(path)
    return df.withColumnsRenamed(TRIAL_RENAMES)


def quarantine_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                   table_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: PERMISSIVE parse with a corrupt-record column, written once as a
    parquet table under the shared checkpoint folder; (good, rejected) are
    read from that table.  Rejected rows keep the raw line.  (Spark refuses
    raw-CSV plans that need only the corrupt column, and caching a whole
    ingest does not scale; a written table does both jobs.)"""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = (spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    table_path = table_path or new_table(spark, "ingest")
    parsed.write.mode("overwrite").parquet(table_path)
    t = spark.read.parquet(table_path)
    good = t.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = t.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def for_species(catalog: DataFrame, species: str) -> DataFrame:
    """Route to one species' catalog (partition pruning when the catalog
    table is partitioned by ``species``)."""
    return catalog.where(F.col("species") == species)
