"""Sinks (B1-B6).  Every writer targets a folder the caller names (on a
cluster: shared storage), partitions by the columns the reference puts in
its file names, and never funnels rows through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.sanitize import clean_catalog
from ..operators.guides import standards_wide
from ..session import claim, list_names, rename_path
from . import commits


def write_nutrient_guides(spark, path: str) -> None:
    """B1: one CSV per species with stage rows and nutrient columns."""
    standards_wide(spark).write.mode("overwrite").partitionBy("species").option("header", True).csv(path)


def write_formulas(formula_rows: DataFrame, path: str, run_date: str) -> None:
    """B2: formula rows partitioned by species and run date."""
    (formula_rows.withColumn("run_date", F.lit(run_date)).write.mode("append")
     .partitionBy("species", "run_date").option("header", True).csv(path))


#: What ends a report in a file of reports, and the line it begins with.
REPORT_END, REPORT_HEAD = "\f\n", "Report-ID: "


def write_reports(reports: DataFrame, path: str, key: str = "scenario_id") -> None:
    """Report texts as text files, one folder per file name (species and
    date).  Each report begins with a line that has its id and ends with a form
    feed, so that it can be told from the others of its file."""
    body = F.concat(F.lit(REPORT_HEAD), F.col(key).cast("string"), F.lit("\n"), F.col("report"))
    (reports.select("file_name", body.alias("value")).write.mode("overwrite").partitionBy("file_name")
     .option("lineSep", REPORT_END).text(path))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, report_id, report): the reports of :func:`write_reports`."""
    rows = spark.read.option("lineSep", REPORT_END).text(path)
    head = "substring_index(value, chr(10), 1)"
    return rows.selectExpr("file_name", f"cast(substring({head}, {len(REPORT_HEAD) + 1}) AS bigint) AS report_id",
                           f"substring(value, length({head}) + 2) AS report")


def save_catalog(edited: DataFrame, path: str) -> int:
    """B4 (replace form): sanitise and write the next version of the catalog
    (``version=<n>``, partitioned by species) without touching the versions
    before it; returns the number of rows, taken from what the write observed.
    The number is claimed first, so savers that run side by side make versions of
    their own; the greatest published one counts.  An empty result is refused
    (C17): its version is not published."""
    spark, folder = edited.sparkSession, path.rstrip("/")
    claimed = [int(n) for n in list_names(spark, f"{folder}/_claims")]
    version = max([last_version(spark, path), *claimed]) + 1
    while not claim(spark, f"{folder}/_claims/{version}"):
        version += 1
    seen = Observation()
    new = f"{folder}/_new/version={version}"
    (clean_catalog(edited).observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").partitionBy("species").parquet(new))
    if not seen.get["rows"]:
        raise ValueError("no valid rows to save after sanitisation")
    rename_path(spark, new, f"{folder}/version={version}")
    return seen.get["rows"]


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the latest published version, 0 if there is none."""
    names = [n for n in list_names(spark, path) if n.startswith("version=")]
    return max((int(n.split("=", 1)[1]) for n in names), default=0)


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The catalog as last saved (or one of its versions)."""
    v = last_version(spark, path) if version is None else version
    return spark.read.parquet(f"{path.rstrip('/')}/version={v}")


def export_catalog_csv(edited: DataFrame, path: str) -> None:
    """Sanitised catalog as CSV with a header."""
    clean_catalog(edited).write.mode("overwrite").partitionBy("species").option("header", True).csv(path)


def append_history(records: DataFrame, path: str, run: str) -> bool:
    """Append the formulation records of a batch run (batch form of K1).
    Only successes are recorded; a run that is done again adds nothing."""
    return commits.append(records.where(F.col("status") == "optimal"), path, run)
