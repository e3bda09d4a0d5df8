"""Readers: source lists, scan results, score tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.operators.repair import LAST, repair_shifted_rows
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import error_schema, observation_schema, scored_schema, source_schema
from sitegrade.sources.batches import has_batches, read_batches
from sitegrade.sources.csv_files import FILE_NAME, load_report, read_text_columns, typed

# Names of source lists and of result files.
SOURCE_FILE = r"^[a-zA-Z]{2}-.*\.csv$"
RESULT_FILE = r"^[a-zA-Z]{2}_.*\.csv$"

NO_URL = "no 'url' column"


def url_column(columns: Iterable[str]) -> str | None:
    """Name of the URL column in any letter case, None if there is none."""
    return next((name for name in columns if name.lower() == "url"), None)


def read_source_lists(
    spark: SparkSession, directory: str, multi_line: bool = True, strict: bool = True
) -> DataFrame:
    """Institutions of every ``<cc>-*.csv`` file; an ``error`` column from an earlier pass is dropped.

    ``country`` is the first two letters of the file name. Each file needs a URL column in any
    letter case; those without one are refused by name, or left out if not ``strict``. Damaged files
    are left out whole: ``source_report`` lists them.
    """
    refused: list[str] = []

    def prepare(rows: DataFrame, files: list[str]) -> DataFrame | None:
        name = url_column(rows.columns)
        if name is None:
            refused.extend(files)
            return None
        return rows.withColumnRenamed(name, "Url")

    text = read_text_columns(spark, directory, SOURCE_FILE, multi_line, prepare)
    if refused and strict:
        raise ValueError(f"{NO_URL} in {', '.join(refused)}")
    if text is None:
        country = T.StructField("country", T.StringType())
        return spark.createDataFrame([], T.StructType([*source_schema().fields, country]))
    rows = typed(text, source_schema(), (FILE_NAME,))
    return rows.withColumn("country", F.substring(FILE_NAME, 1, 2)).drop(FILE_NAME)


def source_report(spark: SparkSession, directory: str, multi_line: bool = True) -> DataFrame:
    """Every source list with its rows, damaged rows and the reason it is left out, if it is."""
    return load_report(
        spark, directory, SOURCE_FILE, multi_line, lambda layout: NO_URL if url_column(layout) is None else None
    )


def file_keys(file_name: str) -> tuple[str, str]:
    """SQL for ``country`` and ``platform`` from the name of a result file."""
    parts = f"split(replace({file_name}, '.csv', ''), '_')"
    return f"{parts}[0]", f"{parts}[1]"


def read_results(
    spark: SparkSession,
    directory: str,
    policy: Policy = DEFAULT_POLICY,
    multi_line: bool = True,
    repair: bool = False,
) -> DataFrame:
    """Observations of every ``<cc>_<platform>*.csv`` file.

    ``country`` and ``platform`` come from the file name and replace columns of that name. Files
    without a header line and damaged files are left out whole: ``result_report`` lists them.
    ``repair`` mends rows whose platform was written too early, by position in the file, before
    columns are matched by name.
    """
    schema = observation_schema(policy.headers)

    def prepare(rows: DataFrame, files: list[str]) -> DataFrame:
        # The file name stands last, so positions are those of the file.
        return repair_shifted_rows(rows, policy) if repair and len(rows.columns) > LAST + 1 else rows

    text = read_text_columns(spark, directory, RESULT_FILE, multi_line, prepare)
    if text is None:
        return spark.createDataFrame([], schema.add("country", T.StringType()))
    country, platform = file_keys(FILE_NAME)
    rows = typed(text, schema, (FILE_NAME,))
    keys = {"country": F.expr(country), "platform": F.expr(platform)}
    return rows.withColumns(keys).drop(FILE_NAME)


def result_report(spark: SparkSession, directory: str, multi_line: bool = True) -> DataFrame:
    """Every result file with its rows, damaged rows and the reason it is left out, if it is."""
    return load_report(spark, directory, RESULT_FILE, multi_line)


def read_observations(spark: SparkSession, path: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Observations written by ``writers.append_results``, as plain appends or in batches."""
    return _appended(spark, path, observation_schema(policy.headers).add("country", T.StringType()))


def read_scores(spark: SparkSession, path: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """A score table, all rows or worst rows, written by ``writers``."""
    return spark.read.schema(scored_schema(policy.headers)).parquet(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error rows written by ``writers.append_errors``, as plain appends or in batches."""
    return _appended(spark, path, error_schema().add("country", T.StringType()))


def _appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if has_batches(spark, path):
        return read_batches(spark, path, schema)
    return spark.read.schema(schema).parquet(path)
