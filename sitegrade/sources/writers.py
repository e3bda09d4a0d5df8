"""Sinks: append-only results and errors, score tables, region scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.operators.scoring import worst_observation
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import error_schema, observation_schema, scored_schema
from sitegrade.sources.batches import write_batch


def _append(df: DataFrame, path: str, keys: list[str], file_format: str, batch: str | None) -> None:
    if batch is not None:
        write_batch(df, path, batch, keys, file_format)
        return
    # "rebalance" groups the rows of a partition folder into few files, and splits a folder that
    # holds much of the data over several tasks.
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("append")
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.partitionBy(*keys).format(file_format).save(path)


def by_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The fixed column order and types, whatever the order of ``df``; absent columns are null."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f'`{f.name}`' if f.name in have else 'null'} as {f.dataType.simpleString()})"
            f" as `{f.name}`"
            for f in schema
        ]
    )


def append_results(
    results: DataFrame,
    path: str,
    policy: Policy = DEFAULT_POLICY,
    file_format: str = "parquet",
    batch: str | None = None,
) -> None:
    """Append observations per country and platform. An empty table adds no folder.

    With a ``batch`` name the append may be repeated: a batch written again replaces its own rows
    (see ``batches``). A path holds either plain appends or batches.
    """
    schema = observation_schema(policy.headers).add("country", "string")
    _append(by_schema(results, schema), path, ["country", "platform"], file_format, batch)


def append_errors(
    errors: DataFrame, path: str, file_format: str = "parquet", batch: str | None = None
) -> None:
    """Append error rows (source columns and the error text) per country; ``batch`` as above."""
    schema = error_schema().add("country", "string")
    _append(by_schema(errors, schema), path, ["country"], file_format, batch)


def write_scores(scored: DataFrame, path: str, policy: Policy = DEFAULT_POLICY) -> None:
    """Replace the table of all scored rows."""
    schema = scored_schema(policy.headers)
    by_schema(scored, schema).write.mode("overwrite").parquet(path)


def write_worst(scored: DataFrame, path: str, policy: Policy = DEFAULT_POLICY) -> None:
    """Replace the table of the worst row per institution."""
    schema = scored_schema(policy.headers)
    worst_observation(by_schema(scored, schema)).write.mode("overwrite").parquet(path)


def write_region_scores(scores: DataFrame, path: str) -> None:
    """One CSV folder per country with region name and mean score."""
    renamed = scores.select("country", F.col("nuts").alias("NUTS2_Label_2016"), "final_score")
    # A few hundred regions: one file per country.
    (
        renamed.repartition("country")
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy("country")
        .csv(path)
    )
