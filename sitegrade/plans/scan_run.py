"""One pass over a scan batch: logs in, results and errors out, and what to scan again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrade.operators.assess import assess_headers, split_errors
from sitegrade.operators.retry import retry_worklist
from sitegrade.operators.scanlog import NO_HTTP_LOAD, combine_attempts, fold_scan_log, join_source
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID
from sitegrade.sources.readers import read_errors, read_observations
from sitegrade.sources.writers import append_errors, append_results


def assess_scans(logs: DataFrame, source: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Every scan of the batch with its source row, labels and errors. Reads the logs once."""
    scans = join_source(combine_attempts(fold_scan_log(logs)), source, policy)
    return assess_headers(scans, policy=policy)


def never_loaded(assessed: DataFrame, source: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Error rows of the institutions of which the logs hold nothing: their first platform failed."""
    seen = assessed.select(ID).distinct()
    return source.join(seen, ID, "left_anti").filter(f"{ID} is not null").select(
        *[f"`{c}`" for c in source.columns if c not in ("platform", "error")],
        F.lit(policy.platforms[0]).alias("platform"),
        F.lit(NO_HTTP_LOAD).alias("error"),
    )


def run_scans(
    spark: SparkSession,
    logs: DataFrame,
    source: DataFrame,
    out: str,
    batch: str,
    policy: Policy = DEFAULT_POLICY,
) -> DataFrame:
    """Write results and errors of one batch below ``out`` and return the worklist of the next pass.

    ``source`` is the list that was scanned: the source lists at first, then the worklist of the
    pass before. The assessed scans are written once and read by both sinks, so the logs are read and
    parsed once and a lost executor repeats at most one step. Running a batch again replaces
    what it wrote. The worklist names the institutions of ``source`` that failed in every pass so far,
    fewer than the allowed times.
    """
    cut = f"{out}/assessed/batch={batch}"
    assessed = assess_scans(logs, source, policy)
    assessed.write.mode("overwrite").parquet(cut)
    stored = spark.read.schema(assessed.schema).parquet(cut)
    results, errors = split_errors(stored, "coalesce(error, header_error)", policy)
    errors = errors.unionByName(never_loaded(stored, source, policy), allowMissingColumns=True)
    append_results(results, f"{out}/results", policy, batch=batch)
    append_errors(errors, f"{out}/errors", batch=batch)
    return retry_worklist(
        source, read_observations(spark, f"{out}/results", policy), read_errors(spark, f"{out}/errors"), policy
    )
