"""Which institutions to scan again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.operators.keyed import keep_matching
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID


def retry_worklist(
    source: DataFrame, results: DataFrame, errors: DataFrame, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Source rows of institutions whose scans all failed so far, and fewer than the allowed times.

    A pass over an institution ends with an error row or with a result for the last platform, so
    the number of error rows is the number of failed passes. Nothing is deleted or overwritten.
    """
    last = policy.platforms[-1]
    outcomes = errors.selectExpr(ID, "1L as failed", "false as done").unionByName(
        results.selectExpr(ID, "0L as failed", f"platform <=> '{last}' as done")
    )
    pending = (
        outcomes.filter(f"{ID} is not null")
        .groupBy(ID)
        .agg(F.sum("failed").alias("failures"), F.bool_or("done").alias("finished"))
        .filter(f"failures > 0 and failures < {policy.max_passes} and not finished")
    )
    return keep_matching(source, pending, [ID])
