"""Repair of result rows whose platform value was written too early in the line."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitegrade.policy import DEFAULT_POLICY, Policy

FIRST, LAST = 12, 19


def repair_shifted_rows(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Rotate positions 12..19 left by one where position 12 holds a platform name.

    Works on string columns by position; the column names stay.
    """
    names = ["`" + name.replace("`", "``") + "`" for name in df.columns]
    platforms = ", ".join(f"'{p}'" for p in policy.platforms)
    span = names[FIRST : LAST + 1]
    rotated = [*span[1:], span[0]]
    fixed = [
        f"if({span[0]} in ({platforms}), {new}, {old}) as {old}" for old, new in zip(span, rotated)
    ]
    return df.selectExpr(*names[:FIRST], *fixed, *names[LAST + 1 :])
