"""Presence and strength of every header, and the split into results and errors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.operators.keyed import attach
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID, config_col, presence_col

MISSING, STRONG, WEAK = "Missing", "Strong", "Weak"


def assess_values(
    df: DataFrame, values: Mapping[str, str], policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Add ``<h>_presence`` and ``<h>_config`` from one value expression per header.

    A null or literal ``Missing`` value is absent. ``header_error`` names the first header whose
    value cannot be assessed.
    """
    own = [f"`{c}`" for c in df.columns]
    names = {h: {"v": f"_value_{i}"} for i, h in enumerate(policy.headers)}
    prepared = df.selectExpr(
        *own,
        *[f"lower(nullif({values[h]}, '{MISSING}')) as {names[h]['v']}" for h in policy.headers],
    )
    helpers = []
    for header, expressions in policy.helpers.items():
        for name, sql in expressions.items():
            helper = f"{names[header]['v']}_{name}"
            helpers.append(f"{sql.format(v=names[header]['v'])} as {helper}")
            names[header][name] = helper
    if helpers:
        # The generator is a barrier: filters on later columns (``header_error``) are not pushed
        # below it, so a helper's text stands once in the plan and is evaluated once per row.
        prepared = prepared.selectExpr("*", f"inline(array(struct({', '.join(helpers)})))")
    columns = []
    for header in policy.headers:
        value = names[header]["v"]
        strong = policy.rules[header].format(**names[header])
        columns.append(f"{value} is not null as `{presence_col(header)}`")
        columns.append(
            f"case when {value} is null then '{MISSING}' when {strong} then '{STRONG}'"
            f" else '{WEAK}' end as `{config_col(header)}`"
        )
    problems = [
        f"if({test.format(**names[header])}, 'unreadable value of {header}', null)"
        for header, test in policy.unreadable.items()
    ]
    error = f"coalesce({', '.join([*problems, 'cast(null as string)'])}) as header_error"
    return prepared.selectExpr(*own, *columns, error)


def assess_headers(
    df: DataFrame, headers: str = "headers", policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Same from a name-to-value map: names in any case, the last of equal names wins."""
    listed = df.selectExpr(
        "*",
        f"reverse(transform(map_keys({headers}), name -> lower(name))) as _names",
        f"reverse(map_values({headers})) as _values",
    )
    by_header = {
        h: f"get(_values, cast(array_position(_names, '{h}') - 1 as int))" for h in policy.headers
    }
    assessed = assess_values(listed, by_header, policy)
    return assessed.selectExpr("*", f"to_json({headers}) as raw_headers").drop("_names", "_values")


def split_errors(
    df: DataFrame, error: str, policy: Policy = DEFAULT_POLICY, keys: tuple[str, ...] = (ID,)
) -> tuple[DataFrame, DataFrame]:
    """(results, errors). An institution's first failing platform is its error row.

    Platforms are scanned in policy order, others after them by name: those before the first
    failure are results, those after it were never scanned. Rows without a key stand for themselves.
    """
    marked = mark_outcome(df, error, policy, keys)
    results = marked.filter("outcome = 'result'").drop("outcome", "error")
    return results, marked.filter("outcome = 'error'").drop("outcome")


def mark_outcome(
    df: DataFrame, error: str, policy: Policy = DEFAULT_POLICY, keys: tuple[str, ...] = (ID,)
) -> DataFrame:
    """Add ``error`` and ``outcome``: ``result``, ``error``, or null for rows never scanned."""
    platforms = ", ".join(f"'{p}'" for p in policy.platforms)
    known_place = f"nullif(array_position(array({platforms}), platform), 0L)"
    # Platforms of the policy in its order, then others by name, rows without one last.
    order = f"struct({known_place} is null as other, {known_place} as place, platform is null as none, platform)"
    ranked = df.withColumns({"error": F.expr(error), "_order": F.expr(order)})
    known = " and ".join(f"`{key}` is not null" for key in keys)
    first = (
        ranked.filter(f"error is not null and {known}")
        .groupBy(*keys)
        .agg(F.min("_order").alias("_first"))
    )
    outcome = """case when error is null and (_first is null or _order < _first) then 'result'
                      when error is not null and (_first is null or _order = _first) then 'error'
                 end"""
    marked = attach(ranked, first, list(keys))
    return marked.withColumn("outcome", F.expr(outcome)).drop("_order", "_first")
