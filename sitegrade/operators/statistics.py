"""Adoption, inconsistency, HTTP-version and region statistics, all from the summary table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.functions.labels import HTTP_VERSIONS
from sitegrade.functions.numeric import percent, ratio_percent, round2
from sitegrade.operators.summary import LEVELS, roll_up
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID, INCONSISTENCY_COLUMNS, NUTS


def adoption_stats(summary: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Header adoption at six grouping levels: counts and percentages per header."""
    counts = [f"{h}_{part}" for part in ("present", "strong", "weak") for h in policy.headers]
    stats = roll_up(summary, tuple(LEVELS), ["total_schools", *counts])
    shares = []
    for h in policy.headers:
        present = f"`{h}_present`"
        for part, whole in (("present", "total_schools"), ("strong", present), ("weak", present)):
            shares.append(f"{percent(f'`{h}_{part}`', whole)} as `{h}_{part}_percent`")
    return stats.selectExpr("*", *shares)


def _totals(summary: DataFrame, keys: list[str], counts: list[str], over: dict[str, list[str]]):
    """Counts per ``keys`` with the totals of wider groupings beside them, in one pass.

    The windows run over the grouped table, whose size depends on geography only.
    """
    grouped = summary.groupBy(*keys).agg(
        *[F.expr(f"sum(`{name}`)").alias(name) for name in counts]
    )
    return grouped.selectExpr(
        "*",
        *[
            f"sum(`{name}`) over (partition by {', '.join(group)}) as `{name}_{level}`"
            for level, group in over.items()
            for name in counts
        ],
    )


def inconsistency_stats(summary: DataFrame) -> DataFrame:
    """One row per region and category, with the region's and the country's numbers beside it.

    A region without any known category keeps one row with an empty category.
    """
    counts = ["total_schools", *[f"{flag}_schools" for flag in INCONSISTENCY_COLUMNS]]
    levels = {"nuts": ["country", "nuts"], "country": ["country"]}
    lines = _totals(summary, ["country", "nuts", "Category"], counts, levels)
    lines = lines.selectExpr(
        "*", "count(Category) over (partition by country, nuts) as _categories"
    ).filter("country is not null and nuts is not null and (Category is not null or _categories = 0)")
    lines = lines.selectExpr(
        "country",
        "nuts",
        "Category",
        *[f"{name}_{level}" for level in levels for name in counts],
        *[f"if(Category is null, null, {name}) as {name}_nuts_category" for name in counts],
    )
    shares = []
    for flag in INCONSISTENCY_COLUMNS:
        for level in (*levels, "nuts_category"):
            share = ratio_percent(f"{flag}_schools_{level}", f"total_schools_{level}")
            shares.append(f"{round2(share)} as {flag}_percent_{level}")
    return lines.selectExpr("*", *shares)


def http_version_stats(summary: DataFrame) -> DataFrame:
    """Version counts and unrounded percentages per region, with the country's beside them.

    Protocols outside the four versions are not part of the totals.
    """
    counts = [*HTTP_VERSIONS, "protocol_rows"]
    lines = _totals(summary, ["country", "nuts"], counts, {"country": ["country"]})
    lines = lines.filter("country is not null and nuts is not null and protocol_rows > 0")
    lines = lines.withColumnsRenamed({v: f"{v}_nuts" for v in HTTP_VERSIONS})

    def numbers(level: str) -> list[str]:
        versions = [f"`{v}_{level}`" for v in HTTP_VERSIONS]
        total = f"({' + '.join(versions)})"
        shares = [
            f"{ratio_percent(count, total)} as `{v}_percent_{level}`"
            for v, count in zip(HTTP_VERSIONS, versions)
        ]
        return [*versions, f"{total} as total_schools_{level}", *shares]

    return lines.selectExpr("country", "nuts", *numbers("nuts"), *numbers("country"))


def region_scores(summary: DataFrame) -> DataFrame:
    """Mean final score per region, unrounded. The sum is exact, so the order of rows is free."""
    sums = roll_up(summary, ("nuts",), ["score_hundredths", "score_rows"])
    return sums.filter("score_rows > 0").selectExpr(
        "country", "nuts", "cast(score_hundredths as double) / 100 / score_rows as final_score"
    )


def country_overview(rows: DataFrame) -> DataFrame:
    """Rows, institutions, regions and platforms per country.

    Each count comes from its own distinct pairs: institutions from one aggregation by institution,
    regions and platforms from the few combinations of them. Distinct counts side by side in one
    aggregation would copy every row once per count.
    """
    institutions = rows.groupBy("country", ID).agg(F.count("*").alias("n"))
    places = rows.groupBy("country", NUTS, "platform").agg(F.count("*").alias("n"))
    counted = {
        "institutions": institutions.select("country", ID),
        "regions": places.select("country", NUTS).distinct(),
        "platforms": places.select("country", "platform").distinct(),
    }
    zero = {name: F.lit(0) for name in ("observations", *counted)}
    parts = [institutions.select("country", *[c.alias(n) for n, c in (zero | {"observations": F.col("n")}).items()])]
    for name, pairs in counted.items():
        one = F.when(F.col(pairs.columns[1]).isNotNull(), 1).otherwise(0)
        parts.append(pairs.select("country", *[c.alias(n) for n, c in (zero | {name: one}).items()]))
    return reduce(DataFrame.unionByName, parts).groupBy("country").agg(*[F.sum(n).alias(n) for n in zero])
