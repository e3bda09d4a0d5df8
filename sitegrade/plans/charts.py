"""Data behind the charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from sitegrade.functions.labels import (
    HTTP_VERSIONS,
    country_name,
    metric_label,
    short_name,
    whole_cell,
)
from sitegrade.functions.numeric import hundredths, literal
from sitegrade.plans.tables import (
    CATEGORIES,
    NO_REGION,
    TABLE,
    TABLE_COUNTRY,
    number_rows,
    sql_text,
    stacked,
    structs,
    version_lines,
)
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import INCONSISTENCY_COLUMNS

ENTITY = f"if(scope = 'country', {country_name('country')}, nuts) as entity"


def heatmap_data(stats: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adoption and weak share per line and header; headers nobody in the chart uses are left out.

    Both values are taken by header name.
    """
    lines = stats.filter("level in ('nuts', 'country')").selectExpr(
        "*", "if(level = 'nuts', 'region', 'country') as scope"
    )
    lines = number_rows(lines.selectExpr("*", TABLE_COUNTRY), ["nuts", "country"])
    cells = [
        {
            "header_no": str(i),
            "header": sql_text(h),
            "short_name": sql_text(short_name(h)),
            "adoption": f"`{h}_present_percent`",
            "weak": f"`{h}_weak_percent`",
        }
        for i, h in enumerate(policy.headers, start=1)
    ]
    points = lines.selectExpr("scope", "table_country", "country", "nuts", "row_no", structs(cells))
    points = points.selectExpr(
        "*", f"sum(adoption) over (partition by {TABLE}, header) as _used"
    ).filter("_used > 0")
    return points.selectExpr(
        "scope",
        "country",
        ENTITY,
        "row_no",
        f"dense_rank() over (partition by {TABLE} order by header_no) as col_no",
        "header",
        "short_name",
        "adoption",
        "weak",
        f"{whole_cell('adoption')} as adoption_text",
        f"{whole_cell('weak')} as weak_text",
    )


def dot_chart_data(stats: DataFrame) -> DataFrame:
    """Three points per entity; entities in order of their summed percentages, largest first.

    A region's sum runs over its category lines, as many as the statistics hold for it.
    """

    def values(level: str, lines: str) -> dict[str, str]:
        percents = {flag: f"{flag}_percent_{level}" for flag in INCONSISTENCY_COLUMNS}
        return {**percents, "_lines": lines}

    counted = stats.selectExpr("*", "count(*) over (partition by country, nuts) as _category_lines")
    lines = stacked(
        counted,
        [
            {"scope": "'region'", "nuts": "nuts", **values("nuts", "_category_lines")},
            {"scope": "'country'", "nuts": NO_REGION, **values("country", "1L")},
        ],
    )
    total = " + ".join(hundredths(flag) for flag in INCONSISTENCY_COLUMNS)
    lines = lines.selectExpr("*", f"({total}) * _lines as _total")
    lines = number_rows(lines, ["_total desc", "nuts", "country"], "entity_no")
    points = [{"type": sql_text(flag), "percent": flag} for flag in INCONSISTENCY_COLUMNS]
    return lines.selectExpr(
        "scope",
        "country",
        ENTITY,
        "entity_no",
        "cast(_total as double) / 100 as entity_total",
        structs(points),
    ).selectExpr("*", f"{metric_label('type')} as label")


def bar_chart_data(stats: DataFrame) -> DataFrame:
    """Stacked version shares per entity, entities in ascending order."""
    order = [f"`{v}` asc nulls last" for v in HTTP_VERSIONS] + ["nuts", "country"]
    bars = [
        {"part_no": str(i), "version": sql_text(v), "percent": f"`{v}`"}
        for i, v in enumerate(HTTP_VERSIONS, start=1)
    ]
    lines = number_rows(version_lines(stats), order)
    return lines.selectExpr("scope", "country", ENTITY, "row_no", structs(bars))


def radar_data(stats: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adoption rings, desktop against mobile, per country and category and per country.

    ``stats`` comes from all scored rows, not from the worst row per institution. The first point
    closes the ring at position n. Charts without both platforms are left out.
    """
    categories = ", ".join(f"'{c}'" for c in CATEGORIES)
    platforms = ", ".join(f"'{p}'" for p in policy.platforms)
    rings = stats.filter(
        f"(level = 'country_category_platform' and Category in ({categories})"
        f" or level = 'country_platform') and platform in ({platforms})"
    )
    rings = rings.selectExpr(
        "*", "count(*) over (partition by level, country, Category) as _rings"
    ).filter(f"_rings = {len(policy.platforms)}")
    headers = list(policy.headers)
    step = 2 * math.pi / len(headers)
    ring = [(i, h, i * step) for i, h in enumerate(headers)] + [(len(headers), headers[0], 0.0)]
    points = [
        {
            "position": str(i),
            "header": sql_text(h),
            "role": sql_text(policy.role(h)),
            "angle": literal(angle),
            "adoption": f"`{h}_present_percent`",
        }
        for i, h, angle in ring
    ]
    name = f"{country_name('country')} as country_name"
    return rings.selectExpr("country", name, "Category", "platform", structs(points))
