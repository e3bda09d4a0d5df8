"""Report tables in long form: one row per table, line and column, in display order.

A table is identified by ``scope`` and, below country scope, ``country``. ``row_no`` is the line
number, ``col_no`` the column order. Inputs are statistics of geography size, so the windows here
sort a few hundred rows. :func:`widen` turns one table into its printed shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.functions.labels import (
    HTTP_VERSIONS,
    cell,
    column_label,
    country_name,
    glossary_name,
    short_name,
    two_decimals,
)
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import INCONSISTENCY_COLUMNS

CATEGORIES = ("public", "private")
CSP, HSTS = "content-security-policy", "strict-transport-security"
TABLE = "scope, table_country"
TABLE_COUNTRY = "if(scope = 'country', null, country) as table_country"
NO_REGION = "cast(null as string)"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def structs(rows: list[dict[str, str]]) -> str:
    """``inline`` of literal-shaped structs: one output row per entry."""
    items = [
        "struct(" + ", ".join(f"{sql} as `{name}`" for name, sql in row.items()) + ")"
        for row in rows
    ]
    return f"inline(array({', '.join(items)}))"


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    ranked = f"row_number() over (partition by {TABLE} order by {', '.join(order)}) as {name}"
    return df.selectExpr("*", ranked)


def _drop_zero_columns(table: DataFrame, column: str, keep: str = "false") -> DataFrame:
    """Remove metric columns that are zero in every line of their table."""
    total = f"sum(coalesce(percent, 0D)) over (partition by {TABLE}, {column})"
    return table.selectExpr("*", f"{total} as _total").filter(f"_total > 0 or {keep}")


def _finish(table: DataFrame, *labels: str) -> DataFrame:
    return table.selectExpr(
        "scope",
        "country",
        f"{country_name('country')} as country_name",
        "nuts as region",
        "row_no",
        "col_no",
        *labels,
        "percent",
        f"{cell('percent')} as cell",
    )


def adoption_table(
    stats: DataFrame, weak: bool = False, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Header adoption, or weak configurations, per region, region and category, and country."""
    categories = " ".join(
        f"when level = 'nuts_category' and Category = '{c}' then 'region_{c}'" for c in CATEGORIES
    )
    scope = f"case when level = 'nuts' then 'region' when level = 'country' then 'country' {categories} end"
    lines = stats.selectExpr("*", f"{scope} as scope").filter("scope is not null")
    lines = lines.selectExpr("*", TABLE_COUNTRY)
    order = [f"`{h}_present_percent` desc" for h in (CSP, HSTS)] + ["nuts", "country"]
    if weak:
        order = [f"`{h}_weak_percent` asc" for h in (CSP, HSTS)] + order
    kind = "weak" if weak else "present"
    cells = [
        {
            "col_no": str(i),
            "header": sql_text(h),
            "short_name": sql_text(short_name(h)),
            "glossary_name": sql_text(glossary_name(h)),
            "percent": f"`{h}_{kind}_percent`",
        }
        for i, h in enumerate(policy.headers, start=1)
    ]
    table = number_rows(lines, order).selectExpr(
        "scope", "table_country", "country", "nuts", "row_no", structs(cells)
    )
    return _finish(_drop_zero_columns(table, "header"), "header", "short_name", "glossary_name")


def stacked(stats: DataFrame, blocks: list[dict[str, str]]) -> DataFrame:
    """Several report scopes out of one pass over statistics rows.

    Each block gives scope, nuts and values; a null scope yields no line. Values that repeat on
    several statistics rows give one line.
    """
    return (
        stats.selectExpr("country", structs(blocks))
        .filter("scope is not null")
        .dropDuplicates(["scope", "country", "nuts"])
        .selectExpr("*", TABLE_COUNTRY)
    )


def inconsistency_lines(stats: DataFrame) -> DataFrame:
    def values(level: str) -> dict[str, str]:
        return {flag: f"{flag}_percent_{level}" for flag in INCONSISTENCY_COLUMNS}

    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    by_category = f"if(Category in ({names}), concat('region_', Category), null)"
    return stacked(
        stats,
        [
            {"scope": "'region'", "nuts": "nuts", **values("nuts")},
            {"scope": by_category, "nuts": "nuts", **values("nuts_category")},
            {"scope": "'country'", "nuts": NO_REGION, **values("country")},
        ],
    )


def version_lines(stats: DataFrame) -> DataFrame:
    def values(level: str) -> dict[str, str]:
        return {v: f"`{v}_percent_{level}`" for v in HTTP_VERSIONS}

    return stacked(
        stats,
        [
            {"scope": "'region'", "nuts": "nuts", **values("nuts")},
            {"scope": "'country'", "nuts": NO_REGION, **values("country")},
        ],
    )


def inconsistency_table(stats: DataFrame) -> DataFrame:
    """Share of institutions with inconsistent platforms, per region, category and country."""
    order = [f"{flag} desc" for flag in INCONSISTENCY_COLUMNS] + ["nuts", "country"]
    cells = [
        {"col_no": str(i), "metric": sql_text(flag), "percent": flag}
        for i, flag in enumerate(INCONSISTENCY_COLUMNS, start=1)
    ]
    table = number_rows(inconsistency_lines(stats), order).selectExpr(
        "scope", "country", "nuts", "row_no", structs(cells)
    )
    return _finish(table, "metric", f"{column_label('metric')} as label")


def http_version_table(stats: DataFrame) -> DataFrame:
    """HTTP-version shares per region and per country; zero columns go in region tables only."""
    order = [f"`{v}` desc" for v in HTTP_VERSIONS] + ["nuts", "country"]
    cells = [
        {
            "col_no": str(i),
            "version": sql_text(v),
            "label": sql_text(v.upper().replace("/", "-")),
            "percent": f"`{v}`",
        }
        for i, v in enumerate(HTTP_VERSIONS, start=1)
    ]
    table = number_rows(version_lines(stats), order).selectExpr(
        "scope", "table_country", "country", "nuts", "row_no", structs(cells)
    )
    table = _drop_zero_columns(table, "version", keep="scope = 'country'")
    return _finish(table, "version", "label")


def region_score_table(scores: DataFrame) -> DataFrame:
    """Regions of each country by mean score, best first."""
    return scores.selectExpr(
        "country",
        f"{country_name('country')} as country_name",
        "nuts as region",
        "row_number() over (partition by country order by final_score desc, nuts) as row_no",
        "final_score",
        f"{two_decimals('final_score')} as cell",
    )


def widen(table: DataFrame, labels: list[str], label: str = "short_name") -> DataFrame:
    """Printed shape of a long table: one line per row, one text column per label."""
    lines = table.groupBy("scope", "country", "country_name", "region", "row_no")
    return lines.pivot(label, labels).agg(F.first("cell"))


def preview(table: DataFrame, head: int = 0, tail: int = 0) -> DataFrame:
    """First and last lines of every table, by line number; ``part`` says which."""
    last = "max(row_no) over (partition by scope, if(scope = 'country', null, country))"
    parts = f"array(if(row_no <= {head}, 'head', null), if(row_no > _last - {tail}, 'tail', null))"
    numbered = table.selectExpr("*", f"{last} as _last")
    return numbered.selectExpr("*", f"explode(array_compact({parts})) as part").drop("_last")
