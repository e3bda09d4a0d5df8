"""The additive summary behind every statistic.

One aggregation at the finest grouping key (country, region, category, platform). Its size depends
on geography, not on the number of institutions, and every count in it can be added up, so adoption,
inconsistency, HTTP-version and region statistics all read this table instead of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.functions.labels import HTTP_VERSIONS, protocol_name
from sitegrade.functions.numeric import hundredths
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID, INCONSISTENCY_COLUMNS, NUTS, config_col, presence_col

FINEST = ("country", "nuts", "Category", "platform")

# Grouping levels: name -> grouping keys.
LEVELS = {
    "nuts": ("country", "nuts"),
    "nuts_category": ("country", "nuts", "Category"),
    "country_category": ("country", "Category"),
    "country": ("country",),
    "country_category_platform": ("country", "Category", "platform"),
    "country_platform": ("country", "platform"),
}


def header_counts(policy: Policy = DEFAULT_POLICY) -> dict[str, str]:
    present = {f"{h}_present": f"count_if(`{presence_col(h)}`)" for h in policy.headers}
    labels = {
        f"{h}_{label.lower()}": f"count_if(`{config_col(h)}` = '{label}')"
        for label in ("Strong", "Weak")
        for h in policy.headers
    }
    return present | labels


def flag_counts() -> dict[str, str]:
    return {f"{flag}_schools": f"count_if({flag})" for flag in INCONSISTENCY_COLUMNS}


def version_counts() -> dict[str, str]:
    protocol = protocol_name("protocol_http")
    known = {version: f"count_if({protocol} = '{version}')" for version in HTTP_VERSIONS}
    return {**known, "protocol_rows": "count(protocol_http)"}


def score_sums() -> dict[str, str]:
    return {
        "score_hundredths": f"sum({hundredths('final_score')})",
        "score_rows": "count(final_score)",
    }


def summary_columns(*, headers: bool = True, policy: Policy = DEFAULT_POLICY) -> list[str]:
    """Row columns the summary reads, besides flags and final score."""
    pairs = [col(h) for h in policy.headers for col in (presence_col, config_col)]
    return ["country", NUTS, "Category", "protocol_http", *(pairs if headers else [])]


def summarize(rows: DataFrame, *parts: dict[str, str]) -> DataFrame:
    """Counts at the finest key. ``parts`` limits it to what a report needs."""
    counts = {name: sql for part in parts for name, sql in part.items()}
    return rows.groupBy("country", F.col(NUTS).alias("nuts"), "Category", "platform").agg(
        F.count(ID).alias("total_schools"),
        *[F.expr(sql).alias(name) for name, sql in counts.items()],
    )


def summarize_all(rows: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return summarize(rows, header_counts(policy), flag_counts(), version_counts(), score_sums())


def roll_up(summary: DataFrame, levels: tuple[str, ...], counts: list[str]) -> DataFrame:
    """Add the summary up to several grouping levels in one pass.

    A null in a grouping key drops the group, but only at the levels that group by that key:
    the grouping bit tells a null key from a key that was rolled up.
    """
    keys = [k for k in FINEST if any(k in LEVELS[level] for level in levels)]
    grouped = summary.groupingSets([list(LEVELS[level]) for level in levels], *keys).agg(
        F.grouping_id(*keys).alias("_gid"),
        *[F.expr(f"sum(`{name}`)").alias(name) for name in counts],
    )
    names, complete = [], []
    for level in levels:
        bits = "".join("0" if k in LEVELS[level] else "1" for k in keys)
        here = f"_gid = {int(bits, 2)}"
        names.append(f"when {here} then '{level}'")
        complete.append(" and ".join([here, *[f"{key} is not null" for key in LEVELS[level]]]))
    return grouped.filter(" or ".join(f"({test})" for test in complete)).selectExpr(
        *keys,
        *[f"cast(null as string) as {k}" for k in FINEST if k not in keys],
        f"case {' '.join(names)} end as level",
        *[f"`{name}`" for name in counts],
    )
