"""Scores, consistency checks and grades.

A component (headers, redirects, HTTP version) consists of a score per row, values per institution
and a final expression. The institution values are aggregated once for all components asked for
and joined back (see ``keyed``); no window is used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrade.functions.numeric import literal, order_free_mean, round2
from sitegrade.functions.urls import HTTP, HTTPS, is_https
from sitegrade.operators.keyed import attach
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID, INCONSISTENCY_COLUMNS, config_col, presence_col

CRITICAL_FLAG, HEADER_FLAG, REDIRECT_FLAG = INCONSISTENCY_COLUMNS
HTTP_FLAG = "http_inconsistency_between_platforms"

# Weights, factors and grade limits of the scoring model.
HEADER_WEIGHT, REDIRECT_WEIGHT = 0.6, 0.4
CRITICAL_FACTOR, HEADER_FACTOR, REDIRECT_FACTOR, HTTP_FACTOR = 0.85, 0.90, 0.9, 0.1
H3_FACTOR, H2_FACTOR = 1.3, 1.1
FACTORS = (1.0, H2_FACTOR, H3_FACTOR)
SAME_DOMAIN_POINTS, OTHER_DOMAIN_POINTS = 100.0, 70.0
GRADES = ((0, 20, "F"), (20, 35, "E"), (35, 50, "D"), (50, 65, "C"), (65, 80, "B"), (80, 101, "A"))

# What a "seen" mask records of one header: presence true and false, and its labels.
SEEN_LABELS = ("Missing", "Weak", "Strong")
_PRESENCE_BITS = 2
_BITS = _PRESENCE_BITS + len(SEEN_LABELS) + 1
_PER_MASK = 63 // _BITS


def platform_count(df: DataFrame) -> DataFrame:
    """One row: distinct platforms in the whole table."""
    return df.agg(F.count_distinct("platform").alias("n_platforms"))


# ---- score of one row -------------------------------------------------------------------------


def header_points(header: str, policy: Policy = DEFAULT_POLICY) -> str:
    """Points of one header. The domain is finite, so the values are literals of the plan."""
    points = {label: literal(policy.header_points(header, label)) for label in ("strong", "weak", None)}
    return (
        f"case when not coalesce(`{presence_col(header)}`, false) then 0D"
        f" else case lower(`{config_col(header)}`) when 'strong' then {points['strong']}"
        f" when 'weak' then {points['weak']} else {points[None]} end end"
    )


def header_row_score(policy: Policy = DEFAULT_POLICY) -> str:
    return round2(" + ".join(header_points(h, policy) for h in policy.headers))


def redirect_row_score() -> str:
    return (
        "case when not coalesce(redirected_to_https, false) then 0D"
        f" when redirected_https_to_same_domain then {literal(SAME_DOMAIN_POINTS)}"
        f" else {literal(OTHER_DOMAIN_POINTS)} end"
    )


def http_row_score() -> str:
    plain, h2, h3 = (literal(round(100 / H3_FACTOR * factor, 2)) for factor in FACTORS)
    return (
        f"case when not coalesce(startswith(lower(final_url), '{HTTPS}'), false) then 1D"
        f" else case lower(protocol_http) when 'h2' then {h2} when 'h3' then {h3}"
        f" else {plain} end end"
    )


def protocol_factor() -> str:
    return (
        f"case lower(protocol_http) when 'h3' then {literal(H3_FACTOR)}"
        f" when 'h2' then {literal(H2_FACTOR)} else 1D end"
    )


def unknown_scheme() -> str:
    url = "lower(final_url)"
    return f"not coalesce(startswith({url}, '{HTTPS}') or startswith({url}, '{HTTP}'), false)"


def unknown_protocol() -> str:
    known = "lower(protocol_http) in ('h2', 'h3', 'http/1.1', 'http/1.0')"
    return f"not coalesce({known}, false)"


# ---- what an institution's rows have shown ----------------------------------------------------


def _masks(policy: Policy) -> list[tuple[str, ...]]:
    headers = policy.headers
    return [headers[i : i + _PER_MASK] for i in range(0, len(headers), _PER_MASK)]


def seen_mask(headers: tuple[str, ...]) -> str:
    """All presence and label values of one row as bits of a bigint.

    ``bit_or`` over an institution then tells which values occurred. Two bigints replace a
    minimum and maximum of every presence and label column in the shuffle. Labels outside
    Missing/Weak/Strong have no bit (see ``other_label``).
    """
    labels = ", ".join(f"'{label}'" for label in SEEN_LABELS)
    parts = []
    for i, header in enumerate(headers):
        low = _BITS * i
        position = f"nullif(cast(array_position(array({labels}), `{config_col(header)}`) as int), 0)"
        parts.append(f"coalesce(if(`{presence_col(header)}`, {1 << low}L, {2 << low}L), 0L)")
        parts.append(f"coalesce(shiftleft({4 << low}L, {position}), 0L)")
    return " | ".join(parts)


def other_label(header: str) -> str:
    """Hash of a label outside Missing/Weak/Strong, null for these: their bits tell them apart.

    Smallest and largest hash of an institution then tell whether it has none, one or more other
    labels. They are null in normal data; as numbers they keep the aggregation a hash aggregation.
    """
    column = f"`{config_col(header)}`"
    labels = ", ".join(f"'{label}'" for label in SEEN_LABELS)
    return f"if({column} is null or {column} in ({labels}), null, xxhash64({column}))"


def _varied(policy: Policy, names: tuple[str, ...]) -> str:
    """Some presence or label column of ``names`` has more than one value."""
    presence = (1 << _PRESENCE_BITS) - 1
    labels = ((1 << _BITS) - 1) ^ presence
    tests = []
    for m, headers in enumerate(_masks(policy)):
        for i, header in enumerate(headers):
            if header in names:
                low = f"_seen_low_{header_number(policy, header)}"
                high = f"_seen_high_{header_number(policy, header)}"
                others = f"case when {low} is null then 0 when {low} = {high} then 1 else 2 end"
                tests.append(f"bit_count(_seen_{m} & {presence << _BITS * i}L) > 1")
                tests.append(f"bit_count(_seen_{m} & {labels << _BITS * i}L) + {others} > 1")
    return " or ".join(tests) if tests else "false"


def header_number(policy: Policy, header: str) -> int:
    return policy.headers.index(header)


def _differs(value: str) -> str:
    return f"coalesce(min({value}) <> max({value}), false)"


def _mean(score: str) -> str:
    return round2(order_free_mean(score))


def _penalty(flag: str, factor: float, distance: str) -> str:
    return f"if({flag}, 1D, 0D) * {literal(factor)} * {distance}"


DISTANCE = "(1D - _n / 100D)"
NEARNESS = "(_n / 100D)"


# ---- components -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Component:
    """How one part of the score is computed; all expressions are SQL text."""

    name: str
    rows: Callable[[Policy], dict[str, str]]
    values: Callable[[Policy], dict[str, str]]
    derived: Callable[[Policy], dict[str, str]]
    penalty: str
    uses_protocol: bool = False

    def add_result(self, df: DataFrame, factor: str, suffix: str = "") -> DataFrame:
        """Add the component score; needs the institution values and ``_n`` in ``df``."""
        penalty, raw = f"_{self.name}_penalty{suffix}", f"_{self.name}_raw{suffix}"
        mean = f"{self.name}_avg_score_btw_platforms"
        if self.uses_protocol:
            mean = f"({mean} * {factor})"
        df = df.withColumn(penalty, F.expr(self.penalty))
        df = df.withColumn(raw, F.expr(f"{mean} * if({penalty} > 0, {penalty}, 1D)"))
        score = round2(f"if({raw} > 100, 100D, {raw})")
        return df.withColumn(f"{self.name}_component_score{suffix}", F.expr(score)).drop(penalty, raw)


HEADERS = Component(
    name="header",
    rows=lambda policy: {"header_score_by_platform": header_row_score(policy)},
    values=lambda policy: {
        "header_avg_score_btw_platforms": _mean("header_score_by_platform"),
        **{f"_seen_{m}": f"bit_or({seen_mask(names)})" for m, names in enumerate(_masks(policy))},
        **{
            f"_seen_{side}_{i}": f"{function}({other_label(header)})"
            for i, header in enumerate(policy.headers)
            for side, function in (("low", "min"), ("high", "max"))
        },
    },
    derived=lambda policy: {
        CRITICAL_FLAG: _varied(policy, policy.critical),
        HEADER_FLAG: _varied(policy, policy.headers),
    },
    penalty=_penalty(CRITICAL_FLAG, CRITICAL_FACTOR, DISTANCE)
    + " + "
    + _penalty(HEADER_FLAG, HEADER_FACTOR, DISTANCE),
    uses_protocol=True,
)

REDIRECT = Component(
    name="redirect",
    rows=lambda policy: {"redirect_score_by_platform": redirect_row_score()},
    values=lambda policy: {
        "redirect_avg_score_btw_platforms": _mean("redirect_score_by_platform"),
        REDIRECT_FLAG: _differs("redirected_to_https")
        + " or "
        + _differs("redirected_https_to_same_domain"),
    },
    derived=lambda policy: {},
    penalty=_penalty(REDIRECT_FLAG, REDIRECT_FACTOR, DISTANCE),
)

HTTP_VERSION = Component(
    name="http",
    rows=lambda policy: {
        "http_score_by_platform": http_row_score(),
        "unknown_scheme": unknown_scheme(),
        "unknown_protocol": unknown_protocol(),
    },
    values=lambda policy: {
        "http_avg_score_btw_platforms": _mean("http_score_by_platform"),
        HTTP_FLAG: _differs(is_https("final_url")),
    },
    derived=lambda policy: {},
    penalty=_penalty(HTTP_FLAG, HTTP_FACTOR, NEARNESS),
)

FINAL_PARTS = (HEADERS, REDIRECT)


def _row_scores(df: DataFrame, components: tuple[Component, ...], policy: Policy) -> DataFrame:
    scores = {name: sql for part in components for name, sql in part.rows(policy).items()}
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in scores.items()])


def _institutions(
    rows: DataFrame,
    components: tuple[Component, ...],
    policy: Policy,
    platforms: Column,
    more: dict[str, str] | None = None,
) -> DataFrame:
    """One row per institution: means, flags, the ``more`` aggregates asked for, and ``_n``.

    The state of means and flags is numbers, so without ``more`` this is a hash aggregation.
    """
    values = {name: sql for part in components for name, sql in part.values(policy).items()}
    derived = {name: sql for part in components for name, sql in part.derived(policy).items()}
    values |= more or {}
    known = rows.filter(f"{ID} is not null")
    grouped = known.groupBy(ID).agg(*[F.expr(sql).alias(name) for name, sql in values.items()])
    public = [name for name in values if not name.startswith("_seen_")]
    return grouped.withColumn("_n", platforms).selectExpr(
        ID, *public, "_n", *[f"{sql} as {name}" for name, sql in derived.items()]
    )


def _platforms(df: DataFrame, n_platforms: int | None) -> Column:
    """``n_platforms``, or where it is None the count in ``df``: a read of its own, of one column."""
    return platform_count(df).scalar() if n_platforms is None else F.lit(n_platforms)


def _score(
    df: DataFrame,
    components: tuple[Component, ...],
    policy: Policy,
    n_platforms: int | None,
) -> DataFrame:
    rows = _row_scores(df, components, policy)
    values = _institutions(rows, components, policy, _platforms(df, n_platforms))
    joined = attach(rows, values, [ID])
    for part in components:
        joined = part.add_result(joined, protocol_factor())
    return joined.drop("_n")


def header_scores(
    df: DataFrame, policy: Policy = DEFAULT_POLICY, n_platforms: int | None = None
) -> DataFrame:
    return _score(df, (HEADERS,), policy, n_platforms)


def redirect_scores(
    df: DataFrame, policy: Policy = DEFAULT_POLICY, n_platforms: int | None = None
) -> DataFrame:
    return _score(df, (REDIRECT,), policy, n_platforms)


def http_scores(
    df: DataFrame, policy: Policy = DEFAULT_POLICY, n_platforms: int | None = None
) -> DataFrame:
    """HTTP-version component. It is reported on its own and has no part in the final score."""
    return _score(df, (HTTP_VERSION,), policy, n_platforms)


def _final_score(header: str, redirect: str) -> str:
    weighted = f"{header} * {literal(HEADER_WEIGHT)} + {redirect} * {literal(REDIRECT_WEIGHT)}"
    return round2(weighted)


def grade(score: str) -> str:
    branches = " ".join(
        f"when {score} >= {low} and {score} < {high} then '{name}'" for low, high, name in GRADES
    )
    return f"case {branches} end"


def final_scores(
    df: DataFrame, policy: Policy = DEFAULT_POLICY, n_platforms: int | None = None
) -> DataFrame:
    """Every score column of an observation table.

    ``n_platforms`` is counted in the table when not given.
    """
    scored = _score(df, FINAL_PARTS, policy, n_platforms)
    total = _final_score("header_component_score", "redirect_component_score")
    return scored.selectExpr("*", f"{total} as final_score").selectExpr(
        "*", f"{grade('final_score')} as grade"
    )


def stamp_analysis(df: DataFrame) -> DataFrame:
    return df.withColumn("analysis_datetime", F.current_timestamp())


def _record(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}`{name}`" for name in columns)


def _hashable(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that order equal rows: no maps, and not the time of the run."""
    kinds = dict(df.dtypes)
    return [c for c in columns if c != "analysis_datetime" and not kinds[c].startswith("map<")]


def worst_observation(scored: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each institution's row with the lowest final score; ties go to the first platform name.

    ``min_by`` combines on the map side, so a hot institution sends one row per task. Name the
    ``columns`` needed later: everything else stays out of the shuffle. Rows that also agree in
    the platform are ordered by a hash of their content.
    """
    kept = columns or scored.columns
    order = f"struct(final_score, platform, xxhash64({_record(_hashable(scored, kept))}))"
    return (
        scored.filter(f"{ID} is not null and final_score is not null")
        .groupBy(F.col(ID).alias("_id"))
        .agg(F.expr(f"min_by(struct({_record(kept)}), {order})").alias("row"))
        .select("row.*")
    )


def worst_scores(
    df: DataFrame,
    columns: list[str],
    policy: Policy = DEFAULT_POLICY,
    n_platforms: int | None = None,
) -> DataFrame:
    """``worst_observation(final_scores(df))`` in one aggregation: no join back to the rows.

    Within an institution the final score depends on the row only through the protocol factor,
    which has three values. So the first row per factor is kept next to the institution's values,
    each is scored, and the lowest of at most three is the answer. ``columns`` are row columns of
    ``df`` (no maps); the score columns are added.
    """
    rows = _row_scores(df, FINAL_PARTS, policy)
    kept = list(dict.fromkeys([ID, "platform", *columns]))
    content = f"xxhash64({_record(_hashable(rows, kept))})"
    rows = rows.selectExpr("*", f"{protocol_factor()} as _factor", f"{content} as _content")
    rows = rows.selectExpr(
        "*",
        f"struct({_record(kept)}, _content) as _record",
        "struct(platform, _content) as _order",
    )
    firsts = {
        f"_row_{i}": f"min_by(_record, _order) filter (where _factor = {literal(factor)})"
        for i, factor in enumerate(FACTORS)
    }
    values = _institutions(rows, FINAL_PARTS, policy, _platforms(df, n_platforms), firsts)
    values = REDIRECT.add_result(values, "1D")
    candidates = []
    for i, factor in enumerate(FACTORS):
        values = HEADERS.add_result(values, literal(factor), f"_{i}")
        final = _final_score(f"header_component_score_{i}", "redirect_component_score")
        fields = ", ".join(f"_row_{i}.`{name}` as `{name}`" for name in kept)
        candidates.append(
            f"if(_row_{i} is null, null, struct({final} as final_score, _row_{i}.platform as _first,"
            f" _row_{i}._content as _next, header_component_score_{i} as header_component_score,"
            f" {fields}))"
        )
    means = [f"{part.name}_avg_score_btw_platforms" for part in FINAL_PARTS]
    # The generator keeps later filters on row columns from being copied into the expressions above.
    lowest = values.selectExpr(
        *means,
        *INCONSISTENCY_COLUMNS,
        "redirect_component_score",
        f"inline(array(array_min(array({', '.join(candidates)}))))",
    )
    return lowest.selectExpr(
        *[f"`{name}`" for name in kept],
        *means,
        *INCONSISTENCY_COLUMNS,
        "header_component_score",
        "redirect_component_score",
        "final_score",
        f"{grade('final_score')} as grade",
    )
