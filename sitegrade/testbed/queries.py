"""One query per operator family, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegrade.functions import labels, urls
from sitegrade.operators import scoring, statistics
from sitegrade.operators.assess import assess_headers, mark_outcome, split_errors
from sitegrade.operators.repair import repair_shifted_rows
from sitegrade.operators.retry import retry_worklist as pending_institutions
from sitegrade.operators.scanlog import combine_attempts, fold_scan_log, join_source
from sitegrade.operators.summary import (
    flag_counts,
    header_counts,
    score_sums,
    summarize,
    summary_columns,
    version_counts,
)
from sitegrade.plans import charts, tables
from sitegrade.policy import DEFAULT_POLICY as POLICY
from sitegrade.schemas import ID, NUTS, SCAN_COLUMNS, SOURCE_COLUMNS, config_col, presence_col
from sitegrade.session import configure
from sitegrade.sources.readers import file_keys
from sitegrade.testbed import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


# ---- URLs, names ------------------------------------------------------------------------------


@query
def url_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").selectExpr("page_id", f"{urls.host_of('url')} as host")
    return pages.selectExpr(
        "*", f"{urls.http_url('host')} as http_url", f"{urls.https_url('host')} as https_url"
    )


@query
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.selectExpr("page_id", f"{urls.domain_of('url')} as domain")


@query
def redirect_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL against the URL a redirect may have led to."""
    final_url = f"""case page_id % 3 when 0 then replace(url, 'http://', 'https://')
        when 1 then concat('https://www.', {urls.host_of("url")}, ':443/') else url end"""
    pages = views.table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{urls.host_of('url')} as host", f"{final_url} as final_url"
    )
    return pages.selectExpr(
        "page_id",
        "final_url",
        f"{urls.is_https('final_url')} as redirected_to_https",
        f"{urls.stays_on_domain('host', 'final_url')} as redirected_https_to_same_domain",
    )


@query
def result_file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country and platform of a result file named after each document's language and source."""
    country, platform = file_keys("file_name")
    names = views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(lang, '_', source, '.csv') as file_name"
    )
    return names.selectExpr("*", f"{country} as country", f"{platform} as platform")


@query
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country name and code, language, and cell texts for every order."""
    rows = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k",
        "elt(cast(o_orderkey % 5 as int) + 1, 'de', 'fr', 'it', 'es', 'Germany') as code",
        "case when o_orderkey % 9 = 0 then null when o_orderkey % 10 = 0 then 50D"
        " else o_totalprice / 800 end as share",
    )
    return rows.selectExpr(
        "k",
        f"{labels.country_name('code')} as country_name",
        f"{labels.country_code('code')} as country_code",
        f"{labels.accept_language('code', dict(POLICY.languages))} as idioma",
        "share",
        f"{labels.cell('share')} as cell",
    )


# ---- scan logs --------------------------------------------------------------------------------


@query
def scan_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_scan_log(views.scan_logs(spark, sf_dir)).selectExpr(
        ID, "platform", "attempt", "initial_status", "final_status", "redirect_count",
        "try_element_at(headers, 'x-frame-options') as frame_options",
        "map_contains_key(headers, 'Server') as has_server",
        "protocol", "final_url",
    )


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = combine_attempts(fold_scan_log(views.scan_logs(spark, sf_dir)))
    return join_source(pairs, views.scanned_sites(spark, sf_dir))


@query
def scan_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).select(
        ID, "platform", "assessment_datetime", "http_status_code", "https_status_code",
        "redirected_to_https", "redirected_https_to_same_domain", "final_url", "idioma",
        "protocol_http", "redirect_count", "error",
    )


@query
def scan_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs to observations: header names in mixed case, last of equal names, error split."""
    results, _ = split_errors(assess_headers(_scans(spark, sf_dir)), "coalesce(error, header_error)")
    return results.select(
        ID, "platform", "https_status_code", "protocol_http",
        "`x-frame-options_presence`", "`x-frame-options_config`",
        "`strict-transport-security_config`", "`set-cookie_presence`",
    )


@query
def header_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"`{col(h)}`" for h in POLICY.headers for col in (presence_col, config_col)]
    return views.assessed(spark, sf_dir).select(ID, "platform", *columns, "header_error")


@query
def result_error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_outcome(views.assessed(spark, sf_dir), "header_error")
    return marked.filter("outcome is not null").select(ID, "platform", "outcome", "error")


# ---- scores -----------------------------------------------------------------------------------


@query
def platform_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.platform_count(views.observations(spark, sf_dir))


@query
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.header_scores(views.observations(spark, sf_dir)).select(
        ID, "platform", "header_score_by_platform", "header_avg_score_btw_platforms",
        "header_component_score",
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.final_scores(views.observations(spark, sf_dir))


@query
def inconsistency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = (scoring.CRITICAL_FLAG, scoring.HEADER_FLAG, scoring.REDIRECT_FLAG)
    return _scored(spark, sf_dir).select(ID, "platform", *flags)


@query
def redirect_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.redirect_scores(views.observations(spark, sf_dir)).select(
        ID, "platform", "redirect_score_by_platform", "redirect_avg_score_btw_platforms",
        scoring.REDIRECT_FLAG, "redirect_component_score",
    )


@query
def http_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.http_scores(views.observations(spark, sf_dir)).select(
        ID, "platform", "http_score_by_platform", "http_avg_score_btw_platforms",
        scoring.HTTP_FLAG, "http_component_score", "unknown_scheme", "unknown_protocol",
    )


@query
def final_score_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        ID, "platform", "header_component_score", "redirect_component_score", "final_score", "grade"
    )


@query
def worst_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [ID, "country", NUTS, "Category", "platform", "protocol_http", "final_score", "grade"]
    return scoring.worst_observation(_scored(spark, sf_dir), columns)


def _worst(spark: SparkSession, sf_dir: str, headers: bool = False) -> DataFrame:
    rows = views.observations(spark, sf_dir)
    return scoring.worst_scores(rows, summary_columns(headers=headers))


@query
def worst_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worst(spark, sf_dir).select(
        ID, "country", NUTS, "Category", "platform", "protocol_http", "header_component_score",
        "redirect_component_score", "final_score", "grade", scoring.HEADER_FLAG,
    )


# ---- statistics and tables --------------------------------------------------------------------


@query
def country_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.country_overview(views.observations(spark, sf_dir))


@query
def adoption_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = summarize(_worst(spark, sf_dir, headers=True), header_counts(POLICY))
    return statistics.adoption_stats(summary)


@query
def inconsistency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.inconsistency_stats(summarize(_worst(spark, sf_dir), flag_counts()))


@query
def http_version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.http_version_stats(summarize(_worst(spark, sf_dir), version_counts()))


@query
def adoption_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.adoption_table(adoption_stats(spark, sf_dir))


@query
def weak_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.adoption_table(adoption_stats(spark, sf_dir), weak=True)


@query
def adoption_table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [labels.short_name(h) for h in POLICY.headers]
    return tables.widen(adoption_table(spark, sf_dir), names)


@query
def inconsistency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.inconsistency_table(inconsistency_stats(spark, sf_dir))


@query
def http_version_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.http_version_table(http_version_stats(spark, sf_dir))


@query
def region_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = statistics.region_scores(summarize(_worst(spark, sf_dir), score_sums()))
    return tables.region_score_table(scores)


@query
def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preview(inconsistency_table(spark, sf_dir), head=2, tail=2).select(
        "part", "scope", "country", "region", "row_no", "col_no", "cell"
    )


@query
def heatmap_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.heatmap_data(adoption_stats(spark, sf_dir))


@query
def dot_chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.dot_chart_data(inconsistency_stats(spark, sf_dir))


@query
def bar_chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.bar_chart_data(http_version_stats(spark, sf_dir))


@query
def radar_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header counts need no scores: the summary reads the observations directly."""
    summary = summarize(views.observations(spark, sf_dir), header_counts(POLICY))
    return charts.radar_data(statistics.adoption_stats(summary))


# ---- files and passes -------------------------------------------------------------------------


@query
def row_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as text; every seventh was written with the platform at position 12."""
    source = [ID, f"concat('Site ', {ID})", "Category", *["'x'"] * 4, NUTS, *["'y'"] * 4]
    scan = ["'2025-01-05 10:00:00'", "301", "200", "redirected_to_https",
            "redirected_https_to_same_domain", "final_url", "country", "platform"]
    shifted = [scan[-1], *scan[:-1]]
    damaged = [
        f"if({ID} % 7 = 0, cast({wrong} as string), cast({right} as string))"
        for wrong, right in zip(shifted, scan)
    ]
    columns = zip([*source, *damaged, "protocol_http", "1"], [*SOURCE_COLUMNS, *SCAN_COLUMNS])
    rows = views.raw_observations(spark, sf_dir).selectExpr(
        *[f"cast({sql} as string) as {name}" for sql, name in columns]
    )
    return repair_shifted_rows(rows).select(ID, *SCAN_COLUMNS)


@query
def retry_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions left after several passes: orders are the source, line items the outcomes.

    Every line item of an order is one pass; returned items failed, the others succeeded when
    they are the last platform's.
    """
    items = views.table(spark, sf_dir, "lineitem")
    errors = items.filter("l_returnflag = 'R'").selectExpr(f"l_orderkey as {ID}")
    results = items.filter("l_returnflag <> 'R'").selectExpr(
        f"l_orderkey as {ID}", "if(l_linestatus = 'O', 'mobile', 'desktop') as platform"
    )
    source = views.institutions(spark, sf_dir).select(ID, "country", "Category")
    return pending_institutions(source, results, errors)
