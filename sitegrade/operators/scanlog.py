"""Fold captured browser logs into one record per page load, then into one scan per platform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.functions.labels import accept_language
from sitegrade.functions.urls import host_of, is_https, stays_on_domain
from sitegrade.operators.keyed import attach
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID

SCAN_KEYS = (ID, "platform")
ATTEMPT_KEYS = (*SCAN_KEYS, "attempt")

REQUEST_EVENT = "Network.requestWillBeSent"
RESPONSE_EVENT = "Network.responseReceived"
UNKNOWN_PROTOCOL = "Unknown"
NO_HTTP_LOAD, NO_HTTPS_LOAD = "no page load over http", "no page load over https"

# When an event was logged, if the logs tell: ``assessment_datetime`` comes from it.
EVENT_TIME = "logged_at"

MESSAGE_SCHEMA = (
    "message struct<method: string, params: struct<"
    "redirectResponse: struct<status: int>, "
    "response: struct<url: string, headers: map<string, string>, protocol: string, status: int>>>"
)


def fold_scan_log(logs: DataFrame, keys: tuple[str, ...] = ATTEMPT_KEYS) -> DataFrame:
    """One record per page load from its log events.

    ``logs``: keys, ``seq`` (log order), ``final_url`` (of the page load), ``message`` (JSON), and
    ``logged_at`` if the log tells the time.
    Each task first combines its own events, so a page load that holds a large part of all events
    moves one row per task and landed page.
    """
    time = EVENT_TIME if EVENT_TIME in logs.columns else "null"
    parsed = logs.selectExpr(
        *keys,
        "seq",
        "final_url",
        f"cast({time} as timestamp_ntz) as {EVENT_TIME}",
        f"from_json(message, '{MESSAGE_SCHEMA}').message as event",
    )
    redirected = (
        f"coalesce(contains(event.method, '{REQUEST_EVENT}')"
        " and event.params.redirectResponse.status between 300 and 399, false)"
    )
    landed = (
        f"coalesce(contains(event.method, '{RESPONSE_EVENT}')"
        " and event.params.response.url = final_url, false)"
    )
    facts = parsed.selectExpr(
        *keys,
        "seq",
        "final_url",
        EVENT_TIME,
        "event.method is null as unreadable",
        f"{redirected} as redirected",
        f"case when {redirected} then event.params.redirectResponse.status"
        f" when {landed} then event.params.response.status end as status",
        f"{landed} as landed",
        "event.params.response as response",
    )
    # Order and status in one number, so that the first status is a plain minimum.
    first = f"cast(seq as decimal(20, 0)) * {_STATUSES}BD + (status + {_STATUSES // 2}L)"
    page = "struct(map_entries(response.headers) as headers, response.protocol, response.status)"
    marked = facts.selectExpr(
        *keys,
        "final_url",
        EVENT_TIME,
        f"if(status is null, null, {first}) as first",
        "if(redirected, 1L, 0L) as redirects",
        "if(unreadable, 1L, 0L) as unreadables",
        "if(landed, seq, null) as page_seq",
        f"if(landed, {page}, null) as page",
    )
    # All events: numbers only, in a hash aggregation. Each landed page is a group of its own, all
    # other events of a load are one, so headers move only with landed pages.
    numbers = [
        F.min("first").alias("first"),
        F.sum("redirects").alias("redirects"),
        F.sum("unreadables").alias("unreadables"),
        F.max(EVENT_TIME).alias(EVENT_TIME),
    ]
    counted = marked.groupBy(*keys, "final_url", "page_seq", "page").agg(*numbers)
    folded = counted.groupBy(*keys).agg(
        *numbers, F.expr("max_by(page, page_seq)").alias("page"), F.max("final_url").alias("final_url")
    )
    return folded.selectExpr(
        *keys,
        f"cast(pmod(first, {_STATUSES}BD) - {_STATUSES // 2}L as int) as initial_status",
        "page.status as final_status",
        "cast(redirects as int) as redirect_count",
        f"coalesce({_last_entries('page.headers')}, cast(map() as map<string, string>)) as headers",
        f"coalesce(page.protocol, '{UNKNOWN_PROTOCOL}') as protocol",
        "final_url",
        "unreadables as unreadable_events",
        EVENT_TIME,
    )


# More than there are values of an int.
_STATUSES = 10**10


def _last_entries(entries: str) -> str:
    """SQL: a map of entries in their order; of equal names the last one counts."""
    later = f"exists(slice({entries}, i + 2, size({entries})), x -> x.key = e.key)"
    return f"map_from_entries(filter({entries}, (e, i) -> not {later}))"


def combine_attempts(folded: DataFrame) -> DataFrame:
    """Two page loads (1: http, 2: https) become one scan per institution and platform.

    The https load only counts when the http load did not end in https. ``error`` is null unless
    a needed load is absent or its log unreadable. ``assessment_datetime`` is the time of the last
    event of the load that counts.
    """
    record = f"struct({', '.join(c for c in folded.columns if c not in ATTEMPT_KEYS)})"
    pairs = folded.groupBy(*SCAN_KEYS).agg(
        F.expr(f"any_value(if(attempt = 1, {record}, null), true)").alias("http"),
        F.expr(f"any_value(if(attempt = 2, {record}, null), true)").alias("https"),
    )
    to_https = is_https("http.final_url")
    return pairs.selectExpr("*", f"if({to_https}, http, https) as used").selectExpr(
        *SCAN_KEYS,
        f"used.{EVENT_TIME} as assessment_datetime",
        "http.initial_status as http_status_code",
        "used.final_status as https_status_code",
        f"{to_https} as redirected_to_https",
        "http.final_url as http_final_url",
        "used.final_url as final_url",
        "used.protocol as protocol_http",
        "used.redirect_count as redirect_count",
        "used.headers as headers",
        f"""case when http is null then '{NO_HTTP_LOAD}'
                 when not {to_https} and https is null then '{NO_HTTPS_LOAD}'
                 when http.unreadable_events > 0 or used.unreadable_events > 0
                 then 'unreadable log event' end as error""",
    )


def join_source(scans: DataFrame, source: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Put scans next to their source row: language and the same-domain flag need it.

    ``source`` holds ``country`` and ``Url`` besides the key; one row per institution.
    """
    same_domain = stays_on_domain(host_of("Url"), "http_final_url")
    return (
        attach(scans, source, [ID])
        .selectExpr(
            "*",
            f"{accept_language('country', dict(policy.languages))} as idioma",
            f"{same_domain} as redirected_https_to_same_domain",
        )
        .drop("http_final_url")
    )
