"""Inputs of the engine, derived from the given tables with Spark.

An institution is an order; its customer's nation is the region, the nation's region the country.
Header values, protocols and redirects follow from the order key, so that every rule and every
kind of inconsistency occurs. No table is cut: the inputs grow with the given data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrade.operators.assess import assess_values
from sitegrade.schemas import ID, NUTS

FULL_CSP = (
    "default-src 'self'; form-action 'self'; object-src 'none'; upgrade-insecure-requests;"
    " block-all-mixed-content; frame-ancestors 'self'"
)

# The value of every header, from the institution number k and the platform number p; d and s are
# the platform number for some institutions and 0 for the others.
HEADER_VALUES = {
    "x-xss-protection": "case (k * 3 + d) % 5 when 0 then '1; mode=block' when 1 then '0'"
    " when 2 then '1; MODE=block' end",
    "x-frame-options": "case (k * 5 + d) % 6 when 0 then 'DENY' when 1 then 'SAMEORIGIN'"
    " when 2 then 'ALLOWALL' when 3 then 'sameorigin' end",
    "x-content-type-options": "case (k * 7 + d) % 4 when 0 then 'nosniff'"
    " when 1 then 'nosniff, nosniff' when 2 then 'NoSniff' end",
    "referrer-policy": "case (k * 11) % 7 when 0 then 'no-referrer' when 1 then 'unsafe-url'"
    " when 2 then 'same-origin' when 3 then 'origin' end",
    "access-control-allow-origin": "case (k * 13) % 9 when 0 then '*' when 1 then 'null'"
    " when 2 then 'https://a.example' end",
    "strict-transport-security": "case (k * 17 + s) % 8"
    " when 0 then 'max-age=31536000; includeSubDomains' when 1 then 'max-age=31536000'"
    " when 2 then 'max-age=600; includeSubDomains'"
    " when 3 then 'max-age=63072000, ; includeSubDomains; preload'"
    " when 4 then 'includeSubDomains'"
    " when 5 then case when k % 31 = 0 then 'max-age=\"31536000\"' when k % 29 = 0 then 'max-age='"
    " when k % 23 = 0 then 'max-age=1__0' when k % 19 = 0 then 'max-age=+31_536_000; includeSubDomains'"
    " when k % 17 = 0 then 'max-age=-31536000; includeSubDomains'"
    " when k % 13 = 0 then 'Max-Age=00031536000 ; IncludeSubDomains; x' end end",
    "content-security-policy": "case (k * 19) % 8 when 0 then \"default-src 'self'\""
    f" when 1 then \"frame-ancestors 'none'\" when 2 then \"{FULL_CSP}\""
    f" when 3 then \"{FULL_CSP}; 'unsafe-eval'\" end",
    "cross-origin-resource-policy": "case (k * 23) % 10 when 0 then 'same-origin'"
    " when 1 then 'cross-origin' end",
    "cross-origin-embedder-policy": "case (k * 29) % 11 when 0 then 'require-corp'"
    " when 1 then 'unsafe-none' end",
    "cross-origin-opener-policy": "case (k * 31) % 12 when 0 then 'same-origin'"
    " when 1 then 'unsafe-none' end",
    "set-cookie": "case k % 13 when 0 then 'a=1; Secure; HttpOnly; SameSite=Lax'"
    " when 1 then 'a=1; Secure' end",
}


PLATFORMS = ("desktop", "mobile", "tablet")

# The columns read of each table. A given schema saves reading file footers to infer one.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_returnflag string, l_linestatus string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "pages": "page_id bigint, url string",
    "documents": "doc_id bigint, lang string, source string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, ETER_ID, NUTS2_Label_2016, country, Category. Joins carry no hint: Spark checks sizes."""
    orders = table(spark, sf_dir, "orders").drop("o_totalprice")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(places, customer.c_nationkey == places.n_nationkey)
        .selectExpr(
            "o_orderkey as k",
            f"o_orderkey as {ID}",
            f"n_name as {NUTS}",
            "lower(substr(r_name, 1, 2)) as country",
            "if(c_mktsegment in ('BUILDING', 'HOUSEHOLD'), 'private', 'public') as Category",
        )
    )


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per institution and platform with one value column per header (``h_0`` ...).

    Some institutions have a third platform that no policy names; some rows have no institution
    number, region, category, protocol or known scheme.
    """
    platforms = ", ".join(f"struct({p} as p, '{name}' as platform)" for p, name in enumerate(PLATFORMS))
    rows = institutions(spark, sf_dir).selectExpr("*", f"inline(array({platforms}))")
    rows = rows.filter("not (k % 101 = 0 and p = 1) and (p < 2 or k % 43 = 0)").selectExpr(
        "*",
        "if(k % 50 = 0, p, 0) as d",
        "if(k % 61 = 0, p, 0) as e",
        "if(k % 37 = 0, p, 0) as g",
        "if(k % 300 = 0, p, 0) as s",
    )
    return rows.selectExpr(
        f"if(k % 71 = 0, null, {ID}) as {ID}",
        f"if(k % 83 = 0, null, {NUTS}) as {NUTS}",
        "country",
        "if(k % 73 = 0, null, Category) as Category",
        "platform",
        "(k + e) % 10 < 7 as redirected_to_https",
        "(k + e) % 10 < 7 and (k + e) % 4 <> 0 as redirected_https_to_same_domain",
        "if(k % 67 = 0, null, elt(cast((k + g) % 7 as int) + 1, 'h3', 'h2', 'H2', 'http/1.1', 'h2', 'http/1.0',"
        " 'spdy/3')) as protocol_http",
        "case when (k + e) % 11 = 0 then 'http://site' when k % 53 = 0 then 'ftp://site'"
        " when k % 59 = 0 then null else 'https://site' end as final_url",
        *[f"{value} as h_{i}" for i, value in enumerate(HEADER_VALUES.values())],
    )


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with presence and label columns and ``header_error``."""
    values = {h: f"h_{i}" for i, h in enumerate(HEADER_VALUES)}
    return assess_values(raw_observations(spark, sf_dir), values).drop(*values.values())


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable observation."""
    return assessed(spark, sf_dir).filter("header_error is null").drop("header_error")


def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser log messages: one per event, of one page load per user, platform and attempt."""
    loads = table(spark, sf_dir, "events").selectExpr(
        "*",
        "cast(event_id % 2 + 1 as int) as attempt",
        "if(floor(event_id / 2) % 2 = 0, 'desktop', 'mobile') as platform",
    )
    secure = (
        "if(user_id % 5 = 1, concat('https://other.example/u', user_id),"
        " concat('https://www.u', user_id, '.example/'))"
    )
    plain = "concat('http://u', user_id, '.example/')"
    loads = loads.selectExpr(
        "*", f"if(attempt = 2 or user_id % 3 <> 0, {secure}, {plain}) as final_url"
    )
    method = """case event_type when 'click' then 'Network.requestWillBeSent'
        when 'signup' then 'Network.requestWillBeSent' when 'view' then 'Network.responseReceived'
        when 'purchase' then 'Network.responseReceivedExtraInfo' else 'Network.loadingFailed' end"""
    redirect = """case event_type when 'click' then named_struct('status', int(event_id % 8 + 301))
        when 'signup' then named_struct('status', 200) end"""
    headers = """map('Server', event_type, 'X-Frame-Options', 'ALLOWALL',
        'x-frame-options', if(event_id % 2 = 0, 'DENY', 'none'), 'Strict-Transport-Security',
        if(event_id % 40 = 7, 'max-age=soon', 'max-age=63072000; includeSubDomains'))"""
    response = f"""if(event_type in ('view', 'purchase'), named_struct(
        'url', if(event_type = 'view', final_url, 'https://cdn.example/a.js'),
        'status', case event_id % 3 when 0 then 200 when 1 then 404 else 500 end,
        'protocol', case event_id % 4 when 0 then 'h2' when 1 then 'h3' end,
        'headers', {headers}), null)"""
    message = f"""named_struct('message', named_struct('method', {method},
        'params', named_struct('redirectResponse', {redirect}, 'response', {response})))"""
    return loads.selectExpr(
        f"user_id as {ID}",
        "platform",
        "attempt",
        "event_id as seq",
        "ts as logged_at",
        "final_url",
        f"to_json({message}) as message",
    )


def scanned_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source list of the log view: one row per user."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.selectExpr(
        f"user_id as {ID}",
        "elt(cast(user_id % 4 as int) + 1, 'de', 'fr', 'it', 'es') as country",
        "concat('http://u', user_id, '.example:80/start') as Url",
    )
