from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sitegrade.functions import labels, numeric, urls
from sitegrade.operators.assess import assess_headers, assess_values
from sitegrade.policy import DEFAULT_POLICY, Policy


def one_column(spark, values, sql):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.selectExpr("i", f"{sql} as y").orderBy("i").collect()]


URLS = [
    "https://www.a.de:443/x", "www.x.de?q=1", "http://http://a.b/c", "http://u@www.a.de/", "WWW.a.de",
    "//www.b.de/p", "https://www.a.de#top", "a.de:80", "https://A.de/p;q?x", "www.c.de/a;b", "",
    "ftp://f.org/x", "https://https://x.y/z", "http://b.de?next=https://c.de/",
]


def test_host(spark):
    hosts = [
        "www.a.de", "www.x.de?q=1", "a.b", "u@www.a.de", "WWW.a.de", "", "www.a.de#top", "a.de", "A.de",
        "www.c.de", "", "ftp", "x.y", "b.de?next=c.de",
    ]
    assert one_column(spark, URLS, urls.host_of("x")) == hosts


def test_domain(spark):
    domains = [
        "a.de", "x.de", "http", "u@www.a.de", "WWW.a.de", "b.de", "a.de", "80", "A.de", "c.de/a", "",
        "f.org", "https", "b.de",
    ]
    assert one_column(spark, URLS, urls.domain_of("x")) == domains


def test_probe_urls_and_flags(spark):
    df = spark.createDataFrame(
        [("a.de", "https://www.a.de/"), ("a.de", "http://a.de/"), ("a.de", "https://b.de/"), ("a.de", None)],
        "host string, final string",
    )
    rows = df.selectExpr(
        urls.http_url("host"), urls.https_url("host"), urls.is_https("final"), urls.stays_on_domain("host", "final")
    ).collect()
    assert tuple(rows[0]) == ("http://a.de", "https://a.de", True, True)
    assert [tuple(r)[2:] for r in rows[1:]] == [(False, False), (True, False), (False, False)]


STRONG = {
    "x-xss-protection": (["1; mode=block", "x 1; MODE=block y"], ["1", "0", "1;mode=block"]),
    "x-frame-options": (["DENY", "SameOrigin"], ["deny ", "ALLOW-FROM x"]),
    "x-content-type-options": (["nosniff", "NoSniff"], ["nosniff, nosniff"]),
    "referrer-policy": (
        ["no-referrer", "same-origin", "Strict-Origin-When-Cross-Origin"],
        ["origin", "no-referrer, same-origin"],
    ),
    "access-control-allow-origin": (["https://a.example"], ["*", "NULL", "https://*.a"]),
    "content-security-policy": (
        [],
        [
            "frame-ancestors 'self'",
            "default-src 'self'; form-action 'self'; object-src 'none'; upgrade-insecure-requests;"
            " block-all-mixed-content; frame-ancestors 'none'",
        ],
    ),
    "cross-origin-resource-policy": (["same-origin", "SAME-SITE"], ["cross-origin"]),
    "cross-origin-embedder-policy": (["require-corp", "credentialless"], ["unsafe-none"]),
    "cross-origin-opener-policy": (["same-origin", "same-origin-allow-popups"], ["unsafe-none"]),
    "set-cookie": (
        ["a=1; Secure; HttpOnly; SameSite=Lax", "secure;httponly;samesite=strict"],
        ["a=1; Secure; HttpOnly", "HttpOnly; SameSite=Lax", "Secure; HttpOnly; SameSite=None"],
    ),
}


def assess_one(spark, header, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    by_header = {h: "x" if h == header else "cast(null as string)" for h in DEFAULT_POLICY.headers}
    rows = assess_values(df, by_header).orderBy("i").collect()
    return [(r[f"{header}_presence"], r[f"{header}_config"], r["header_error"]) for r in rows]


@pytest.mark.parametrize("header", STRONG)
def test_rules(spark, header):
    strong, weak = STRONG[header]
    got = assess_one(spark, header, [*strong, *weak, "Missing", None])
    expected = [(True, "Strong", None)] * len(strong) + [(True, "Weak", None)] * len(weak)
    assert got == expected + [(False, "Missing", None)] * 2


AGES = {
    "Strong": [
        "31536000", "\u009331536000\u0093", "0031536000", "9" * 60, "63072000, ", " 31536000 ", "31,536,000",
        "+31536000", "3153_6000", "9" * 10_000, "9" * 1_000_000, "1_" * 5_000 + "1",
    ],
    "Weak": [
        "31535999", " 1 ,", "1_000", "+5", "-99999999999", "000", "-1", "-" + "9" * 10_000, "0" * 1_000_000,
    ],
    None: [
        "_1", "3.5", '"31536000"', "", "31536000 includesubdomains", "1__0", "1e9", "1_", "+", "-", "+-1", "_",
        "9" * 1_000_000 + "x", "1" * 10_000 + "__1", ",", "soon",
    ],
}


def test_max_age(spark):
    numbers = [(label, n) for label, listed in AGES.items() for n in listed]
    values = [f"max-age={n}; includeSubDomains" for _, n in numbers]
    error = "unreadable value of strict-transport-security"
    for (label, number), got in zip(numbers, assess_one(spark, "strict-transport-security", values)):
        if label is None:
            assert got[2] == error, number[:40]
        else:
            assert got == (True, label, None), number[:40]
    others = ["max-age=31536000, max-age=0; includeSubDomains", "includeSubDomains", "max-age=31536000; preload"]
    labels = [(True, "Strong", None), (True, "Weak", None), (True, "Weak", None)]
    assert assess_one(spark, "strict-transport-security", others) == labels


def test_mixed_case_policy(spark):
    from sitegrade.functions import rules

    policy = Policy(
        rules={"Permissions-Policy": rules.contains_all("camera={()}", "x")},
        helpers={},
        unreadable={},
        deprecated=(),
        critical=("Permissions-POLICY",),
        multipliers={"PERMISSIONS-policy": 0.5},
    )
    df = spark.sql("select map('PERMISSIONS-Policy', 'X Camera={()}') as headers union all select map('a', 'b')")
    rows = assess_headers(df, policy=policy).collect()
    got = sorted((r["permissions-policy_presence"], r["permissions-policy_config"]) for r in rows)
    assert got == [(False, "Missing"), (True, "Strong")]
    assert policy.role("permissions-policy") == "critical"
    assert policy.header_points("permissions-policy", "strong") == 70.0


def test_mean_does_not_depend_on_size_or_order(spark):
    rows = [(i, i % 4000, ((i * 7919) % 10_000) / 100) for i in range(12_000)]
    df = spark.createDataFrame(rows, "i int, k int, x double")
    mean = F.expr(numeric.order_free_mean("x")).alias("m")
    once = {r.k: r.m for r in df.groupBy("k").agg(mean).collect()}
    for times in (2, 1000):
        part = df.filter("k < 100") if times == 1000 else df
        repeated = part.selectExpr("*", f"explode(sequence(1, {times}))").repartition(5)
        assert all(once[r.k] == r.m for r in repeated.groupBy("k").agg(mean).collect())
    exact = {}
    for _, k, x in rows:
        exact.setdefault(k, []).append(Fraction(x))
    assert all(abs(once[k] - float(sum(v) / len(v))) < 1e-12 for k, v in exact.items())
    two = spark.createDataFrame([(k, x) for k in range(2000) for x in (k / 100, 91.07)], "k int, x double")
    assert all(r.m == (r.k / 100 + 91.07) / 2 for r in two.groupBy("k").agg(mean).collect() if r.k >= 400)


def test_header_map_case_and_duplicates(spark):
    df = spark.sql(
        "select map('X-Frame-Options', 'ALLOWALL', 'x-frame-OPTIONS', 'DENY', 'Set-Cookie', 'Missing') as headers"
    )
    row = assess_headers(df).first()
    assert (row["x-frame-options_presence"], row["x-frame-options_config"]) == (True, "Strong")
    assert (row["set-cookie_presence"], row["set-cookie_config"]) == (False, "Missing")
    assert row["raw_headers"].startswith('{"X-Frame-Options":"ALLOWALL"')


def test_round2_by_value(spark):
    values = [k / 1000 for k in range(0, 100_000, 5)] + [k / 800 * 100 for k in range(801)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.selectExpr("x", f"{labels.two_decimals('x')} as t").collect()
    wrong = [(r.x, r.t) for r in rows if r.t != f"{r.x:.2f}"]
    assert wrong == []
    assert any(Decimal(v) * 100 % 1 == Decimal("0.5") for v in values)  # real ties are among them


def test_cells_and_names(spark):
    df = spark.createDataFrame([(None,), (0.0,), (100.0,), (12.5,), (0.125,)], "x double")
    assert [r[0] for r in df.selectExpr(labels.cell("x")).collect()] == ["-", "-", "100", "12.50", "0.12"]
    df = spark.createDataFrame([(2.5,), (0.0,), (0.4,)], "x double")
    assert [r[0] for r in df.selectExpr(labels.whole_cell("x")).collect()] == ["2", "-", "0"]
    assert one_column(spark, ["de", "es"], labels.country_name("x")) == ["Germany", "es"]
    assert one_column(spark, ["Italy", "es"], labels.country_code("x")) == ["it", "es"]
    languages = dict(DEFAULT_POLICY.languages)
    assert one_column(spark, ["fr", "es"], labels.accept_language("x", languages)) == ["fr;en;q=0.6", "en"]
    metric = ["critical_header_inconsistency_between_platforms"]
    assert one_column(spark, metric, labels.metric_label("x")) == ["Critical Header Inconsistency"]
    assert one_column(spark, metric, labels.column_label("x")) == ["Critical Header"]
    assert labels.glossary_name("content-security-policy") == r"\gls{csp}"


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (5, 0), (2, None)], "a long, b long")
    assert [r[0] for r in df.selectExpr(numeric.percent("a", "b")).collect()] == [33.33, 0.0, 0.0, 0.0]
