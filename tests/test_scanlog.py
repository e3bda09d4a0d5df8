import json
import random

from pyspark.sql import functions as F

from sitegrade.operators.scanlog import combine_attempts, fold_scan_log, join_source

SCHEMA = "ETER_ID string, platform string, attempt int, seq long, final_url string, message string"


def event(method, **params):
    return json.dumps({"message": {"method": method, "params": params}})


def request(status):
    redirect = {} if status is None else {"redirectResponse": {"status": status}}
    return event("Network.requestWillBeSent", **redirect)


def response(url, status, headers=None, **more):
    return event("Network.responseReceived", response={"url": url, "status": status, "headers": headers or {}, **more})


def logs(spark, loads):
    rows = [
        (*key, seq, final, message)
        for key, final, messages in loads
        for seq, message in enumerate(messages)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_fold(spark):
    loads = [
        (("A", "desktop", 1), "https://a.de/", [
            request(None), request(301), request(200), request(302),
            response("https://a.de/", 200, {"Server": "one"}, protocol="h2"),
            response("https://cdn/", 404, {"Server": "cdn"}, protocol="h3"),
            response("https://a.de/", 503, {"server": "two"}, protocol=""),
        ]),
        (("A", "desktop", 2), "https://a.de/", [response("https://a.de/", 204), event("Network.loadingFailed")]),
        (("A", "mobile", 1), "http://a.de/", [event("Page.other")]),
        (("B", "mobile", 1), "http://b.de/", [
            event("Network.requestWillBeSentExtraInfo"), "not json",
            response("http://b.de/", None), response("http://b.de/", 200, protocol="http/1.1")]),
    ]
    got = {(r.ETER_ID, r.platform, r.attempt): r for r in fold_scan_log(logs(spark, loads)).collect()}
    first = got[("A", "desktop", 1)]
    assert (first.initial_status, first.final_status, first.redirect_count) == (301, 503, 2)
    assert (first.headers, first.protocol) == ({"server": "two"}, "")
    second = got[("A", "desktop", 2)]
    assert (second.initial_status, second.protocol, second.headers) == (204, "Unknown", {})
    third = got[("A", "mobile", 1)]
    assert (third.initial_status, third.final_status, third.redirect_count, third.headers) == (None, None, 0, {})
    fourth = got[("B", "mobile", 1)]
    assert (fourth.initial_status, fourth.protocol, fourth.unreadable_events) == (200, "http/1.1", 1)


def test_combine(spark):
    ok = [response("https://www.a.de/x", 200, {"A": "1"}, protocol="h2")]
    plain = [request(302), response("http://b.de/", 200, protocol="http/1.1")]
    loads = [
        (("A", "desktop", 1), "https://www.a.de/x", [request(301), *ok]),
        (("A", "desktop", 2), "https://www.a.de/x", ["broken"]),
        (("B", "desktop", 1), "http://b.de/", plain),
        (("B", "desktop", 2), "https://b.de/", [response("https://b.de/", 403, {"B": "2"}, protocol="h3")]),
        (("B", "mobile", 1), "http://b.de/", plain),
        (("C", "mobile", 2), "https://c.de/", [response("https://c.de/", 200)]),
        (("D", "mobile", 1), "https://other.de/", [response("https://other.de/", 200), "broken"]),
    ]
    source = spark.createDataFrame(
        [("A", "de", "http://a.de:80/start"), ("B", "xx", "b.de"), ("C", "fr", "c.de"), ("D", "it", "d.de")],
        "ETER_ID string, country string, Url string",
    )
    scans = join_source(combine_attempts(fold_scan_log(logs(spark, loads))), source)
    got = {(r.ETER_ID, r.platform): r for r in scans.collect()}
    a = got[("A", "desktop")]
    assert (a.http_status_code, a.https_status_code, a.redirected_to_https) == (301, 200, True)
    assert (a.redirected_https_to_same_domain, a.error, a.idioma) == (True, None, "de;en;q=0.6")
    b = got[("B", "desktop")]
    assert (b.http_status_code, b.https_status_code, b.redirected_to_https) == (302, 403, False)
    assert (b.final_url, b.protocol_http, b.headers, b.redirect_count) == ("https://b.de/", "h3", {"B": "2"}, 0)
    assert (b.redirected_https_to_same_domain, b.idioma) == (False, "en")
    assert got[("B", "mobile")].error == "no page load over https"
    assert got[("C", "mobile")].error == "no page load over http"
    assert got[("D", "mobile")].error == "unreadable log event"
    assert got[("D", "mobile")].redirected_https_to_same_domain is False


def test_hot_page_load(spark):
    """A third of all events belong to one page load; the fold equals a plain loop."""
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'HOT', concat('I', id % 500)) as ETER_ID", "'desktop' as platform", "1 as attempt",
        "id as seq", "'http://x/' as final_url", "id % 7 as kind", "cast(300 + id % 150 as int) as status",
    )
    message = F.expr(
        """to_json(named_struct('message', named_struct('method',
        if(kind < 4, 'Network.requestWillBeSent', 'Network.responseReceived'), 'params',
        if(kind < 4, named_struct('redirectResponse', named_struct('status', status), 'response', null),
        named_struct('redirectResponse', null, 'response', named_struct('url', 'http://x/', 'status', status))))))"""
    )
    folded = fold_scan_log(rows.withColumn("message", message).drop("kind", "status"))
    hot = folded.filter("ETER_ID = 'HOT'").first()
    events = [(i, i % 7, 300 + i % 150) for i in range(0, 30_000, 3)]
    counted = [s for _, kind, s in events if kind < 4 and 300 <= s < 400]
    first = next(s for _, kind, s in events if kind >= 4 or 300 <= s < 400)
    last = [s for _, kind, s in events if kind >= 4][-1]
    assert (hot.redirect_count, hot.initial_status, hot.final_status) == (len(counted), first, last)
    assert folded.count() == rows.select("ETER_ID").distinct().count()
