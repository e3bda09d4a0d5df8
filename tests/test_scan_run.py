"""Scan batches, repeatable appends, and score tables that are refreshed in part."""

import datetime
import json
import os

import pytest
from helpers import H, observations
from pyspark.sql import functions as F

from sitegrade.operators.scoring import final_scores, worst_observation
from sitegrade.plans.scan_run import assess_scans, run_scans
from sitegrade.schemas import SOURCE_COLUMNS
from sitegrade.sources import batches, readers, score_store, writers

LOGS = "ETER_ID string, platform string, attempt int, seq long, final_url string, message string, logged_at timestamp_ntz"


def at(second):
    return datetime.datetime(2025, 1, 5, 10, 0, second)


def response(url, status, headers=None, protocol="h2"):
    params = {"response": {"url": url, "status": status, "headers": headers or {}, "protocol": protocol}}
    return json.dumps({"message": {"method": "Network.responseReceived", "params": params}})


def source_list(spark, keys):
    rows = [(k, f"Uni {k}", "public", "x", "no", f"{k.lower()}.de", *[f"R{k}"] * 6, "de") for k in keys]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*SOURCE_COLUMNS, "country")))


def logs(spark, tmp_path, name, loads):
    """Stored logs, so that plans show how often they are read."""
    rows = [
        (key, platform, attempt, seq, url, message, at(second))
        for key, platform, attempt, url, messages in loads
        for seq, (message, second) in enumerate(messages)
    ]
    path = str(tmp_path / name)
    spark.createDataFrame(rows, LOGS).write.parquet(path)
    return spark.read.parquet(path)


def good(key, platform, second, headers=None):
    url = f"https://{key.lower()}.de/"
    return (key, platform, 1, url, [(response(url, 301), second - 1), (response(url, 200, headers), second)])


def test_batches_of_a_scan(spark, tmp_path):
    source = source_list(spark, "ABCD")
    first = logs(
        spark, tmp_path, "logs1",
        [
            good("A", "desktop", 5, {"X-Frame-Options": "DENY"}), good("A", "mobile", 9),
            good("B", "desktop", 7, {"strict-transport-security": "max-age=soon"}), good("B", "mobile", 8),
            ("C", "desktop", 1, "http://c.de/", [("broken", 3)]),
        ],
    )
    out = str(tmp_path / "out")
    todo = run_scans(spark, first, source, out, "pass1")
    results = {(r.ETER_ID, r.platform): r for r in readers.read_observations(spark, f"{out}/results").collect()}
    assert set(results) == {("A", "desktop"), ("A", "mobile")}
    a = results["A", "desktop"]
    assert (a.Name, a.country, a.NUTS2_Label_2016) == ("Uni A", "de", "RA")
    assert (a.assessment_datetime, a.https_status_code, a["x-frame-options_config"]) == (at(5), 200, "Strong")
    assert results["A", "mobile"].assessment_datetime == at(9)
    errors = {r.ETER_ID: r for r in readers.read_errors(spark, f"{out}/errors").collect()}
    assert {k: r.error for k, r in errors.items()} == {
        "B": "unreadable value of strict-transport-security",
        "C": "no page load over https",
        "D": "no page load over http",
    }
    assert errors["D"].Name == "Uni D"
    assert sorted(r.ETER_ID for r in todo.collect()) == ["B", "C", "D"]

    # The same batch once more leaves one copy.
    again = run_scans(spark, first, source, out, "pass1")
    assert readers.read_observations(spark, f"{out}/results").count() == 2
    assert readers.read_errors(spark, f"{out}/errors").count() == 3
    # The next pass works on what is left.
    second = logs(spark, tmp_path, "logs2", [good("B", p, 20) for p in ("desktop", "mobile")])
    rest = run_scans(spark, second, again, out, "pass2")
    assert sorted(r.ETER_ID for r in rest.collect()) == ["C", "D"]
    assert readers.read_observations(spark, f"{out}/results").count() == 4


def test_logs_are_read_and_parsed_once(spark, tmp_path):
    first = logs(spark, tmp_path, "logs", [good("A", "desktop", 5)])
    plan = assess_scans(first, source_list(spark, "A"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.lower().count("from_json") == 1


def test_time_of_the_load_that_counts(spark, tmp_path):
    plain = ("A", "desktop", 1, "http://a.de/", [(response("http://a.de/", 200), 5)])
    secure = ("A", "desktop", 2, "https://a.de/", [(response("https://a.de/", 200), 9), ("{}", 11)])
    used = ("B", "desktop", 1, "https://b.de/", [(response("https://b.de/", 200), 21)])
    unused = ("B", "desktop", 2, "https://b.de/", [(response("https://b.de/", 200), 30)])
    got = assess_scans(logs(spark, tmp_path, "logs", [plain, secure, used, unused]), source_list(spark, "AB"))
    assert {r.ETER_ID: r.assessment_datetime for r in got.collect()} == {"A": at(11), "B": at(21)}


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_repeated_batch(spark, tmp_path, file_format):
    path = str(tmp_path / "p")
    errors = spark.createDataFrame([("A", "de", "x"), ("B", "fr", "y")], "ETER_ID string, country string, error string")
    writers.append_errors(errors, path, file_format=file_format, batch="b-1")
    writers.append_errors(errors.filter("ETER_ID = 'A'"), path, file_format=file_format, batch="b-2")
    writers.append_errors(errors.filter("ETER_ID = 'B'"), path, file_format=file_format, batch="b-1")
    assert set(batches.committed(spark, path)) == {"b-1", "b-2"}
    if file_format == "parquet":
        assert sorted(r.ETER_ID for r in readers.read_errors(spark, path).collect()) == ["A", "B"]
        schema = readers.read_errors(spark, path).schema
        assert [r.ETER_ID for r in batches.read_batches(spark, path, schema, ["b-2", "none"]).collect()] == ["A"]
        assert batches.read_batches(spark, path, schema, ["none"]).count() == 0


def test_unfinished_batch_is_not_read(spark, tmp_path):
    path = str(tmp_path / "p")
    errors = spark.createDataFrame([("A", "de", "x")], "ETER_ID string, country string, error string")
    writers.append_errors(errors, path, batch="one")
    # A write that died before its line in the ledger.
    errors.write.partitionBy("country").parquet(f"{path}/data/batch=two/attempt=lost")
    assert readers.read_errors(spark, path).count() == 1
    writers.append_errors(errors.filter("false"), path, batch="one")
    assert readers.read_errors(spark, path).count() == 0
    with pytest.raises(ValueError):
        writers.append_errors(errors, path, batch="a/b")
    assert batches.committed(spark, str(tmp_path / "nothing")) == {}


def many(spark, keys, labels, platforms=("desktop", "mobile")):
    rows = [
        {"ETER_ID": f"I{i}", "platform": p, "country": ("de", "fr", "o'x", None)[i % 4],
         "labels": {H[i % 11]: labels[i % 2]}}
        for i in keys for p in platforms
    ]
    return observations(spark, rows).withColumn("raw_headers", F.lit("{}"))


def content(df):
    names = sorted(c for c in df.columns if c != "analysis_datetime")
    return sorted(map(repr, df.select(*[f"`{c}`" for c in names]).collect()))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_refresh_equals_a_full_run(spark, tmp_path):
    path, full = str(tmp_path / "store"), str(tmp_path / "full")
    results = str(tmp_path / "results")
    writers.append_results(many(spark, range(40), ("Strong", "Weak")), results, batch="b1")
    store = lambda: readers.read_observations(spark, results)
    assert score_store.refresh_store(spark, store(), store(), path) is None
    # Two institutions get further rows, one is new; the rest stays as it is.
    added = many(spark, [3, 8, 77], ("Weak", "Missing"))
    writers.append_results(added, results, batch="b2")
    before = files(f"{path}/scores")
    replaced = score_store.refresh_store(spark, store(), added, path)
    assert replaced == 3
    kept = files(f"{path}/scores") & before
    assert len(before - kept) in (2, 3) and len(kept) >= len(before) - 3
    score_store.build_store(spark, store(), full)
    for table in ("scores", "worst"):
        got = score_store.read_stored(spark, path, table)
        assert content(got) == content(score_store.read_stored(spark, full, table))
    assert content(score_store.read_stored(spark, path).drop("country")) == content(
        by_schema_scores(store()).drop("country")
    )
    # A new platform changes every score.
    more = many(spark, [5], ("Weak", "Weak"), ("tablet",))
    writers.append_results(more, results, batch="b3")
    assert score_store.refresh_store(spark, store(), more, path) is None
    score_store.build_store(spark, store(), full)
    assert content(score_store.read_stored(spark, path)) == content(score_store.read_stored(spark, full))


def by_schema_scores(df):
    return writers.by_schema(final_scores(df), score_store.scored_schema(H))


def test_refresh_reads_touched_partitions_only(spark, tmp_path):
    results = str(tmp_path / "results")
    writers.append_results(many(spark, range(40), ("Strong", "Weak")), results, batch="b1")
    df = score_store.touched_rows(readers.read_observations(spark, results), [("fr", 3), ("o'x", 9)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "country" in filters and "fr" in filters and "de" not in filters
    assert {r.country for r in df.collect()} <= {"fr", "o'x"}


def test_bucketed_table_needs_no_shuffle(spark, tmp_path):
    scored = final_scores(many(spark, range(40), ("Strong", "Weak")))
    spark.sql("drop table if exists bucketed_scores")
    try:
        score_store.write_bucketed(scored, "bucketed_scores", 4)
        table = spark.table("bucketed_scores")
        worst = worst_observation(table)
        plan = worst._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        means = table.groupBy("ETER_ID").agg(F.avg("final_score").alias("mean"))
        plan = table.hint("merge").join(means, "ETER_ID")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert content(worst.drop("country")) == content(
            worst_observation(by_schema_scores(many(spark, range(40), ("Strong", "Weak")))).drop("country")
        )
    finally:
        spark.sql("drop table if exists bucketed_scores")
