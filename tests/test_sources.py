import csv
import datetime
import os

import pytest
from helpers import H, observations

from sitegrade.operators.repair import repair_shifted_rows
from sitegrade.operators.retry import retry_worklist
from sitegrade.operators.scoring import final_scores, stamp_analysis
from sitegrade.plans.full_run import run_reports
from sitegrade.schemas import SCAN_COLUMNS, SOURCE_COLUMNS, observation_schema
from sitegrade.sources import readers, writers
from sitegrade.sources.csv_files import find_layouts


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)


def test_source_lists(spark, tmp_path):
    site = ["DE1", 'Uni "A", x', "public", "University", "Yes", "www.a.de", "DE1", "Tübingen ", "", "NA", "x", "y"]
    write_csv(tmp_path / "de-2024.csv", SOURCE_COLUMNS, [site])
    # other column order and letter case, an error column with line breaks
    renamed = ["error", *["url" if c == "Url" else c for c in reversed(SOURCE_COLUMNS)]]
    write_csv(tmp_path / "it-errors.csv", renamed, [["Message: a\nStack \"b\"\n", *reversed(["IT1", *site[1:]])]])
    write_csv(tmp_path / "it_2024.csv", SOURCE_COLUMNS, [site])
    write_csv(tmp_path / "ita-2024.csv", SOURCE_COLUMNS, [site])
    got = {r.ETER_ID: r for r in readers.read_source_lists(spark, str(tmp_path)).collect()}
    assert set(got) == {"DE1", "IT1"}
    assert (got["DE1"].country, got["IT1"].country) == ("de", "it")
    assert got["DE1"].Name == 'Uni "A", x' and got["IT1"].Url == "www.a.de"
    assert got["DE1"].NUTS2_Label_2016 == "Tübingen " and got["DE1"].NUTS3 is None
    assert "error" not in readers.read_source_lists(spark, str(tmp_path)).columns


def test_source_list_without_url(spark, tmp_path):
    write_csv(tmp_path / "de-x.csv", ["ETER_ID", "Name"], [["A", "B"]])
    write_csv(tmp_path / "it-x.csv", ["ETER_ID", "URL"], [["C", "c.it"]])
    write_csv(tmp_path / "fr-x.csv", ["ETER_ID", "url", "Url "], [["D", "d.fr", "no"]])
    with pytest.raises(ValueError, match="de-x.csv") as refused:
        readers.read_source_lists(spark, str(tmp_path))
    assert "it-x.csv" not in str(refused.value)
    got = readers.read_source_lists(spark, str(tmp_path), strict=False)
    assert sorted((r.ETER_ID, r.Url, r.country) for r in got.collect()) == [("C", "c.it", "it"), ("D", "d.fr", "fr")]
    report = {os.path.basename(r.file): r.reason for r in readers.source_report(spark, str(tmp_path)).collect()}
    assert report == {"de-x.csv": readers.NO_URL, "it-x.csv": None, "fr-x.csv": None}


@pytest.mark.parametrize("multi_line", [True, False])
def test_damaged_files_are_left_out_whole(spark, tmp_path, multi_line):
    names = ["ETER_ID", "platform", "final_url"]
    write_csv(tmp_path / "de_desktop.csv", names, [["A", "x", "u,\"1\""], ["B", "x"], ["C", "x", ""]])
    write_csv(tmp_path / "fr_desktop.csv", names, [["D", "x", "u"], ["E", "x", "", "more"], ["F", "x", "u"]])
    write_csv(tmp_path / "it_desktop.csv", names, [["G", "x", "", "", "", "end"]])
    (tmp_path / "es_desktop.csv").write_bytes(b"ETER_ID,final_url\nH,caf\xe9\nI,ok\n")
    (tmp_path / "pt_desktop.csv").touch()
    (tmp_path / "nl_desktop.csv").write_bytes(b"\xef\xbb\xbfETER_ID,final_url\r\nJ,ok\r\n")
    (tmp_path / "be desktop_.csv").write_text("ETER_ID\nK\n")
    (tmp_path / "gr_a b%20.csv").write_text("ETER_ID\nL\n")
    got = {r.ETER_ID: r for r in readers.read_results(spark, str(tmp_path), multi_line=multi_line).collect()}
    assert set(got) == {"A", "B", "C", "J", "L"}
    assert got["A"].final_url == 'u,"1"' and got["B"].final_url is None
    report = readers.result_report(spark, str(tmp_path), multi_line).collect()
    assert {os.path.basename(r.file)[:2]: (r.rows, r.damaged_rows, r.reason) for r in report} == {
        "de": (3, 0, None), "fr": (3, 1, "row with more fields than the header"),
        "it": (1, 1, "row with more fields than the header"), "es": (2, 1, "text that is no UTF-8"),
        "pt": (0, 0, "no header line"), "nl": (1, 0, None), "gr": (1, 0, None),
    }


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(1000):
        body = "ETER_ID,final_url\n" if i % 2 else "final_url,ETER_ID\n"
        (tmp_path / f"de_p{i}.csv").write_text(body + f"v{i},w{i}\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        layouts = find_layouts(spark, str(tmp_path), readers.RESULT_FILE)
        # One query: the listing, the first lines, their join and order.
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {k: len(v) for k, v in layouts.items()} == {("ETER_ID", "final_url"): 500, ("final_url", "ETER_ID"): 500}
    assert len(jobs) < 10
    rows = readers.read_results(spark, str(tmp_path)).select("ETER_ID", "final_url", "platform").collect()
    assert sorted(map(tuple, rows)) == sorted(
        ((f"v{i}", f"w{i}") if i % 2 else (f"w{i}", f"v{i}")) + (f"p{i}",) for i in range(1000)
    )


def test_repair_on_reading(spark, tmp_path):
    """Rows shifted by position are mended before the columns are matched by name."""
    names = [f.name for f in observation_schema(H)]
    good = list(result_row("A", "mobile").values())
    bad = list(result_row("B", "mobile").values())
    bad[12:20] = ["mobile", *bad[12:19]]
    write_csv(tmp_path / "de_mobile.csv", names, [good, bad])
    a, b = readers.read_results(spark, str(tmp_path), repair=True).orderBy("ETER_ID").collect()
    assert a.asDict() | {"ETER_ID": "B"} == b.asDict()
    assert b.http_status_code == 301 and b.assessment_datetime is not None
    broken = readers.read_results(spark, str(tmp_path)).filter("ETER_ID = 'B'").first()
    assert broken.assessment_datetime is None


def result_row(key, platform, **changes):
    row = dict.fromkeys([f.name for f in observation_schema(H)], "")
    row |= {
        "ETER_ID": key, "platform": platform, "assessment_datetime": "2025-01-05 10:20:30.123456",
        "http_status_code": "301.0", "https_status_code": "200", "redirected_to_https": "True",
        "redirected_https_to_same_domain": "False", "redirect_count": "1", "raw_headers": "{'A': 'x,\ny'}",
    }
    return row | changes


def test_results(spark, tmp_path):
    first, second = result_row("A", "wrong"), result_row("B", "x", http_status_code="nan")
    write_csv(tmp_path / "de_desktop.csv", first.keys(), [first.values()])
    # fewer columns, other order, further part in the name
    short = {k: second[k] for k in ("platform", "http_status_code", "ETER_ID", "assessment_datetime")}
    write_csv(tmp_path / "fr_mobile_2.csv", short.keys(), [short.values()])
    (tmp_path / "it_mobile.csv").touch()
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    got = {r.ETER_ID: r for r in readers.read_results(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "B"}
    a, b = got["A"], got["B"]
    assert (a.country, a.platform, b.country, b.platform) == ("de", "desktop", "fr", "mobile")
    assert (a.http_status_code, a.https_status_code, a.redirected_to_https) == (301, 200, True)
    assert a.assessment_datetime == datetime.datetime(2025, 1, 5, 10, 20, 30, 123456)
    assert a.raw_headers == "{'A': 'x,\ny'}" and a.redirected_https_to_same_domain is False
    assert b.http_status_code is None and b.final_url is None


def test_no_results(spark, tmp_path):
    empty = readers.read_results(spark, str(tmp_path))
    assert empty.count() == 0 and "country" in empty.columns
    assert final_scores(empty).count() == 0
    assert readers.read_source_lists(spark, str(tmp_path)).count() == 0


def test_append_results(spark, tmp_path):
    path = str(tmp_path / "results")
    one = observations(spark, [{}, {"platform": "mobile"}, {"country": "fr"}])
    writers.append_results(one, path)
    columns = [f"`{c}`" for c in reversed(one.columns)]
    writers.append_results(one.filter("country = 'fr'").select(*columns), path)  # by name
    before = sorted(os.listdir(path))
    writers.append_results(one.filter("country = 'xx'"), path)
    assert sorted(n for n in os.listdir(path) if n.startswith("country")) == ["country=de", "country=fr"]
    assert sorted(os.listdir(path)) == before
    back = readers.read_observations(spark, path)
    assert back.count() == 4 and back.filter("country = 'fr' and platform = 'desktop'").count() == 2
    assert back.schema == observation_schema(H).add("country", "string") or set(back.columns) >= set(one.columns)
    assert back.filter(f"not `{H[0]}_presence`").count() == 4


def test_append_errors(spark, tmp_path):
    errors = spark.createDataFrame([("A", "u", "de", 'x\n"y", z')], "ETER_ID string, Url string, country string, error string")
    writers.append_errors(errors, str(tmp_path / "p"))
    writers.append_errors(errors, str(tmp_path / "p"))
    assert [r.error for r in readers.read_errors(spark, str(tmp_path / "p")).collect()] == ['x\n"y", z'] * 2
    writers.append_errors(errors, str(tmp_path / "c"), file_format="csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert [(r.ETER_ID, r.country, r.error) for r in back.collect()] == [("A", "de", 'x\n"y", z')]


def test_repair(spark):
    names = [*SOURCE_COLUMNS, *SCAN_COLUMNS]
    good = [f"s{i}" for i in range(12)] + ["t", "301", "200", "True", "True", "url", "de", "desktop", "h2", "1"]
    bad = good[:12] + ["mobile", "t", "301", "200", "True", "True", "url", "de", "h2", "1"]
    df = spark.createDataFrame([good, bad], ", ".join(f"{n} string" for n in names))
    first, second = map(list, repair_shifted_rows(df).collect())
    assert first == good
    assert second == good[:19] + ["mobile", "h2", "1"]


def test_retry_worklist(spark):
    source = spark.createDataFrame([(k, f"{k}.de") for k in "ABCDE"] + [(None, "n.de")], "ETER_ID string, Url string")
    errors = spark.createDataFrame([("A",), ("A",), ("B",), *[("C",)] * 10, ("E",), (None,)], "ETER_ID string")
    results = spark.createDataFrame(
        [("A", "desktop"), ("B", "desktop"), ("B", "mobile"), ("D", "mobile"), ("E", None)],
        "ETER_ID string, platform string",
    )
    assert sorted(r.ETER_ID for r in retry_worklist(source, results, errors).collect()) == ["A", "E"]


def test_full_run(spark, tmp_path):
    rows = [
        {"ETER_ID": f"I{i}", "platform": p, "country": c, "NUTS2_Label_2016": f"{c}{i % 3}",
         "Category": ("public", "private")[i % 2], "labels": {H[i % 11]: ("Strong", "Weak")[i % 2]}}
        for i in range(24) for p in ("desktop", "mobile") for c in [("de", "fr")[i % 4 // 2]]
    ]
    out = str(tmp_path / "out")
    observed = observations(spark, rows)
    written = run_reports(spark, observed, out)
    scores = readers.read_scores(spark, written["scores"])
    assert scores.count() == 48 and scores.filter("analysis_datetime is null or grade is null").count() == 0
    worst = readers.read_scores(spark, written["worst_scores"])
    assert worst.count() == 24 and worst.filter("platform = 'desktop'").count() == 24
    for name, path in written.items():
        if name not in ("scores", "worst_scores", "region_scores"):
            assert spark.read.parquet(path).count() > 0, name
    regions = spark.read.option("header", True).csv(written["region_scores"])
    assert regions.count() == 6 and set(regions.columns) == {"NUTS2_Label_2016", "final_score", "country"}
    run_reports(spark, observed, out)
    assert readers.read_scores(spark, written["scores"]).count() == 48
    assert "analysis_datetime" in stamp_analysis(observed).columns
