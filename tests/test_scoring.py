import random

import pytest
from helpers import CSP, H, HSTS, XCTO, expected_scores, observations

from sitegrade.operators import scoring
from sitegrade.operators.assess import split_errors
from sitegrade.policy import DEFAULT_POLICY
from sitegrade.schemas import INCONSISTENCY_COLUMNS


def scores(spark, rows, **kwargs):
    df = scoring.final_scores(observations(spark, rows), **kwargs)
    return {(r.ETER_ID, r.platform): r for r in df.collect()}


def test_header_points_table():
    expected = {"x-xss-protection": (9.33, 5.67, 6.67), XCTO: (15.56, 9.44, 11.11), HSTS: (28.0, 17.0, 20.0),
                CSP: (23.33, 14.17, 16.67), "cross-origin-opener-policy": (20.22, 12.28, 14.44)}
    for header, points in expected.items():
        assert tuple(DEFAULT_POLICY.header_points(header, x) for x in ("strong", "weak", None)) == points
    assert round(sum(DEFAULT_POLICY.header_points(h, "strong") for h in H), 2) == 192.89


PAIR = [{"platform": "desktop"}, {"platform": "mobile"}]


@pytest.mark.parametrize(
    "labels, flags, header_score",
    [
        (({XCTO: "Strong"}, {XCTO: "Strong"}), (False, False), 17.12),
        (({XCTO: "Strong"}, {XCTO: "Weak"}), (False, True), 12.13),
        (({HSTS: "Strong"}, {HSTS: "Weak"}), (True, True), 42.45),
        (({HSTS: "Strong"}, {}), (True, True), 26.41),
    ],
)
def test_consistency_penalties(spark, labels, flags, header_score):
    rows = [{**p, "labels": l} for p, l in zip(PAIR, labels)]
    for row in scores(spark, rows).values():
        assert (row[INCONSISTENCY_COLUMNS[0]], row[INCONSISTENCY_COLUMNS[1]]) == flags
        assert row.header_component_score == header_score


def test_redirects(spark):
    rows = [
        {"redirected_to_https": True, "redirected_https_to_same_domain": False},
        {"platform": "mobile", "redirected_to_https": False, "redirected_https_to_same_domain": False},
    ]
    row = scores(spark, rows)[("A", "desktop")]
    assert (row.redirect_score_by_platform, row.redirect_avg_score_btw_platforms) == (70.0, 35.0)
    assert row.redirect_inconsistency_between_platforms
    assert row.redirect_component_score == 30.87


def test_http_component(spark):
    rows = [
        {"ETER_ID": "A"}, {"ETER_ID": "A", "platform": "mobile", "final_url": "http://a.de/"},
        {"ETER_ID": "B", "protocol_http": "H3"}, {"ETER_ID": "C", "final_url": "ftp://x", "protocol_http": "quic"},
    ]
    got = {
        (r.ETER_ID, r.platform): r for r in scoring.http_scores(observations(spark, rows)).collect()
    }
    assert got[("A", "desktop")].http_score_by_platform == 84.62
    assert got[("A", "mobile")].http_score_by_platform == 1.0
    assert got[("A", "mobile")].http_component_score == 0.09  # 42.81 * 0.002
    assert got[("B", "desktop")].http_component_score == 100.0
    assert got[("C", "desktop")].unknown_scheme and got[("C", "desktop")].unknown_protocol


def test_missing_id_has_no_institution_values(spark):
    got = scores(spark, [{"ETER_ID": None}, {"ETER_ID": "A", "platform": "mobile"}])
    row = got[(None, "desktop")]
    assert row.header_avg_score_btw_platforms is None and row.final_score is None and row.grade is None
    assert got[("A", "mobile")].final_score is not None
    worst = scoring.worst_observation(scoring.final_scores(observations(spark, [{"ETER_ID": None}])))
    assert worst.count() == 0


def test_grades(spark):
    values = [0.0, 19.99, 20.0, 35.0, 50.0, 65.0, 80.0, 100.0, 101.0, -0.01, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.selectExpr(scoring.grade("x")).collect()]
    assert got == ["F", "F", "E", "D", "C", "B", "A", "A", None, None, None]


def random_rows(n_institutions, seed, hot=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n_institutions):
        base = {h: rng.choice(["Strong", "Weak", None]) for h in H}
        for platform in ("desktop", "mobile"):
            labels = {h: label for h, label in base.items() if label}
            if rng.random() < 0.3:
                labels[rng.choice(H)] = "Weak"
            to_https = rng.random() < 0.8
            rows.append({"ETER_ID": f"I{k}", "platform": platform, "labels": labels, "to_https": to_https,
                         "same": to_https and rng.random() < 0.7,
                         "protocol": rng.choice(["h2", "h3", "http/1.1", "H2"])})
    for i in range(hot):
        rows.append({**rows[i % 20], "ETER_ID": "HOT", "platform": rng.choice(["desktop", "mobile"])})
    return rows


def as_input(rows):
    return [
        {"ETER_ID": r["ETER_ID"], "platform": r["platform"], "labels": r["labels"], "protocol_http": r["protocol"],
         "redirected_to_https": r["to_https"], "redirected_https_to_same_domain": r["same"]}
        for r in rows
    ]


def test_against_plain_loops(spark):
    rows = random_rows(150, seed=3)
    got = {key: r.final_score for key, r in scores(spark, as_input(rows)).items()}
    assert got == expected_scores(rows, 2)


def test_worst_scores_equals_worst_observation(spark):
    df = observations(spark, as_input(random_rows(150, seed=5, hot=300)))
    columns = ["country", "protocol_http", f"{HSTS}_config"]
    kept = ["ETER_ID", "platform", "country", "protocol_http", f"`{HSTS}_config`", "final_score", "grade",
            "header_component_score", "redirect_component_score", *INCONSISTENCY_COLUMNS]
    slow = scoring.worst_observation(scoring.final_scores(df)).select(*kept)
    fast = scoring.worst_scores(df, columns).select(*kept)
    single = "ETER_ID <> 'HOT'"
    assert sorted(map(tuple, slow.filter(single).collect())) == sorted(map(tuple, fast.filter(single).collect()))
    # Several rows of the hot key agree in score and platform; any of them is the worst row.
    shared = ["platform", "final_score", "grade", "redirect_component_score", *INCONSISTENCY_COLUMNS]
    hot = [tuple(t.filter("ETER_ID = 'HOT'").select(*shared).first()) for t in (slow, fast)]
    assert hot[0] == hot[1]


def test_partitioning_does_not_change_results(spark):
    """Shuffled input, other partition counts, one key with most rows."""
    rows = as_input(random_rows(40, seed=7, hot=400))
    results = []
    for seed, parts in ((1, 1), (2, 5), (3, 13)):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = observations(spark, shuffled).repartition(parts)
        got = scoring.final_scores(df).select("ETER_ID", "platform", "protocol_http", "final_score")
        worst = scoring.worst_scores(df, ["protocol_http"]).select("ETER_ID", "platform", "final_score")
        results.append((sorted(map(tuple, got.collect())), sorted(map(tuple, worst.collect()))))
    assert results[0] == results[1] == results[2]


def test_error_split(spark):
    rows = [("A", "desktop", None), ("A", "mobile", "x"), ("B", "desktop", "x"), ("B", "mobile", None),
            ("C", "desktop", "x"), ("C", "mobile", "y"), ("D", "desktop", None), (None, "mobile", None),
            (None, "mobile", "z")]
    df = spark.createDataFrame(rows, "ETER_ID string, platform string, problem string")
    results, errors = split_errors(df, "problem")
    key = lambda r: (r[0] or "", r[1], r[2] or "")
    assert sorted(map(tuple, results.select("ETER_ID", "platform", "problem").collect()), key=key) == [
        (None, "mobile", None), ("A", "desktop", None), ("D", "desktop", None)]
    assert sorted(map(tuple, errors.select("ETER_ID", "platform", "error").collect()), key=key) == [
        (None, "mobile", "z"), ("A", "mobile", "x"), ("B", "desktop", "x"), ("C", "desktop", "x")]


def test_flags_for_any_label(spark):
    """Labels in another case or of another policy are values of their own."""
    pairs = {
        "case": ("strong", "weak", True), "same case": ("strong", "strong", False), "mixed": ("Strong", "strong", True),
        "foreign": ("odd", "odder", True), "same foreign": ("odd", "odd", False), "with known": ("odd", "Weak", True),
    }
    rows = [
        {"ETER_ID": key, "platform": platform, "labels": {CSP: label}}
        for key, (one, two, _) in pairs.items()
        for platform, label in (("desktop", one), ("mobile", two))
    ]
    df = observations(spark, rows)
    for scored in (scoring.final_scores(df), scoring.worst_scores(df, ["country"])):
        got = {r.ETER_ID: (r[scoring.CRITICAL_FLAG], r[scoring.HEADER_FLAG]) for r in scored.collect()}
        assert got == {key: (varied, varied) for key, (_, _, varied) in pairs.items()}


def test_platforms_are_counted_in_the_data(spark):
    """One platform only, one of a row without an institution, and the count given by the caller."""
    changes = [{"labels": {CSP: "Weak"}}, {"labels": {}}]
    one = observations(spark, changes)
    assert [r[0] for r in scoring.platform_count(one).collect()] == [1]
    three = observations(spark, [*changes, {"ETER_ID": None, "platform": "tablet"}, {"ETER_ID": "B", "platform": "mobile"}])
    for df, n in ((one, 1), (three, 3)):
        for function in (scoring.final_scores, lambda d, **k: scoring.worst_scores(d, ["country"], **k)):
            counted = function(df).filter("ETER_ID = 'A'").collect()
            given = function(df, n_platforms=n).filter("ETER_ID = 'A'").collect()
            assert counted == given
