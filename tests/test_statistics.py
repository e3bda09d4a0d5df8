"""Published country figures: counts go in as rows, percentages and table texts come out."""

from helpers import H, observations
from pyspark.sql import functions as F

from sitegrade.operators import statistics
from sitegrade.operators.summary import flag_counts, header_counts, score_sums, summarize, version_counts
from sitegrade.plans import charts, tables
from sitegrade.policy import DEFAULT_POLICY
from sitegrade.schemas import INCONSISTENCY_COLUMNS, config_col, presence_col

ORDER = ["XXP", "XFO", "XCTO", "RP", "CORS", "HSTS", "CSP", "CORP", "COEP", "COOP"]
# present/weak counts per country, in ORDER
COUNTS = {
    "de": (398, "140/13 186/23 286/34 129/62 29/17 237/166 115/115 2/0 1/1 4/0"),
    "fr": (345, "74/8 171/15 186/17 57/28 25/21 150/100 49/49 1/1 1/1 1/1"),
    "it": (206, "28/5 76/2 66/4 24/7 10/5 43/24 18/18 11/0 10/0 14/1"),
}
ADOPTION = [
    "Germany 35.18 46.73 71.86 32.41 7.29 59.55 28.89 0.50 0.25 1.01",
    "France 21.45 49.57 53.91 16.52 7.25 43.48 14.20 0.29 0.29 0.29",
    "Italy 13.59 36.89 32.04 11.65 4.85 20.87 8.74 5.34 4.85 6.80",
]
VERSIONS = {"de": (0, 261, 135, 1), "fr": (3, 202, 140, 0), "it": (4, 130, 72, 0)}
VERSION_ROWS = ["Italy 1.94 63.11 34.95 -", "France 0.87 58.55 40.58 -", "Germany - 65.74 34.01 0.25"]


def published_rows(spark):
    """One row per institution; the i-th institution has a header when i is below its count."""
    names = {h: s for h, s in zip(H, ["XXP", "XFO", "XCTO", "RP", "CORS", "HSTS", "CSP", "CORP", "COEP", "COOP", "SC"])}
    parts = []
    for country, (total, counts) in COUNTS.items():
        pairs = dict(zip(ORDER, ([int(n) for n in c.split("/")] for c in counts.split())))
        pairs["SC"] = [0, 0]
        columns = []
        for h, short in names.items():
            present, weak = pairs[short]
            columns.append(f"id < {present} as `{presence_col(h)}`")
            columns.append(
                f"case when id < {weak} then 'Weak' when id < {present} then 'Strong' else 'Missing' end"
                f" as `{config_col(h)}`"
            )
        h3, h2, h11, h10 = VERSIONS[country]
        protocol = (f"case when id < {h3} then 'h3' when id < {h3 + h2} then 'h2' when id < {h3 + h2 + h11}"
                    f" then 'http/1.1' when id < {h3 + h2 + h11 + h10} then 'http/1.0' else 'Unknown' end")  # fmt: skip
        parts.append(
            spark.range(total).selectExpr(
                "cast(id as string) as ETER_ID", f"'{country}' as country", "'R' as NUTS2_Label_2016",
                "if(id % 2 = 0, 'public', 'private') as Category", "'desktop' as platform",
                f"{protocol} as protocol_http", *columns,
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def printed(table, label, columns):
    rows = table.filter("scope = 'country'").orderBy("row_no", "col_no").collect()
    lines = {}
    for r in rows:
        lines.setdefault((r.row_no, r.country_name), {})[r[label]] = r.cell
    return [" ".join([name, *(cells[c] for c in columns)]) for (_, name), cells in sorted(lines.items())]


def test_published_adoption_table(spark):
    stats = statistics.adoption_stats(summarize(published_rows(spark), header_counts()))
    table = tables.adoption_table(stats)
    assert printed(table, "short_name", ORDER) == ADOPTION
    assert table.filter("short_name = 'SC'").count() == 0
    weak = tables.adoption_table(stats, weak=True).filter("scope = 'country'")
    csp = [r.percent for r in weak.filter("short_name = 'CSP'").collect()]
    assert csp == [100.0] * 3
    # all three tie in CSP; HSTS weak share ascending decides
    order = [r.country for r in weak.filter("short_name = 'HSTS'").orderBy("row_no").collect()]
    assert order == ["it", "fr", "de"]
    wide = tables.widen(table, [*ORDER, "SC"]).filter("scope = 'country'").orderBy("row_no").collect()
    assert [" ".join([r.country_name, *(r[c] for c in ORDER)]) for r in wide] == ADOPTION


def test_published_version_table(spark):
    stats = statistics.http_version_stats(summarize(published_rows(spark), version_counts()))
    table = tables.http_version_table(stats)
    names = ["http/3", "http/2", "http/1.1", "http/1.0"]
    assert printed(table, "version", names) == VERSION_ROWS
    germany = stats.filter("country = 'de'").first()
    assert germany.total_schools_country == 397
    assert table.filter("scope = 'region' and country = 'de' and version = 'http/3'").count() == 0


def test_null_keys_drop_only_their_levels(spark):
    rows = [
        {"ETER_ID": "A", "NUTS2_Label_2016": None, "labels": {H[0]: "Weak"}},
        {"ETER_ID": "B", "Category": None},
        {"ETER_ID": None, "country": "de"},
        {"ETER_ID": "C", "country": None},
        {"ETER_ID": "D", "labels": {H[0]: "Strong"}},
    ]
    stats = statistics.adoption_stats(summarize(observations(spark, rows), header_counts()))
    got = {
        (r.level, r.nuts, r.Category, r.platform): (r.total_schools, r[f"{H[0]}_present"])
        for r in stats.collect()
    }
    assert got == {
        ("country", None, None, None): (3, 2),
        ("nuts", "R1", None, None): (2, 1),
        ("nuts_category", "R1", "public", None): (1, 1),
        ("country_category", None, "public", None): (2, 2),
        ("country_platform", None, None, "desktop"): (3, 2),
        ("country_category_platform", None, "public", "desktop"): (2, 2),
    }


def flagged(spark):
    data = [
        ("A", "de", "R1", "public", True, True, False), ("B", "de", "R1", "private", False, True, False),
        ("C", "de", "R2", "public", False, False, False), ("D", "de", None, "public", False, False, True),
        ("E", "de", "R3", None, False, False, False), ("F", "de", "R2", None, False, True, True),
    ]
    schema = "ETER_ID string, country string, NUTS2_Label_2016 string, Category string"
    flags = ", ".join(f"{flag} boolean" for flag in INCONSISTENCY_COLUMNS)
    df = spark.createDataFrame(data, f"{schema}, {flags}")
    return df.withColumn("platform", F.lit("desktop"))


def test_inconsistency_levels(spark):
    stats = statistics.inconsistency_stats(summarize(flagged(spark), flag_counts()))
    got = {(r.nuts, r.Category): r for r in stats.collect()}
    assert set(got) == {("R1", "public"), ("R1", "private"), ("R2", "public"), ("R3", None)}
    header = INCONSISTENCY_COLUMNS[1]
    assert got[("R1", "public")][f"{header}_percent_nuts"] == 100.0
    assert got[("R2", "public")][f"{header}_percent_nuts"] == 50.0
    assert got[("R2", "public")][f"{header}_percent_nuts_category"] == 0.0
    assert {r.total_schools_country for r in got.values()} == {6}
    assert got[("R3", None)].total_schools_nuts_category is None
    table = tables.inconsistency_table(stats)
    regions = table.filter("scope = 'region' and col_no = 1").orderBy("row_no").collect()
    assert [(r.region, r.cell) for r in regions] == [("R1", "50"), ("R2", "-"), ("R3", "-")]
    assert table.filter("scope = 'region_private'").select("region").distinct().count() == 1
    ends = tables.preview(table, head=1, tail=1).filter("scope = 'region' and col_no = 1")
    assert sorted((r.part, r.region) for r in ends.collect()) == [("head", "R1"), ("tail", "R3")]
    dots = charts.dot_chart_data(stats).filter("scope = 'region'").orderBy("entity_no").collect()
    # R1 has two category lines, so its percentages count twice
    assert [(r.entity, r.entity_total) for r in dots[::3]] == [("R1", 300.0), ("R2", 100.0), ("R3", 0.0)]


def test_region_scores(spark):
    df = spark.createDataFrame(
        [("A", "de", "R1", 10.05), ("B", "de", "R1", 20.0), ("C", "de", "R2", 90.0), ("D", "de", None, 5.0)],
        "ETER_ID string, country string, NUTS2_Label_2016 string, final_score double",
    ).selectExpr("*", "'public' as Category", "'desktop' as platform")
    table = tables.region_score_table(statistics.region_scores(summarize(df, score_sums())))
    assert [tuple(r) for r in table.orderBy("row_no").collect()] == [
        ("de", "Germany", "R2", 1, 90.0, "90.00"), ("de", "Germany", "R1", 2, 15.025, "15.03")]
    assert f"{15.025:.2f}" == "15.03"


def test_radar_ring_closes(spark):
    rows = [{"platform": p, "labels": {H[0]: "Weak"}} for p in ("desktop", "mobile")]
    rows.append({"country": "fr", "labels": {}})
    stats = statistics.adoption_stats(summarize(observations(spark, rows), header_counts()))
    points = charts.radar_data(stats).filter("Category is null and platform = 'mobile'").orderBy("position").collect()
    assert {r.country for r in points} == {"de"}
    assert len(points) == len(H) + 1
    assert (points[0].header, points[0].angle, points[0].adoption) == (H[0], 0.0, 100.0)
    assert (points[-1].header, points[-1].angle, points[-1].adoption) == (H[0], 0.0, 100.0)
    assert {r.header for r in points if r.role == "critical"} == set(DEFAULT_POLICY.critical)


def test_country_overview(spark):
    rows = [{"ETER_ID": "A"}, {"ETER_ID": "A", "platform": "mobile"}, {"ETER_ID": "B", "NUTS2_Label_2016": "R2"}]
    assert tuple(statistics.country_overview(observations(spark, rows)).first()) == ("de", 3, 2, 2, 2)
