"""Small observation tables and a plain-Python restatement of the model."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.policy import DEFAULT_POLICY
from sitegrade.schemas import config_col, presence_col

H = DEFAULT_POLICY.headers
HSTS, CSP, XCTO = "strict-transport-security", "content-security-policy", "x-content-type-options"


def observations(spark, rows):
    """``rows``: dicts with any of the columns below; ``labels`` maps header -> label."""
    schema = T.StructType(
        [
            T.StructField("ETER_ID", T.StringType()),
            T.StructField("country", T.StringType()),
            T.StructField("NUTS2_Label_2016", T.StringType()),
            T.StructField("Category", T.StringType()),
            T.StructField("platform", T.StringType()),
            T.StructField("redirected_to_https", T.BooleanType()),
            T.StructField("redirected_https_to_same_domain", T.BooleanType()),
            T.StructField("protocol_http", T.StringType()),
            T.StructField("final_url", T.StringType()),
            T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    base = {
        "ETER_ID": "A", "country": "de", "NUTS2_Label_2016": "R1", "Category": "public",
        "platform": "desktop", "redirected_to_https": True,
        "redirected_https_to_same_domain": True, "protocol_http": "h2",
        "final_url": "https://a.de/", "labels": {},
    }
    table = [tuple({**base, **row}[f.name] for f in schema) for row in rows]
    df = spark.createDataFrame(table, schema)
    columns = []
    for h in H:
        label = F.coalesce(F.try_element_at("labels", F.lit(h)), F.lit("Missing"))
        columns += [(label != "Missing").alias(presence_col(h)), label.alias(config_col(h))]
    return df.select("*", *columns).drop("labels")


def r2(x):
    """Half to even after scaling, as the engine rounds."""
    return round(x * 100) / 100


def expected_scores(rows, n_platforms):
    """Final score per (id, platform) by plain loops."""
    points = DEFAULT_POLICY.header_points
    groups = {}
    for row in rows:
        groups.setdefault(row["ETER_ID"], []).append(row)
    result = {}
    for key, members in groups.items():
        header, redirect = [], []
        for row in members:
            total = 0.0
            for h in H:
                label = row["labels"].get(h)
                total += points(h, label.lower()) if label else 0.0
            header.append(r2(total))
            redirect.append(
                0.0 if not row["to_https"] else 100.0 if row["same"] else 70.0
            )

        def differs(headers):
            return any(len({m["labels"].get(h) for m in members}) > 1 for h in headers)

        distance = 1 - n_platforms / 100
        critical, any_header = differs(DEFAULT_POLICY.critical), differs(H)
        moved = len({m["to_https"] for m in members}) > 1 or len({m["same"] for m in members}) > 1
        header_penalty = critical * 0.85 * distance + any_header * 0.90 * distance or 1
        redirect_penalty = moved * 0.9 * distance or 1
        header_mean = r2(sum(header) / len(header))
        redirect_mean = r2(sum(redirect) / len(redirect))
        redirect_score = r2(min(100, redirect_mean * redirect_penalty))
        for row in members:
            factor = {"h3": 1.3, "h2": 1.1}.get(row["protocol"].lower(), 1)
            header_score = r2(min(100, header_mean * factor * header_penalty))
            final = r2(header_score * 0.6 + redirect_score * 0.4)
            result[(key, row["platform"])] = final
    return result
