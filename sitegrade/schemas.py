"""Column names and fixed schemas of every table that crosses a file boundary."""

from pyspark.sql import types as T

ID = "ETER_ID"
NUTS = "NUTS2_Label_2016"

SOURCE_COLUMNS = (
    "ETER_ID",
    "Name",
    "Category",
    "Institution_Category_Standardized",
    "Member_of_European_University_alliance",
    "Url",
    "NUTS2",
    "NUTS2_Label_2016",
    "NUTS2_Label_2021",
    "NUTS3",
    "NUTS3_Label_2016",
    "NUTS3_Label_2021",
)

SCAN_FIELDS = (
    T.StructField("assessment_datetime", T.TimestampNTZType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("https_status_code", T.IntegerType()),
    T.StructField("redirected_to_https", T.BooleanType()),
    T.StructField("redirected_https_to_same_domain", T.BooleanType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("idioma", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("protocol_http", T.StringType()),
    T.StructField("redirect_count", T.IntegerType()),
)

# The ten columns above stand at positions 12..21 of a result file.
SCAN_COLUMNS = tuple(field.name for field in SCAN_FIELDS)

INCONSISTENCY_COLUMNS = (
    "critical_header_inconsistency_between_platforms",
    "header_inconsistency_between_platforms",
    "redirect_inconsistency_between_platforms",
)

SCORE_FIELDS = (
    T.StructField("country", T.StringType()),
    T.StructField("analysis_datetime", T.TimestampType()),
    T.StructField("header_score_by_platform", T.DoubleType()),
    T.StructField("header_avg_score_btw_platforms", T.DoubleType()),
    T.StructField(INCONSISTENCY_COLUMNS[0], T.BooleanType()),
    T.StructField(INCONSISTENCY_COLUMNS[1], T.BooleanType()),
    T.StructField("header_component_score", T.DoubleType()),
    T.StructField("redirect_score_by_platform", T.DoubleType()),
    T.StructField("redirect_avg_score_btw_platforms", T.DoubleType()),
    T.StructField(INCONSISTENCY_COLUMNS[2], T.BooleanType()),
    T.StructField("redirect_component_score", T.DoubleType()),
    T.StructField("final_score", T.DoubleType()),
    T.StructField("grade", T.StringType()),
)


def presence_col(header: str) -> str:
    return f"{header}_presence"


def config_col(header: str) -> str:
    return f"{header}_config"


def source_schema() -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in SOURCE_COLUMNS])


def error_schema() -> T.StructType:
    return source_schema().add("error", T.StringType())


def header_fields(headers) -> list[T.StructField]:
    fields = []
    for header in headers:
        fields.append(T.StructField(presence_col(header), T.BooleanType()))
        fields.append(T.StructField(config_col(header), T.StringType()))
    return fields


def observation_schema(headers) -> T.StructType:
    return T.StructType(
        source_schema().fields
        + list(SCAN_FIELDS)
        + header_fields(headers)
        + [T.StructField("raw_headers", T.StringType())]
    )


def scored_schema(headers) -> T.StructType:
    return T.StructType(observation_schema(headers).fields + list(SCORE_FIELDS))


def region_score_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(NUTS, T.StringType()), T.StructField("final_score", T.DoubleType())]
    )
