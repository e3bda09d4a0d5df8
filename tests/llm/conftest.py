import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": n, "type": t, "nullable": True, "metadata": {}}
            for n, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))
        ],
    }
)

LONG = " ".join(f"word{i % 997} the {i % 89}" for i in range(60_000))

# Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, copies that
# differ in white space, near copies.
EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then runs away again", "en", "src0", 10),
    (2, "the quick  brown fox jumps over the lazy dog and then runs away again\n", "en", "src0", None),
    (3, "the quick brown fox jumps over the lazy dog and then runs away again", "en", None, 10),
    (3, "the quick brown fox jumps over the lazy dog and then runs away again", "en", None, 10),
    (4, None, "en", "src1", 0),
    (5, "", None, "src1", 0),
    (6, " \t\n", "de", "src1", 3),
    (None, "der schnelle braune fuchs springt über den faulen hund", "de", "src2", 5),
    (None, "der schnelle braune fuchs springt über den faulen hund", "de", "src2", 5),
    (None, None, None, None, None),
    (7, LONG, "en", "src0", len(LONG)),
    (8, LONG + "!", "en", "src0", len(LONG)),
    (9, "\U0001f600 naïve \U0001f600 café señor", "fr", "a.b.example", 4),
    (10, "one", "en", "src3", 3),
    (11, "x" * 100_000, "en", "src3", 3),
]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge rows, with extra columns whose names clash with those of results."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    names = [
        "kept", "keep_id", "group_size", "print", "fingerprint", "component_id", "items", "spans", "n_words",
        "language", "score", "held_out", "piece", "bin_id", "_row", "_id", "_text", "_document", "block", "ids",
    ]
    rows = spark.createDataFrame(EDGE_ROWS, DOCUMENTS)
    return rows.selectExpr("*", *[f"'mine' as `{n}`" for n in names])


@pytest.fixture(scope="session")
def nothing(spark, edge):
    return edge.filter("false")
