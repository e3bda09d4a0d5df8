"""Score tables that can be refreshed in part, and score tables bucketed by institution."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.operators.scoring import final_scores, platform_count, stamp_analysis, worst_observation
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.schemas import ID, scored_schema
from sitegrade.sources.writers import by_schema

# An institution's rows lie in one partition: its country and one of so many shelves.
SHELVES = 64
SHELF = f"cast(pmod(xxhash64({ID}), {SHELVES}) as int)"
_KEYS = ["country", "shelf"]


def _write(df: DataFrame, path: str, partial: bool) -> None:
    # "rebalance" also splits a shelf that holds much of the data over several tasks.
    shelved = df.withColumn("shelf", F.expr(SHELF)).hint("rebalance", *[F.col(k) for k in _KEYS])
    mode = "dynamic" if partial else "static"
    shelved.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*_KEYS).parquet(path)


def _read(spark: SparkSession, path: str, policy: Policy) -> DataFrame:
    return spark.read.schema(scored_schema(policy.headers).add("shelf", T.IntegerType())).parquet(path)


def read_stored(spark: SparkSession, path: str, table: str = "scores", policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """``scores`` (all rows) or ``worst`` (one row per institution) of a store."""
    return _read(spark, f"{path}/{table}", policy).drop("shelf")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(places: list[tuple]) -> str:
    """Condition on ``country`` and ``shelf``. The part on ``country`` alone prunes partition folders."""
    by_country: dict[str | None, list[int]] = {}
    for country, shelf in places:
        by_country.setdefault(country, []).append(shelf)
    named = [c for c in by_country if c is not None]
    tests = []
    if named:
        tests.append(f"country in ({', '.join(map(_literal, named))})")
    if None in by_country:
        tests.append("country is null")
    exact = [
        f"(country <=> {'null' if c is None else _literal(c)} and shelf in ({', '.join(map(str, sorted(shelves)))}))"
        for c, shelves in by_country.items()
    ]
    return f"({' or '.join(tests)}) and ({' or '.join(exact)})"


def _update(
    spark: SparkSession, rows: DataFrame, path: str, places: list[tuple] | None, n_platforms: int, policy: Policy
) -> None:
    schema = scored_schema(policy.headers)
    scored = by_schema(stamp_analysis(final_scores(rows, policy, n_platforms)), schema)
    _write(scored, f"{path}/scores", places is not None)
    stored = _read(spark, f"{path}/scores", policy)
    if places is not None:
        stored = stored.filter(_among(places))
    _write(worst_observation(stored.drop("shelf")), f"{path}/worst", places is not None)


def build_store(
    spark: SparkSession, observations: DataFrame, path: str, policy: Policy = DEFAULT_POLICY
) -> None:
    """Score all ``observations`` into the tables ``scores`` and ``worst`` below ``path``."""
    n = platform_count(observations).first().n_platforms
    _update(spark, observations, path, None, n, policy)
    spark.range(1).select(F.lit(n).alias("n_platforms")).coalesce(1).write.mode("overwrite").json(f"{path}/platforms")


def refresh_store(
    spark: SparkSession,
    observations: DataFrame,
    added: DataFrame,
    path: str,
    policy: Policy = DEFAULT_POLICY,
) -> int | None:
    """Bring a store up to ``observations`` after ``added`` rows (already part of them) came in.

    Only partitions that hold an institution of ``added`` are scored again and replaced: at most
    ``SHELVES`` per country reach the driver as a list. A new platform changes every score, so then,
    and where there is no store yet, all is built. Returns how many partitions were replaced, None
    for all.
    """
    n = platform_count(observations).first().n_platforms
    try:
        known = spark.read.schema("n_platforms bigint").json(f"{path}/platforms").first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known is None or known.n_platforms != n:
        build_store(spark, observations, path, policy)
        return None
    places = [tuple(r) for r in added.selectExpr("country", f"{SHELF} as shelf").distinct().collect()]
    if places:
        _update(spark, touched_rows(observations, places), path, places, n, policy)
    return len(places)


def touched_rows(observations: DataFrame, places: list[tuple]) -> DataFrame:
    """The observations of the given (country, shelf) pairs."""
    return observations.withColumn("shelf", F.expr(SHELF)).filter(_among(places)).drop("shelf")


def write_bucketed(scored: DataFrame, table: str, buckets: int = 256, policy: Policy = DEFAULT_POLICY) -> None:
    """A catalog table of scores bucketed by institution.

    Aggregations and joins by institution over it need no shuffle. The rows are dealt by the
    bucket's own hash before writing, so there is one file per bucket.
    """
    rows = by_schema(scored, scored_schema(policy.headers)).repartition(buckets, ID)
    rows.write.mode("overwrite").bucketBy(buckets, ID).sortBy(ID).format("parquet").saveAsTable(table)
