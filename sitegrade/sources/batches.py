"""Append-only tables whose batches may be written again without leaving two copies.

Every write of a batch goes to a folder of its own and counts only once its line stands in the
ledger, so a job that dies half-way leaves nothing a reader sees. Of several writes of one batch the
last one committed counts. Readers ask the ledger, one short line a write, which folders to read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "batch string, attempt string, committed bigint"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def write_batch(df: DataFrame, path: str, batch: str, keys: list[str], file_format: str = "parquet") -> None:
    """Write ``df`` as batch ``batch``, partitioned by ``keys``; an earlier write of it is replaced."""
    if not _NAME.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits, '.', '_' and '-', not {batch!r}")
    attempt = uuid.uuid4().hex
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.partitionBy(*keys).format(file_format).save(_folder(path, batch, attempt))
    line = df.sparkSession.range(1).select(
        F.lit(batch).alias("batch"),
        F.lit(attempt).alias("attempt"),
        F.expr("unix_micros(current_timestamp())").alias("committed"),
    )
    line.coalesce(1).write.mode("append").json(f"{path}/ledger")


def _folder(path: str, batch: str, attempt: str) -> str:
    return f"{path}/data/batch={batch}/attempt={attempt}"


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).json(f"{path}/ledger")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def has_batches(spark: SparkSession, path: str) -> bool:
    return _ledger(spark, path) is not None


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Batch -> the attempt that counts. One entry per batch reaches the driver."""
    lines = _ledger(spark, path)
    if lines is None:
        return {}
    last = lines.groupBy("batch").agg(F.expr("max_by(attempt, struct(committed, attempt))").alias("attempt"))
    return {r.batch: r.attempt for r in last.collect()}


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, batches: Iterable[str] | None = None
) -> DataFrame:
    """The rows of all committed batches, or of those named."""
    known = committed(spark, path)
    wanted = known if batches is None else [b for b in dict.fromkeys(batches) if b in known]
    folders = [_folder(path, b, known[b]) for b in sorted(wanted)]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)
    return rows.select(*[f"`{f.name}`" for f in schema])
