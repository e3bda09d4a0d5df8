"""CSV reading by column name: files may differ in column order and in which columns they have.

All columns are read as text and cast afterwards, so that a number written as ``301.0`` or a null
written as ``NaN`` is understood, and so that only the columns asked for are parsed.

A file is damaged when it has no header line, a row with more fields than the header, or text that
is no UTF-8. Damaged files are left out whole; ``load_report`` names them with the reason.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_NAME = "_file_name"
FILE_ADDRESS = "_file_address"

# Texts that stand for null in the input files.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NO_HEADER = "no header line"
TOO_MANY_FIELDS = "row with more fields than the header"
NOT_UTF8 = "text that is no UTF-8"

_RECORD = "_whole_record"
_UNKNOWN_CHARACTER = "�"
# Fields looked at beyond the header's, to tell a row with more fields from one with fewer.
_BEYOND = 8

# Header line -> (path, address) of the files that have it; the address is the path as a URI.
Layouts = dict[tuple[str, ...], list[tuple[str, str]]]


def find_layouts(spark: SparkSession, directory: str, name_pattern: str) -> Layouts:
    """The header line of every CSV file whose name matches, found by one job.

    The first line of a file is the first of its first block that is not blank. Only distinct header
    lines are split into names, on the driver; an empty tuple stands for files without one. A
    header line holds no line break.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(directory)
    # The listing that the reader has made anyway; it names empty files too.
    # An address without a host has three slashes there and one in the metadata.
    listed = sorted(re.sub("^file:///", "file:/", a) for a in lines.inputFiles())
    addresses = [a for a in listed if re.match(name_pattern, unquote(a).rsplit("/", 1)[-1])]
    first = (
        lines.select("value", F.col("_metadata.file_path").alias("address"), "_metadata.file_block_start")
        .filter("file_block_start = 0")
        .withColumn("no", F.monotonically_increasing_id())
        .filter("trim(value) <> ''")
        .groupBy("address")
        .agg(F.expr("min_by(value, no)").alias("header"))
    )
    headers = {r.address: r.header for r in first.collect()} if addresses else {}
    layouts: Layouts = {}
    for address in addresses:
        layouts.setdefault(_names(headers.get(address)), []).append((unquote(address), address))
    return layouts


def _names(header: str | None) -> tuple[str, ...]:
    """Column names: empty ones get their number, repeated ones their number behind the name."""
    if header is None:
        return ()
    names = next(csv.reader([header.removeprefix("\ufeff")]))
    lower = [n.lower() for n in names]
    return tuple(
        f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)
    )


def _text(
    spark: SparkSession, layout: tuple[str, ...], files: list[tuple[str, str]], multi_line: bool
) -> DataFrame:
    """All files of one layout as text columns, the file's name and address, and the record if it is odd."""
    fields = [T.StructField(name, T.StringType()) for name in (*layout, _RECORD)]
    rows = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", _RECORD)
        .schema(T.StructType(fields))
        .csv([path for path, _ in files])
    )
    return rows.select(
        "*", F.col("_metadata.file_name").alias(FILE_NAME), F.col("_metadata.file_path").alias(FILE_ADDRESS)
    )


def _damage(layout: tuple[str, ...]) -> str:
    """SQL: what is wrong with a row, null if nothing. Rows with fewer fields are in order.

    The reader marks every record with another number of fields. A mark put behind the record shows
    whether it has more: then it, or a field before it, comes after the header's last column.
    """
    size = len(layout)
    schema = ", ".join(f"c{i} string" for i in range(size + _BEYOND))
    parsed = f"from_csv(concat({_RECORD}, ',x'), '{schema}', map('quote', '\"', 'escape', '\"'))"
    more = " or ".join(f"record.c{i} is not null" for i in range(size, size + _BEYOND))
    text = " or ".join(f"coalesce(contains(`{_escaped(c)}`, '{_UNKNOWN_CHARACTER}'), false)" for c in layout)
    many = f"exists(array({parsed}), record -> {more})"
    return (
        f"case when {_RECORD} is not null and {many} then '{TOO_MANY_FIELDS}'"
        f" when {text} then '{NOT_UTF8}' end"
    )


def _escaped(name: str) -> str:
    return name.replace("`", "``")


_REPORT = "file string, rows bigint, damaged_rows bigint, reason string"


def load_report(
    spark: SparkSession,
    directory: str,
    name_pattern: str,
    multi_line: bool = True,
    refused: Callable[[tuple[str, ...]], str | None] = lambda layout: None,
) -> DataFrame:
    """One row per file: its address, rows, damaged rows, and why it is left out (null if it is read).

    ``refused`` may name a reason against a header line.
    """
    listed, parts = [], []
    for layout, files in find_layouts(spark, directory, name_pattern).items():
        reason = refused(layout) if layout else NO_HEADER
        listed += [(address, 0, 0, reason) for _, address in files]
        if layout:
            rows = _text(spark, layout, files, multi_line)
            judged = rows.select(F.col(FILE_ADDRESS).alias("file"), F.expr(_damage(layout)).alias("reason"))
            counts = [F.count("*").alias("rows"), F.count("reason").alias("damaged_rows"), F.min("reason").alias("reason")]
            parts.append(judged.groupBy("file").agg(*counts))
    report = reduce(DataFrame.unionByName, parts, spark.createDataFrame(listed, _REPORT))
    return report.groupBy("file").agg(
        F.sum("rows").alias("rows"), F.sum("damaged_rows").alias("damaged_rows"), F.max("reason").alias("reason")
    )


def read_text_columns(
    spark: SparkSession,
    directory: str,
    name_pattern: str,
    multi_line: bool = True,
    prepare: Callable[[DataFrame, list[str]], DataFrame | None] = lambda rows, files: rows,
) -> DataFrame | None:
    """All files in order as text columns plus the file name; one scan per distinct header line.

    ``prepare`` gets the columns of each layout in their own order, before they are matched by name,
    and the addresses of its files; it may leave a layout out. Fields may contain line breaks, which
    makes a file one task. Pass ``multi_line=False`` for large files without them.
    """
    parts = []
    for layout, files in find_layouts(spark, directory, name_pattern).items():
        if not layout:
            continue
        rows = _text(spark, layout, files, multi_line)
        damaged = rows.filter(f"{_damage(layout)} is not null").select(FILE_ADDRESS).distinct()
        rows = rows.join(damaged, FILE_ADDRESS, "left_anti")
        own = [f"`{_escaped(name)}`" for name in layout]
        prepared = prepare(rows.select(*own, FILE_NAME), [address for _, address in files])
        if prepared is not None:
            parts.append(prepared)
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _value(name: str, kind: T.DataType) -> str:
    nulls = ", ".join(f"'{text}'" for text in NULL_TEXTS)
    text = f"if(`{name}` in ({nulls}), null, `{name}`)"
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegerType):
        text = f"try_cast({text} as double)"
    return f"try_cast({text} as {kind.simpleString()})"


def typed(text: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cast text columns to a schema by name. Absent columns are null, unknown ones are dropped."""
    present = set(text.columns)
    columns = [
        f"{_value(f.name, f.dataType)} as `{f.name}`"
        if f.name in present
        else f"cast(null as {f.dataType.simpleString()}) as `{f.name}`"
        for f in schema
    ]
    return text.selectExpr(*columns, *extra)
