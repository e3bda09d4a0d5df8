"""WARC archives as seekable Zstandard bundles.

A task writes its records into bundles. A bundle is a sequence of independent Zstandard frames,
each with several records, and a footer: a skippable frame with the compressed and uncompressed
size of every frame (the public seekable format). The index maps a record id to its bundle, the
frame in it and the record's place within the uncompressed frame, so one record is read by fetching
one frame.

Files are written through the file system that the shared folder's address names. A file's name is
unique per task attempt and only committed attempts get into the index, so a repeated task never
changes a file that the index points to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import quoted, shared_folder
from sitegrade.operators.keyed import attach

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
# Frames of a bundle that a reading task takes in a row, and how much it reads in all, about.
RUN_FRAMES = 64
TASK_BYTES = 1 << 24
SMALLEST_SHARED = 100
LEVEL = 3
NAMELESS = "urn:nameless"


# ---- records ----------------------------------------------------------------------------------


def record_bytes(
    record_id: str, kind: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None
) -> bytes:
    """One WARC/1.1 record. A revisit has no block; ``size`` is that of the full payload."""
    block = payload if kind == "response" else b""
    target = (url or "").encode().translate(None, b"\r\n").decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {size}",
    ]
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{refers_to}>")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``start``."""
    end = data.index(b"\r\n\r\n", start)
    lines = data[start:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {start}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block_start = end + 4
    block_end = block_start + int(headers["Content-Length"])
    if data[block_end : block_end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {start} has no end mark")
    return headers, data[block_start:block_end], block_end + 4


# ---- bundles ----------------------------------------------------------------------------------


@dataclass
class Frame:
    offset: int
    compressed: int
    size: int


class BundleWriter:
    """Seekable Zstandard file; records are added one by one."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES) -> None:
        self.stream, self.frame_bytes = stream, frame_bytes
        self.frames: list[Frame] = []
        self.written = 0
        self._held: list[bytes] = []
        self._size = 0
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame number, offset in the uncompressed frame)."""
        if self._held and self._size + len(record) > self.frame_bytes:
            self._flush()
        place = (len(self.frames), self._size)
        self._held.append(record)
        self._size += len(record)
        return place

    def _flush(self) -> None:
        data = self._compressor.compress(b"".join(self._held))
        self.stream.write(data)
        self.frames.append(Frame(self.written, len(data), self._size))
        self.written += len(data)
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._flush()
        table = b"".join(struct.pack("<II", f.compressed, f.size) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(file) -> list[Frame]:
    """The frames of a bundle, from its footer alone."""
    size = file.size()
    file.seek(size - FOOTER_BYTES)
    count, _, magic = struct.unpack("<IBI", file.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - FOOTER_BYTES - 8 * count)
    table = file.read(8 * count)
    frames, offset = [], 0
    for compressed, plain in struct.iter_unpack("<II", table):
        frames.append(Frame(offset, compressed, plain))
        offset += compressed
    return frames


def read_frame(file, frame: Frame) -> bytes:
    file.seek(frame.offset)
    return zstandard.ZstdDecompressor().decompress(file.read(frame.compressed), max_output_size=frame.size)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    for name in ("s3a://", "s3n://"):  # Hadoop's names of the scheme
        if path.startswith(name):
            path = "s3://" + path.removeprefix(name)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- Spark ------------------------------------------------------------------------------------


def with_record_types(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, keeper, repeated) per page.

    ``keeper`` is the page that stands for an equal payload of at least 100 bytes, else null.
    ``repeated`` is true where some page id comes more than once with this payload.
    """
    rows = pages.select(
        F.col(quoted(page_id)).alias("page_id"),
        F.col(quoted(url)).cast("string").alias("url"),
        F.expr(f"cast(coalesce({quoted(html)}, '') as binary)").alias("payload"),
    ).selectExpr(
        "*", "sha2(payload, 256) as payload_digest", "cast(octet_length(payload) as bigint) as payload_bytes"
    )
    pairs = rows.groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"), F.max("payload_bytes").alias("size"))
    keepers = (
        pairs.groupBy("payload_digest")
        .agg(
            F.expr(f"if(max(size) >= {SMALLEST_SHARED}, min(page_id), null)").alias("keeper"),
            F.expr("max(if(page_id is null, 0, n)) > 1").alias("repeated"),
            F.sum("n").alias("n"),
        )
        .filter("n > 1")
    )
    return attach(rows, keepers.drop("n"), ["payload_digest"])


_INDEX = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("bundle", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("frame_offset", T.LongType()),
        T.StructField("frame_compressed", T.LongType()),
        T.StructField("frame_size", T.LongType()),
        T.StructField("record_offset", T.LongType()),
    ]
)


def record_id_of(page_id: str | None, digest: str) -> str:
    """The id of a page's record with this payload; revisits refer to that of the response."""
    return NAMELESS if page_id is None else f"urn:page:{quote(page_id, safe='')}:{digest[:16]}"


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write one record per page below ``folder`` and return the index, itself written there.

    Of pages with equal payloads of at least 100 bytes the one with the smallest id is a response,
    the others are revisits of it; smaller payloads are all responses. Rows that repeat the id of
    the response are responses too, as are pages without an id when no equal page has one. A null
    html is an empty payload. Page ids may be of any type that casts to text and back. Record ids
    are made of page id and payload; those of pages without id, and of payloads that come more than once
    with one id, have a random part too. An empty table writes no bundle.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        writer, rows = None, []

        def close() -> pa.RecordBatch:
            writer.close()
            frames = writer.frames
            columns = list(zip(*rows))
            number = [frames[f] for f in columns[3]]
            arrays = [
                *columns[:4],
                [f.offset for f in number],
                [f.compressed for f in number],
                [f.size for f in number],
                columns[4],
            ]
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(a), t) for a, t in zip(arrays, types)], names=_INDEX.names
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page, target, payload, digest, size, keeper, repeated = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    name = f"{root}/part-{uuid.uuid4().hex}.warc.zst"
                    writer, rows = BundleWriter(system.open_output_stream(name, compression=None), frame_bytes), []
                revisit = keeper is not None and page != keeper  # a page without id is no keeper
                record = record_id_of(page, digest)
                if page is None or repeated:
                    record = f"{record}:{uuid.uuid4().hex}"
                kind = "revisit" if revisit else "response"
                refers = record_id_of(keeper, digest) if revisit else None
                data = record_bytes(record, kind, target, payload, digest, size, refers)
                rows.append((record, page, name, *writer.add(data)))
                if writer.written >= bundle_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    typed = with_record_types(pages, page_id, url, html).selectExpr(
        "cast(page_id as string) as page_id", "url", "payload", "payload_digest", "payload_bytes",
        "cast(keeper as string) as keeper", "coalesce(repeated, false) as repeated",
    )
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    index = typed.mapInArrow(write, _INDEX)
    index.write.parquet(f"{folder}/index")
    return typed.sparkSession.read.schema(_INDEX).parquet(f"{folder}/index")


_RECORD = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _page_of(record_id: str | None) -> str | None:
    """The page id in ``urn:page:<id>:<digest>[:<random part>]``."""
    name = (record_id or NAMELESS).strip("<>")
    return None if name.startswith(NAMELESS) else unquote(name.split(":")[2])


def read_archives(index: DataFrame, folder: str, payloads: bool = True, id_type: str = "bigint") -> DataFrame:
    """Every indexed record, read back from its frame; digests of responses are checked.

    ``payload`` is null for revisits, and for all if not asked for; page ids are cast to ``id_type``.
    Tasks are sized by the bytes they unpack. Each takes runs of neighbouring frames, opens a bundle
    once per run and holds the index against the bundle's own seek table.
    """
    keys = ["bundle", "frame", "frame_offset", "frame_compressed", "frame_size"]
    frames = index.groupBy(*keys).agg(F.array_sort(F.collect_list("record_offset")).alias("offsets"))
    total = index.select(*keys).distinct().agg(F.sum("frame_size")).first()[0] or 0
    runs = frames.withColumn("run", F.expr(f"frame div {RUN_FRAMES}"))
    dealt = runs.repartition(max(1, -(-total // TASK_BYTES)), "bundle", "run").sortWithinPartitions("bundle", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        name, file, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if file is not None:
                        file.close()
                    name = row["bundle"]
                    file = system.open_input_file(name)
                    table = seek_table(file)
                frame = Frame(row["frame_offset"], row["frame_compressed"], row["frame_size"])
                if row["frame"] >= len(table) or table[row["frame"]] != frame:
                    raise ValueError(f"the seek table of {name} has another frame {row['frame']}")
                data = read_frame(file, frame)
                out = []
                for offset in row["offsets"]:
                    headers, block, _ = parse_record(data, offset)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
                    record = headers["WARC-Record-ID"].strip("<>")
                    out.append(
                        {
                            "page_id": _page_of(record),
                            "record_id": record,
                            "url": headers.get("WARC-Target-URI"),
                            "record_type": kind,
                            "refers_to": _page_of(headers.get("WARC-Refers-To")),
                            "payload_bytes": int(headers["Payload-Length"]),
                            "payload_digest": digest,
                            "payload": block if payloads and kind == "response" else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW_RECORD)
        if file is not None:
            file.close()

    ids = {name: F.col(name).cast(id_type) for name in ("page_id", "refers_to")}
    return dealt.drop("run").mapInArrow(read, _RECORD).withColumns(ids)


_ARROW_RECORD = pa.schema(
    [
        ("page_id", pa.string()),
        ("record_id", pa.string()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def lookup(index: DataFrame, page_ids: DataFrame, folder: str) -> DataFrame:
    """The records of some pages (column ``page_id``): only their frames are fetched."""
    kind = page_ids.schema["page_id"].dataType.simpleString()
    wanted = page_ids.select(F.col("page_id").cast("string").alias("page_id")).distinct()
    return read_archives(index.join(wanted, "page_id", "left_semi"), folder, id_type=kind)


def archive_round_trip(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Write the archives into the shared folder and read every record back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc"
    kind = pages.schema[page_id].dataType.simpleString()
    index = write_archives(pages, folder, page_id)
    return read_archives(index, folder, payloads=False, id_type=kind).drop("payload")
