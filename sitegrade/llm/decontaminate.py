"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The strings to find are windows of consecutive benchmark words. Per window length there are three
tables over blocks of two words: the shift table says how far the search may move on without
missing a window, the bucket of a block without shift (a hash of the window's last and first
block) selects windows, and a direct comparison of all words confirms one.

The windows are cut into blocks of bounded size and sent to the tasks one block after the other;
documents stay where they are and are searched whole. Only hit intervals would have to be merged,
and only if there is more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, free_name, numbered, quoted

WINDOW = 13
# One block of windows holds at most so many bytes of benchmark text; it is what a task keeps in
# memory (about fifty times that with all windows and tables).
BLOCK_BYTES = 1 << 23

# Words: A-Z in lower case; every other ASCII character but digits and letters separates.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Tables:
    """Wu-Manber tables of the windows of one length."""

    length: int
    items: dict[tuple[bytes, ...], set] = field(default_factory=dict)
    shift: dict[tuple[bytes, ...], int] = field(default_factory=dict)
    buckets: dict[int, list[tuple[bytes, ...]]] = field(default_factory=dict)

    @property
    def block(self) -> int:
        return min(2, self.length)

    def add(self, window: tuple[bytes, ...], item) -> None:
        known = self.items.get(window)
        if known is not None:
            known.add(item)
            return
        self.items[window] = {item}
        n, b = self.length, self.block
        for end in range(b, n + 1):
            block = window[end - b : end]
            self.shift[block] = min(self.shift.get(block, n), n - end)
        self.buckets.setdefault(hash((window[n - b :], window[:b])), []).append(window)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of every occurrence."""
        n, b = self.length, self.block
        shift, buckets, items = self.shift, self.buckets, self.items
        longest = n - b + 1
        end, stop = n, len(words)
        while end <= stop:
            block = tuple(words[end - b : end])
            move = shift.get(block, longest)
            if move:
                end += move
                continue
            start = end - n
            bucket = buckets.get(hash((block, tuple(words[start : start + b]))))
            if bucket:
                text = tuple(words[start:end])
                for window in bucket:
                    if window == text:
                        yield start, items[window]
                        break
            end += 1


def build_tables(benchmark: list[tuple], window: int = WINDOW) -> list[Tables]:
    """Tables of (item_id, text) rows. An item shorter than a window is one window itself."""
    by_length: dict[int, Tables] = {}
    for item, text in benchmark:
        words = words_of(text)
        if item is None or not words:
            continue
        n = min(window, len(words))
        tables = by_length.setdefault(n, Tables(n))
        for i in range(len(words) - n + 1):
            tables.add(tuple(words[i : i + n]), item)
    return list(by_length.values())


def find(words: list[bytes], tables: list[Tables]) -> tuple[list[tuple[int, int]], set]:
    """Merged hit intervals [start, end) in words, and the items with occurring windows."""
    spans, items = [], set()
    for t in tables:
        for start, found in t.search(words):
            spans.append((start, start + t.length))
            items |= found
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(
    benchmark: DataFrame, item_id: str, text: str, block_bytes: int
) -> Iterator[list[tuple]]:
    """The benchmark rows in blocks of bounded size, fetched one partition at a time."""
    rows = benchmark.selectExpr(
        f"cast({quoted(item_id)} as string) as item", f"cast({quoted(text)} as binary) as text"
    ).filter("item is not null and text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item, bytes(row.text)))
        size += len(row.text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end")])
_HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_HIT_TYPES = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    pa.field("items", pa.list_(pa.string())),
]


def _scan(rows: DataFrame, text: str, block: list[tuple], window: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in keep), *_HITS])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build_tables(sent.value, window)
        for batch in batches:
            counts, spans, items = [], [], []
            for value in batch.column(text):
                words = words_of(value.as_py())
                hits, found = find(words, tables)
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in hits])
                items.append(sorted(found))
            arrays = [pa.array(x, f.type) for x, f in zip((counts, spans, items), _HIT_TYPES)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *arrays], names=[*keep, *(f.name for f in _HIT_TYPES)]
            )

    return rows.mapInArrow(search, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Add to every row of ``docs``: ``n_words``, ``spans`` (hit intervals, in words), ``n_hit``,
    ``items`` (ids as strings, sorted), ``n_items``, ``contaminated``.

    A null or empty text has no words and no hit. Benchmark rows without an id or without words
    are ignored, and rows repeating an id are one item. An empty benchmark marks nothing. ``carry`` names the columns
    of ``docs`` to keep (all by default); columns with the name of a result column are replaced.
    """
    added = ["n_words", "spans", "n_hit", "items", "n_items", "contaminated"]
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    body, number, record = (free_name(docs, n) for n in ("_body", "_number", "_record"))
    row = F.struct(*[F.col(quoted(c)) for c in kept]) if kept else F.lit(0)
    rows = docs.select(row.alias(record), F.col(quoted(text)).cast("binary").alias(body))
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        hits = _scan(rows, body, first, window)
    else:
        # Several blocks: the rows get numbers, every block adds its hits, and hits are merged by
        # number. Rows stay whole; only those with hits in a later block move.
        rows = cut(numbered(rows, number), "documents")
        hits = _scan(rows, body, first, window)
        later = None
        for block in [second, *blocks]:
            found = _scan(rows.select(number, body), body, block, window).filter("size(items) > 0")
            found = cut(found.drop("n_words"), "hits")
            later = found if later is None else later.unionByName(found)
        # One row per document and block with hits: their number is bounded by the blocks.
        joined = later.groupBy(number).agg(
            F.flatten(F.collect_list("spans")).alias("more"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"),
        )
        hits = hits.join(joined, number, "left").selectExpr(
            record,
            "n_words",
            f"if(more is null, spans, {_merge_sql('concat(spans, more)')}) as spans",
            "if(more is null, items, array_sort(array_union(items, more_items))) as items",
        )
    out = hits.selectExpr(
        record,
        "n_words",
        "spans",
        "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as n_hit",
        "items",
        "cast(size(items) as bigint) as n_items",
    )
    return out.selectExpr(
        *([f"{record}.*"] if kept else []),
        "n_words",
        "spans",
        "n_hit",
        "items",
        "n_items",
        "n_hit > 0 and 20 * n_hit >= n_words as contaminated",
    )


def _merge_sql(spans: str) -> str:
    """SQL: overlapping or touching intervals joined, in order."""
    element = "struct<start: int, end: int>"
    return f"""aggregate(array_sort({spans}), cast(array() as array<{element}>), (done, s) ->
        if(size(done) > 0 and s.start <= element_at(done, -1).end,
           concat(slice(done, 1, size(done) - 1), array(named_struct(
               'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
           concat(done, array(s))))"""


def items_digest(items: str = "items") -> str:
    """SQL: SHA-256 of the sorted ids, comma-joined."""
    return f"sha2(array_join({items}, ','), 256)"


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, with the columns of ``docs``."""
    name = free_name(docs, "_document")
    whole = docs.withColumn(name, F.struct(*[F.col(quoted(c)) for c in docs.columns]))
    found = find_contamination(whole, benchmark, carry=[name], **options)
    return found.filter("not contaminated").select(f"{name}.*")
