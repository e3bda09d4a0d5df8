"""Best-fit packing of documents into training sequences of several permitted lengths.

Texts are counted in tokens and cut into pieces of at most the largest length. Pieces are dealt
into shards of bounded size and every shard is packed on its own: longest piece first, into the
open bin that it leaves least room in. Where none fits, a bin is opened: of all permitted lengths
the one with the least cost per token it can be expected to hold, given the pieces still to come.
At the end every bin shrinks to the shortest length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, free_name, numbered, quoted

LENGTHS = (512, 1024, 2048, 4096, 8192)
# A sequence of n tokens costs n + n * n / QUADRATIC + FIXED: dense layers, attention, overhead.
QUADRATIC = 32_768
FIXED = 16
# Pieces per shard, on average: what one task packs at once.
SHARD_PIECES = 16_384


def cost(length: int) -> float:
    return length + length * length / QUADRATIC + FIXED


def choose_length(piece: int, fill: float, lengths: tuple[int, ...]) -> int:
    """The permitted length with the least cost per token held.

    ``fill`` is the number of tokens still to be packed, this piece included: a longer bin pays
    only if there is enough to fill it.
    """
    fitting = [n for n in lengths if n >= piece]
    return min(fitting, key=lambda n: (cost(n) / min(n, max(piece, fill)), n))


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin number, start in the bin, length of the bin) per piece; ``sizes`` in falling order."""
    lengths = tuple(sorted(lengths))
    n = len(sizes)
    bins, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used: list[int] = []
    # Open bins with room, as (room, bin number): the first with enough room is the best fit, and
    # the oldest among equals.
    rooms: list[tuple[int, int]] = []
    rest = int(sizes.sum())
    for i, size in enumerate(map(int, sizes)):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = choose_length(size, rest, lengths), len(used)
            used.append(0)
        bins[i], starts[i] = number, used[number]
        used[number] += size
        if room > size:
            insort(rooms, (room - size, number))
        rest -= size
    final = np.array(lengths)[np.searchsorted(lengths, np.array(used, np.int64))] if n else np.zeros(0, np.int64)
    return bins, starts, final[bins] if n else final


def token_count(text: str) -> str:
    """SQL: words plus one end-of-text token."""
    return f"regexp_count(coalesce({text}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') + 1"


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: str | None = None,
    lengths: tuple[int, ...] = LENGTHS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``first_token``, ``n_tokens``, ``bin_id``,
    ``bin_start``, ``bin_length``.

    ``tokens``: SQL for the number of tokens; words and an end token by default, so a null or
    empty text is one token. A document longer than the largest length becomes several pieces,
    all full but the last; no token is dropped. Documents of null or negative size are taken as
    empty. Repeated rows and ids are packed row by row. An empty table gives an empty result.

    Shards are dealt by a hash of a row number, so neither a hot id nor copies fill one.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    number, size = free_name(docs, "_number"), free_name(docs, "_size")
    sized = docs.selectExpr(
        f"{quoted(doc_id)} as doc_id",
        f"cast(greatest(coalesce({tokens or token_count(quoted(text))}, 0), 0) as bigint) as {size}",
    )
    rows = cut(numbered(sized, number), "sizes")
    total = rows.agg(F.sum(F.ceil(F.col(size) / longest))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    pieces = rows.selectExpr(
        "doc_id",
        number,
        f"explode(sequence(0L, greatest({size} - 1, 0) div {longest})) as piece",
        size,
    ).selectExpr(
        "doc_id",
        "piece",
        f"piece * {longest} as first_token",
        f"least({size} - piece * {longest}, {longest}) as n_tokens",
        f"pmod(xxhash64({number}, piece), {shards}) as shard",
        number,
    )

    packed_columns = T.StructType.fromDDL(
        "piece bigint, first_token bigint, n_tokens bigint, bin_id string, bin_start bigint,"
        " bin_length bigint"
    )
    schema = T.StructType([rows.schema["doc_id"], *packed_columns])

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's shards in turn; rows come sorted, so one shard is in memory at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if held and held[-1].column("shard")[0].as_py() != shards[start]:
                    yield from packed(held)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield from packed(held)

    def packed(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        part = pa.Table.from_batches(parts)
        bins, starts, final = pack(part["n_tokens"].to_numpy(), lengths)
        shard = part["shard"][0].as_py()
        out = part.select(["doc_id", "piece", "first_token", "n_tokens"])
        out = out.append_column("bin_id", pa.array([f"{shard}-{b}" for b in bins], pa.string()))
        out = out.append_column("bin_start", pa.array(starts, pa.int64()))
        return out.append_column("bin_length", pa.array(final, pa.int64())).to_batches()

    dealt = pieces.repartition("shard").sortWithinPartitions(
        "shard", F.desc("n_tokens"), number, "piece"
    )
    return dealt.mapInArrow(pack_shards, schema)
