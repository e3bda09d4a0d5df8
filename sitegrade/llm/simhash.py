"""SimHash near duplicates, found with BK-trees.

Equal fingerprints are one node. Nodes are dealt to shards such that any two within the radius
meet in a shard; every shard's nodes form a BK-tree (children keyed by their Hamming distance to
the parent) and a search follows only the edges within the radius. A task reports no pairs but, per
node, one node that it hangs together with; the components of these links are the groups.

Shards: the fingerprint is cut into ``radius + 2`` blocks. ``radius`` differing bits leave at least
two blocks untouched, so a shard is a pair of blocks with their values. A shard with more nodes
than ``shard_nodes`` (many similar texts) is dealt anew by neighbourhoods: a node goes to every
value within half the radius, where any two nodes within the radius meet halfway; such a shard
holds at most 65 nodes for radius 2, however many texts are alike. Both ways lose no link.

A tree goes only to the tasks that search it. Sending all trees everywhere would grow with the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.components import components
from sitegrade.llm.shared import cut, free_name, numbered, quoted
from sitegrade.operators.keyed import attach

BITS = 64
SHARD_NODES = 2048
_ALL = (1 << BITS) - 1


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Bit-wise majority of the shingles' XXH64 hashes; zero for a text without words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def with_fingerprints(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint of the whole text (a bigint with the 64 bits) as ``name``.

    The text column is replaced by it; carry another copy where it is still needed.
    """
    body = free_name(docs, "_body")
    rows = docs.withColumn(body, F.col(quoted(text)).cast("binary")).drop(text)
    keep = [c for c in rows.columns if c != body]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [signed(fingerprint(v.as_py(), shingle)) for v in batch.column(body)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(values, pa.int64())], names=[*keep, name]
            )

    return rows.mapInArrow(compute, schema)


class BKTree:
    """Nodes by Hamming distance; a node is (value, children by distance)."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            if distance == 0:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            node, children = stack.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                yield node
            for edge in range(distance - radius, distance + radius + 1):
                child = children.get(edge)
                if child is not None:
                    stack.append(child)


def linked(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, representative) for every value that is within ``radius`` of another one, chained."""
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        if value in parent:
            continue
        parent[value] = value
        for other in tree.within(value, radius):
            a, b = find(value), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(v, r) for v in parent if (r := find(v)) != v]


def blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of ``radius + 2`` blocks."""
    edges = np.linspace(0, BITS, radius + 3).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(value: str, radius: int) -> str:
    """SQL: array of (kind, key), one per pair of blocks."""
    keys = []
    for kind, pair in enumerate(combinations(blocks(radius), 2)):
        mask = 0
        for low, width in pair:
            mask |= ((1 << width) - 1) << low
        keys.append(f"struct({kind} as kind, {value} & {signed(mask)}L as key)")
    return f"array({', '.join(keys)})"


def neighbour_keys(value: str, radius: int) -> str:
    """SQL: array of (kind, key), one per value within half of ``radius``."""
    flips = [0]
    for n in range(1, (radius + 1) // 2 + 1):
        flips += [sum(1 << b for b in bits) for bits in combinations(range(BITS), n)]
    listed = ", ".join(f"{signed(f)}L" if f != 1 << 63 else "-9223372036854775807L - 1L" for f in flips)
    return f"transform(array({listed}), f -> struct(-1 as kind, {value} ^ f as key))"


def _search(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within shards; ``rows``: kind, key, print."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(values: list[int]) -> None:
            if len(values) > 1:
                for a, b in linked(values, radius):
                    out_a.append(signed(a))
                    out_b.append(signed(b))

        def taken() -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64()) for x in (out_a, out_b)]
            out_a.clear()
            out_b.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

        out_a: list[int] = []
        out_b: list[int] = []
        shard, values = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("kind", "key", "print"))
            for kind, key, value in zip(*columns):
                if (kind, key) != shard:
                    links(values)
                    shard, values = (kind, key), []
                values.append(value & _ALL)
            if len(out_a) > 10_000:
                yield taken()
        links(values)
        yield taken()

    dealt = rows.repartition("kind", "key").sortWithinPartitions("kind", "key", "print")
    return dealt.mapInArrow(search, "a bigint, b bigint")


def links(prints: DataFrame, radius: int, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Links (a, b) that connect all of ``prints`` (distinct, column ``print``) within ``radius``."""
    keyed = prints.selectExpr("print", f"inline({shard_keys('print', radius)})")
    sizes = keyed.groupBy("kind", "key").agg(F.count("*").alias("n"))
    large = sizes.filter(f"n > {shard_nodes}").selectExpr("kind", "key", "true as large")
    marked = cut(attach(keyed, large, ["kind", "key"]), "shards")
    small = marked.filter("large is null").select("kind", "key", "print")
    crowded = marked.filter("large").select("print").distinct()
    near = crowded.selectExpr("print", f"inline({neighbour_keys('print', radius)})")
    return _search(small.unionByName(near.select("kind", "key", "print")), radius)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    radius: int = 2,
    shard_nodes: int = SHARD_NODES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row with ``fingerprint`` (hex), ``component_id`` and ``stays``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits,
    null if all are null; ``stays`` marks one row of each component, of its smallest id. A null or
    empty text has fingerprint zero and is linked like any other; a text of fewer words than
    ``shingle`` is one shingle. Repeated rows share a component. ``carry`` names the columns of
    ``docs`` in the result (the id always is); columns named like a result column are replaced.
    An empty table gives an empty result.
    """
    added = ["fingerprint", "component_id", "stays"]
    wanted = [c for c in dict.fromkeys([doc_id, *(carry or [])]) if c.lower() not in added]
    source = docs.select(
        F.struct(*[F.col(quoted(c)) for c in wanted]).alias("_row"),
        F.col(quoted(doc_id)).alias("_id"),
        F.col(quoted(text)).alias("_text"),
    )
    rows = cut(numbered(with_fingerprints(source, "_text", shingle, "print"), "_no"), "prints")
    least = "min(struct(_id is null as nameless, _id as id, _no as no)) as best"
    prints = cut(rows.groupBy("print").agg(F.expr(least)), "distinct")
    rooted = components(links(prints.select("print"), radius, shard_nodes))
    tied = prints.join(rooted.withColumnRenamed("node", "print"), "print", "left")
    tied = cut(tied.selectExpr("print", "best", "coalesce(root, print) as root"), "roots")
    best = tied.groupBy("root").agg(F.min("best").alias("first"))
    named = attach(tied.drop("best"), best, ["root"]).selectExpr(
        "print", "first.id as component_id", "first.no as _keep"
    )
    return attach(rows.drop("_id"), named, ["print"]).selectExpr(
        "_row.*", "lower(lpad(hex(print), 16, '0')) as fingerprint", "component_id", "_no = _keep as stays"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``."""
    name = free_name(docs, "_document")
    whole = docs.withColumn(name, F.struct(*[F.col(quoted(c)) for c in docs.columns]))
    marked = near_duplicates(whole, doc_id, text, shingle, radius, carry=[name])
    return marked.filter("stays").select(f"{name}.*")
