"""Near duplicates among embeddings by product quantisation with coarse inverted lists.

Only vectors of equal label and length are compared. Equal directions are one node with a weight, so
copies cost nothing. A label with many nodes is cut into inverted lists around coarse centroids; a
node's residual to the centroid of its list is coded by one codeword number per subspace. A query
probes its own list and every list whose border lies within ``reach``, looks the distance of every
code up in its table, and takes the exact cosine where the distance may be small enough.

* The table lookup loses nothing: a code that is off its vector by ``e`` is kept up to the distance
  of the least cosine plus ``e``.
* Only probing can lose a link, and only between nodes of different lists. ``reach`` is the distance
  from a query to the border (bisector) of a neighbouring list, in units of the largest distance of a
  link. 1 loses nothing; with the default 0.3 a link is missed only if more than 0.3 of the largest
  difference points straight across the border, from both sides. For d dimensions that is
  0.3 * sqrt(d) standard deviations of a difference without preferred direction.

A list is dealt in blocks of at most about ``block_rows`` members; visitors stream past a block. Tasks
report sums per node and a spanning forest of the links, never the pairs, so a hot label or a
large group of near copies is shared out and no group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.components import components
from sitegrade.llm.shared import cut, free_name, numbered, quoted
from sitegrade.operators.keyed import attach


@dataclass(frozen=True)
class Settings:
    """``max_lists`` and the sample bounds fix the size of all models, whatever the input."""

    least: float = 0.93
    reach: float = 0.3
    list_rows: int = 256  # nodes a list should hold, while there are fewer than max_lists lists
    block_rows: int = 2048
    max_lists: int = 4096
    sample_bytes: int = 32 << 20  # of vectors, for the coarse centroids
    code_sample: int = 8192  # residuals the codewords are fitted on
    subspaces: int = 8
    codewords: int = 256
    rounds: int = 8
    seed: int = 13


_BATCH = 256  # visitors looked up at once
_PAIRS = 1 << 14  # exact cosines at once, where candidates are sparse


# ---- vectors and nodes ------------------------------------------------------------------------


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    vectors = vectors / np.abs(vectors).max(1)[:, None]  # no overflow or underflow in the norm
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _unit(values: pa.ListScalar) -> np.ndarray | None:
    """The unit vector, None where there is none."""
    items = values.values
    if items is None or len(items) == 0 or items.null_count:
        return None
    vector = np.asarray(items.to_numpy(zero_copy_only=False), np.float64)
    if not np.isfinite(vector).all() or not vector.any():
        return None
    return _units(vector[None])[0]


def _read_vectors(source: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``vector`` (its numbers as bytes, null where a row links with nothing), ``size``
    and ``print``, which is equal for equal directions.
    """
    fields = [source.schema[c] for c in keep]
    schema = T.StructType(
        [
            *fields,
            T.StructField("vector", T.BinaryType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("print", T.BinaryType()),
        ]
    )
    element = source.schema["_vector"].dataType.elementType
    width = np.float32 if isinstance(element, T.FloatType) else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").is_valid().to_pylist()
            units = [_unit(v) if known else None for v, known in zip(batch.column("_vector"), labels)]
            # Adding zero turns -0.0 into 0.0.
            prints = [
                None if u is None else hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest() for u in units
            ]
            vectors = [
                None if u is None else v.values.to_numpy(zero_copy_only=False).astype(width).tobytes()
                for v, u in zip(batch.column("_vector"), units)
            ]
            sizes = [None if u is None else len(u) for u in units]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array(vectors, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(prints, pa.binary()),
                ],
                names=[*keep, "vector", "size", "print"],
            )

    return source.mapInArrow(read, schema)


def _matrix(vectors, size: int) -> np.ndarray:
    """Unit vectors of length ``size`` from their bytes, which are floats or doubles."""
    data = b"".join(vectors)
    width = np.float32 if len(data) == 4 * size * len(vectors) else np.float64
    return _units(np.frombuffer(data, width).reshape(len(vectors), size).astype(np.float64))


# ---- models -----------------------------------------------------------------------------------


def fit_centroids(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's k-means; centroids that lose all points keep their place."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centers))
        filled = sizes > 0
        centers[filled] = sums[filled] / sizes[filled, None]
    return centers


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _nearest(points: np.ndarray, centers: np.ndarray, step: int = 1024) -> np.ndarray:
    parts = [_squares(points[i : i + step], centers).argmin(1) for i in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Codebook:
    """Codewords per subspace for vectors of one length."""

    def __init__(self, residuals: np.ndarray, settings: Settings) -> None:
        size = residuals.shape[1]
        self.parts = [p for p in np.array_split(np.arange(size), min(settings.subspaces, size))]
        self.words = [
            fit_centroids(residuals[:, p], settings.codewords, settings.rounds, settings.seed + i)
            for i, p in enumerate(self.parts)
        ]

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector from its code)."""
        codes = np.empty((len(residuals), len(self.parts)), np.uint8)
        squares = np.zeros(len(residuals))
        for i, (part, words) in enumerate(zip(self.parts, self.words)):
            distance = _squares(residuals[:, part], words)
            codes[:, i] = distance.argmin(1)
            squares += distance[np.arange(len(residuals)), codes[:, i]]
        return codes, np.sqrt(squares)

    def lookup(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of whole queries to coded vectors, by one table per subspace."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (part, words) in enumerate(zip(self.parts, self.words)):
            table = _squares(queries[:, part], words).astype(np.float32)
            total += table.take(codes[:, i], axis=1)
        return total


def _probes(points: np.ndarray, centers: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(own list, other lists whose border is within ``limit``) of each point."""
    squares = _squares(points, centers)
    own = squares.argmin(1)
    between = np.sqrt(_squares(centers, centers))
    excess = squares - squares[np.arange(len(points)), own][:, None]
    near = excess <= 2 * limit * between[own]
    near[np.arange(len(points)), own] = False
    return own, [np.flatnonzero(row) for row in near]


# ---- index ------------------------------------------------------------------------------------

_GROUP = ["label", "size"]


def _train(nodes: DataFrame, settings: Settings) -> tuple[dict, dict]:
    """(centroids by label and length, codebooks by length), both of bounded size."""
    sizes = cut(nodes.groupBy(*_GROUP).agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = max(settings.list_rows, -(-total // settings.max_lists))
    # At most ``max_lists`` rows, as each of these groups holds more than total / max_lists nodes:
    # this bounds the broadcast below and the centroids that reach the driver.
    large = sizes.filter(f"n > {rows}").withColumn("lists", F.expr(f"ceil(n / {rows})"))
    largest = (large.agg(F.max("size")).first()[0] or 1) * 8
    covered = large.agg(F.sum("n")).first()[0] or 0
    # The print is a hash, so its bytes choose a sample that is the same on every run.
    spot = "cast(conv(hex(substr(print, 1, 4)), 16, 10) as bigint)"

    def share(rows_wanted: int, of: int) -> str:
        return f"{spot} < {int(2**32 * min(1.0, rows_wanted / max(of, 1)))}"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        points = _matrix(list(pdf["vector"]), int(first["size"]))
        centers = fit_centroids(points, int(first["lists"]), settings.rounds, settings.seed)
        return pd.DataFrame(
            {
                "label": [first["label"]],
                "size": [first["size"]],
                "centers": [centers.astype("<f8").tobytes()],
            }
        )

    label = nodes.schema["label"].dataType.simpleString()
    sampled = nodes.join(F.broadcast(large.select(*_GROUP, "lists")), _GROUP).filter(
        share(settings.sample_bytes // largest, covered)
    )
    fitted = sampled.groupBy(*_GROUP).applyInPandas(fit, f"label {label}, size int, centers binary")
    lists = {
        (r["label"], r["size"]): np.frombuffer(bytes(r["centers"]), "<f8").reshape(-1, r["size"])
        for r in fitted.collect()
    }
    residuals: dict[int, list[np.ndarray]] = {}
    for r in nodes.filter(share(settings.code_sample, total)).select(*_GROUP, "vector").toLocalIterator():
        point = _matrix([bytes(r["vector"])], r["size"])[0]
        centers = lists.get((r["label"], r["size"]))
        if centers is not None:
            point = point - centers[_nearest(point[None], centers)[0]]
        residuals.setdefault(r["size"], []).append(point)
    return lists, {size: Codebook(np.array(found), settings) for size, found in residuals.items()}


def _indexed(nodes: DataFrame, lists: dict, books: dict, settings: Settings) -> DataFrame:
    """Every node with its list, the other lists it probes, its code and the code's distance."""
    limit = settings.reach * np.sqrt(2 - 2 * settings.least)
    keep = ["id", "label", "size", "weight", "vector"]
    schema = T.StructType(
        [
            *(nodes.schema[c] for c in keep),
            T.StructField("home", T.IntegerType()),
            T.StructField("others", T.ArrayType(T.IntegerType())),
            T.StructField("code", T.BinaryType()),
            T.StructField("off", T.DoubleType()),
        ]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist())):
                    groups.setdefault(key, []).append(i)
                vectors = batch.column("vector").to_pylist()
                home, others, code, off = ([None] * len(vectors) for _ in range(4))
                for key, places in groups.items():
                    points = _matrix([vectors[i] for i in places], key[1])
                    centers = lists.get(key)
                    own, near = np.zeros(len(places), np.int64), [np.empty(0, np.int64)] * len(places)
                    if centers is not None:
                        own, near = _probes(points, centers, limit)
                    book = books.get(key[1])
                    if book is not None:
                        codes, offs = book.encode(points if centers is None else points - centers[own])
                    for j, i in enumerate(places):
                        home[i], others[i] = int(own[j]), near[j].tolist()
                        if book is not None:
                            code[i], off[i] = codes[j].tobytes(), float(offs[j])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in keep),
                        pa.array(home, pa.int32()),
                        pa.array(others, pa.list_(pa.int32())),
                        pa.array(code, pa.binary()),
                        pa.array(off, pa.float64()),
                    ],
                    names=[*keep, "home", "others", "code", "off"],
                )

    return nodes.select(*keep).mapInArrow(index, schema)


# ---- search -----------------------------------------------------------------------------------


class _Block:
    """The members of one block of a list, and what has been found for them."""

    def __init__(self, key: tuple, rows: pd.DataFrame, lists: dict, books: dict, settings: Settings) -> None:
        self.list, self.settings = key[2], settings
        centers = lists.get(key[:2])
        self.center = np.zeros(key[1]) if centers is None else centers[key[2]]
        self.ids, self.weights = rows["id"].to_numpy(), rows["weight"].to_numpy()
        self.size = key[1]
        self.units = _matrix(list(rows["vector"]), key[1])
        self.probed = [set(o) for o in rows["others"]]
        self.book = books.get(key[1])
        if self.book is not None:
            self.codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            off = rows["off"].to_numpy(np.float64) + np.sqrt(2 - 2 * settings.least)
            self.most = ((off + 1e-5) ** 2 * (1 + 1e-5)).astype(np.float32)
        self.sums = np.zeros(len(rows), object)
        self.parent = np.arange(len(rows))

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _pairs(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, member) of cosine ``least`` and above."""
        if self.book is None:
            return np.nonzero(units @ self.units.T >= self.settings.least)
        near = self.book.lookup(units - self.center, self.codes) <= self.most
        i, j = np.nonzero(near)
        if len(i) > near.size // 16:
            good = (units @ self.units.T)[i, j] >= self.settings.least
            return i[good], j[good]
        good = np.zeros(len(i), bool)
        for s in range(0, len(i), _PAIRS):
            a, b = units[i[s : s + _PAIRS]], self.units[j[s : s + _PAIRS]]
            good[s : s + _PAIRS] = np.einsum("ij,ij->i", a, b) >= self.settings.least
        return i[good], j[good]

    def visit(self, rows: pd.DataFrame) -> tuple[list, list, list]:
        """(ids, link sums) of the visitors, and links (a, b) that tie them to the block."""
        ids, homes, weights = rows["id"].to_numpy(), rows["home"].to_numpy(), rows["weight"].to_numpy()
        i, j = self._pairs(_matrix(list(rows["vector"]), self.size))
        other = ids[i] != self.ids[j]
        i, j = i[other], j[other]
        found, sums, edges = [], [], []
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for start, end in zip(starts, [*starts[1:], len(i)]):
            visitor, members = i[start], j[start:end]
            found.append(int(ids[visitor]))
            sums.append(int(self.weights[members].sum()))
            edges.append((int(ids[visitor]), int(self.ids[members[0]])))
            root = self._find(members[0])
            for m in members[1:]:
                other_root = self._find(m)
                if other_root != root:
                    self.parent[max(root, other_root)] = min(root, other_root)
                    root = min(root, other_root)
            # A member that does not probe the visitor's list won't meet it there.
            home = int(homes[visitor])
            if home != self.list:
                for m in members:
                    if home not in self.probed[m]:
                        self.sums[m] += int(weights[visitor])
        return found, sums, edges

    def rest(self) -> tuple[list, list, list]:
        held = np.flatnonzero(self.sums > 0)
        ties = [(int(self.ids[m]), int(self.ids[r])) for m in range(len(self.ids)) if (r := self._find(m)) != m]
        return self.ids[held].tolist(), [int(s) for s in self.sums[held]], ties


def _search(indexed: DataFrame, lists: dict, books: dict, settings: Settings) -> DataFrame:
    """(a, b, n): a link between nodes ``a`` and ``b``, or, with ``b`` null, ``n`` links of ``a``."""
    members = indexed.groupBy("label", "size", "home").agg(F.count("*").alias("n"))
    # Only lists of more than one block are named.
    long = members.filter(f"n > {settings.block_rows}").selectExpr(
        "label", "size", "home as list", f"cast(ceil(n / {settings.block_rows}) as int) as blocks"
    )
    at = ["label", "size", "list"]
    placed = attach(indexed.selectExpr("*", "explode(concat(array(home), others)) as list"), long, at)
    block = "cast(pmod(xxhash64(id), coalesce(blocks, 1)) as int)"
    # A node is a member of one block of its list, where members also meet each other. It visits the
    # other blocks of its list and all blocks of the other lists it probes.
    there = f"""transform(sequence(0, coalesce(blocks, 1) - 1),
        b -> struct(b as block, list = home and b = {block} as member))"""
    dealt = placed.selectExpr(*at, f"inline({there})", "id", "home", "weight", "vector", "others", "code", "off")
    for name in ("others", "code", "off"):
        dealt = dealt.withColumn(name, F.expr(f"if(member, {name}, null)"))
    dealt = dealt.repartition(*at, "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, sums: list, edges: list) -> pa.RecordBatch:
            a = [*ids, *(x for x, _ in edges)]
            b = [*([None] * len(ids)), *(y for _, y in edges)]
            n = [*sums, *([None] * len(edges))]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

        def open_block(key: tuple, waiting: list) -> tuple[_Block | None, list]:
            """The block of the members that have come, and what they find among themselves."""
            if not waiting:
                return None, []
            own = pd.concat(waiting)
            block = _Block(key, own, lists, books, settings)
            return block, [block.visit(own.iloc[s : s + _BATCH]) for s in range(0, len(own), _BATCH)]

        key, block, waiting, opened = None, None, [], False
        for batch in batches:
            frame = batch.to_pandas()
            keys = list(zip(*(frame[c].tolist() for c in (*at, "block"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = frame.iloc[start:end]
                if keys[start] != key:
                    if not opened:
                        block, found = open_block(key, waiting)
                        yield from (out(*f) for f in found)
                    if block is not None:
                        yield out(*block.rest())
                    key, block, waiting, opened = keys[start], None, [], False
                inside = part[part["member"]]
                if len(inside):
                    waiting.append(inside)
                visitors = part[~part["member"]]
                if len(visitors):
                    if not opened:
                        block, found = open_block(key, waiting)
                        yield from (out(*f) for f in found)
                        waiting, opened = [], True
                    # A list that nothing belongs to may still be probed.
                    for s in range(0, len(visitors) if block is not None else 0, _BATCH):
                        yield out(*block.visit(visitors.iloc[s : s + _BATCH]))
        if not opened:
            block, found = open_block(key, waiting)
            yield from (out(*f) for f in found)
        if block is not None:
            yield out(*block.rest())

    ordered = dealt.sortWithinPartitions(*at, "block", F.col("member").desc())
    return ordered.mapInArrow(search, "a bigint, b bigint, n bigint")


# ---- result -----------------------------------------------------------------------------------


def near_duplicates(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    settings: Settings = Settings(),
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` and ``kept``.

    Two rows are linked when labels are equal and not null, lengths are equal, and the cosine in
    double precision is ``settings.least`` or more. Vectors that are null, empty, zero or hold a null
    or a value that is not finite link with nothing: their component is their own id. ``component_id``
    is the smallest id that links reach (null if all are null), ``kept`` tells whether it is the row's
    own. Repeated rows count as vectors of their own. ``carry`` names the columns of ``rows`` in
    the result (the id always is); columns named like a result column are replaced. An empty table
    gives an empty result.
    """
    added = ["n_links", "component_id", "kept"]
    wanted = [c for c in dict.fromkeys([vec_id, *(carry or [])]) if c.lower() not in added]
    source = rows.select(
        F.struct(*[F.col(quoted(c)) for c in wanted]).alias("_row"),
        F.col(quoted(vec_id)).alias("_id"),
        F.col(quoted(label)).cast("string").alias("label"),
        F.col(quoted(vector)).alias("_vector"),
    )
    read = cut(_read_vectors(source, ["_row", "_id", "label"]), "vectors")
    grouped = (
        read.filter("print is not null")
        .groupBy("label", "size", "print")
        .agg(F.any_value("vector").alias("vector"), F.count("*").alias("weight"), F.min("_id").alias("first"))
    )
    nodes = cut(numbered(grouped, "id"), "nodes")
    lists, books = _train(nodes, settings)
    indexed = cut(_indexed(nodes, lists, books, settings), "index")
    found = cut(_search(indexed, lists, books, settings), "links")
    sums = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    rooted = components(found.filter("b is not null").select("a", "b")).withColumnsRenamed({"node": "id"})
    named = nodes.select("id", *_GROUP, "print", "weight", "first").join(rooted, "id", "left")
    named = cut(named.withColumn("root", F.expr("coalesce(root, id)")), "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = attach(attach(named, least, ["root"]).withColumnRenamed("id", "a"), sums, ["a"])
    per_node = named.selectExpr("label", "print", "component", "weight - 1 + coalesce(n, 0L) as n")
    own = attach(read.select("_row", "_id", "label", "print"), per_node, ["label", "print"])
    return own.selectExpr(
        "_row.*",
        "coalesce(n, 0L) as n_links",
        "if(n is null, _id, component) as component_id",
        "coalesce(_id = if(n is null, _id, component), false) as kept",
    )


def keep_one(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The rows whose id is the smallest of their component, with the columns of ``rows``."""
    name = free_name(rows, "_whole")
    whole = rows.withColumn(name, F.struct(*[F.col(quoted(c)) for c in rows.columns]))
    return near_duplicates(whole, vec_id, vector, label, carry=[name]).filter("kept").select(f"{name}.*")
