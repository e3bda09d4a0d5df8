import math

import numpy as np
import pytest
from llm_rows import by_row
from pyspark.sql import types as T

from sitegrade.llm import quantised as Q

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows, least=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    points = [(v and np.array(v, np.float64) if usable(v, label) else None) for _, v, label in rows]
    links = [set() for _ in rows]
    for i, (_, _, label) in enumerate(rows):
        for j in range(i):
            a, b = points[i], points[j]
            if a is None or b is None or label != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((vec_id, len(links[i]), least_id, vec_id is not None and vec_id == least_id))
    return by_row(out)


def near(rng, n, size, labels, noise):
    """Families of near copies: some links within, chains, exact copies, scaled copies."""
    out = []
    while len(out) < n:
        center = rng.normal(size=size)
        label = int(rng.integers(labels))
        for _ in range(int(rng.integers(1, 12))):
            v = center + noise * rng.normal(size=size)
            out.append((len(out), v.astype(np.float32).tolist(), label))
        if rng.random() < 0.3:
            out.append((len(out), out[-1][1], label))
            out.append((len(out), [float(np.float32(2 * x)) for x in out[-1][1]], label))
    return out


@pytest.mark.parametrize(
    "settings",
    [
        Q.Settings(),
        Q.Settings(list_rows=16, block_rows=8, code_sample=300, codewords=16, subspaces=4, reach=1.0),
        Q.Settings(list_rows=40, block_rows=10_000, max_lists=6, codewords=8, subspaces=3, reach=1.0),
    ],
)
def test_against_brute_force(spark, edge, settings):
    rng = np.random.default_rng(3)
    rows = near(rng, 500, 24, 2, 0.25)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = Q.near_duplicates(vectors, settings=settings).collect()
    assert by_row(map(tuple, got)) == brute(rows)
    assert sum(r.n_links for r in got) > 400


def test_one_large_family_in_blocks(spark, edge):
    """More near copies than a block holds: sums and components as by brute force."""
    rng = np.random.default_rng(4)
    center = rng.normal(size=16)
    rows = [(i, (center + 0.08 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(300)]
    settings = Q.Settings(list_rows=50, block_rows=20, reach=1.0)
    got = Q.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4), settings=settings)
    assert by_row(map(tuple, got.collect())) == brute(rows)


def test_recall_of_the_default_reach(spark, edge):
    """Vectors without any structure, links just above the threshold: the hardest case for lists."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    close = 0.931 * base + math.sqrt(1 - 0.931**2) * aside
    rows = [(i, v.tolist(), 7) for i, v in enumerate(np.concatenate([base, close]))]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    links = sum(r.n_links for r in Q.near_duplicates(vectors).collect())
    assert links >= 0.99 * 2 * len(base)


def test_lookup_keeps_every_near_code():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 20))
    book = Q.Codebook(points, Q.Settings(codewords=16, subspaces=5))
    codes, off = book.encode(points)
    whole = np.sqrt(((points[:50, None] - points[None]) ** 2).sum(2))
    looked_up = np.sqrt(book.lookup(points[:50], codes))
    assert (np.abs(looked_up - whole) <= off[None] + 1e-3).all()


def test_edge_rows(spark, edge):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (1, v, 1), (2, w, 1), (2, w, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1),
        (10, [float("inf"), 2.0, 3.0], 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1), (None, v, 1),
        (None, None, None), (None, None, None), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1),
        (15, [-0.0, 1.0, 0.0], 3), (16, [0.0, 1.0, 0.0], 3),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    clashing = vectors.selectExpr("*", *[f"'mine' as `{n}`" for n in ("n_links", "kept", "unit", "print", "id", "_row")])
    got = Q.near_duplicates(clashing, carry=["print", "kept"])
    assert got.columns == ["vec_id", "print", "n_links", "component_id", "kept"]
    assert by_row(tuple(r) for r in got.drop("print").collect()) == brute(rows)
    assert Q.keep_one(clashing).columns == clashing.columns
    none = clashing.filter("false")
    assert Q.near_duplicates(none).collect() == [] and Q.keep_one(none).collect() == []
