import random
import re

from llm_rows import by_row
from pyspark.sql import functions as F

from sitegrade.llm import exact_dedup as X


def brute(rows):
    """Sorted (doc_id, keep_id, size, kept) of (doc_id, text) rows, by comparing whole texts."""
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append(i)
    out = []
    for members in groups.values():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            same = rows[i][0] == rows[best][0] and len(rows[i][1] or "") == len(rows[best][1] or "")
            out.append((rows[i][0], rows[best][0], len(members), same))
    return out


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = X.exact_duplicates(edge).collect()
    assert by_row((r.doc_id, r.keep_id, r.group_size) for r in got) == by_row(b[:3] for b in brute(rows))
    # One row per group stays, also of repeated rows.
    assert sum(r.kept for r in got) == len({re.sub(r"\s", "", t or "") for _, t in rows})
    assert all((r.doc_id, r.keep_id, r.group_size, True) in brute(rows) for r in got if r.kept)


def test_keep_one_keeps_all_columns(edge):
    kept = X.keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows if r.doc_id} >= {2, 7, 8, 9, 10, 11}
    # One row per distinct text, and each is a row that the marks allow to stay.
    plain = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows]
    marks = brute([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    assert len(plain) == len(set(plain)) == len({(keep, size) for _, keep, size, stays in marks if stays})
    assert {(r.doc_id) for r in rows} <= {doc_id for doc_id, _, _, stays in marks if stays}


def test_keep_one_of_rows_that_agree_in_everything(spark):
    rows = [(7, "same words"), (7, "same words"), (None, "x y"), (None, "x y"), (3, "samewords"), (8, "alone"), (8, "other")]
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id or 0, r.text) for r in X.keep_one(docs).collect())
    assert got == [(0, "x y"), (7, "same words"), (8, "alone"), (8, "other")]


def test_empty_table(nothing):
    assert X.exact_duplicates(nothing).collect() == []
    assert X.keep_one(nothing).collect() == []


def test_chunks_give_back_the_text(spark):
    random.seed(5)
    texts = ["".join(random.choices("abdetu éß\n.", k=n)) for n in (0, 1, 511, 512, 5000, 40_000)]
    chunking = X.Chunking(smallest=16, largest=256)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    listed = X.recipes(docs, "text", chunking).select("doc_id", F.posexplode("recipe").alias("pos", "c"))
    store = {bytes(r.digest): r.chunk for r in X.chunk_store(docs, "text", chunking).collect()}
    parts = {}
    for r in listed.collect():
        parts.setdefault(r.doc_id, []).append((r.pos, store[bytes(r.c.digest)]))
    for i, text in enumerate(texts):
        assert "".join(c for _, c in sorted(parts.get(i, []))) == re.sub(r"\s", "", text)
    sizes = [len(c) for p in parts.values() for _, c in p]
    assert max(sizes) <= 256 and len(sizes) > 200


def test_equal_passages_give_equal_chunks(spark):
    random.seed(6)
    common = "".join(random.choices("abcdetu", k=20_000))
    docs = spark.createDataFrame([(1, "x" + common), (2, "different start " + common)], "doc_id bigint, text string")
    one, two = (
        {bytes(c.digest) for c in r.recipe} for r in X.recipes(docs, "text").orderBy("doc_id").collect()
    )
    assert len(one & two) > 0.8 * len(one)


def test_no_python_in_the_plan(edge):
    plan = X.exact_duplicates(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
