"""The pipeline and the registered queries, against brute-force versions on the smallest tables."""

import os
import re

import pytest
from llm_rows import by_row
from test_decontaminate import brute as brute_hits
from test_exact_dedup import brute as brute_copies
from test_packing import checked
from test_simhash import brute as brute_near

import __spark_entry__ as entry
import corpus_pipeline
from sitegrade.llm import packing
from sitegrade.llm.oracle import ORACLES
from sitegrade.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert {int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14))


def test_stages(spark, edge):
    """Each stage on what its predecessor kept: nothing else is lost, nothing dropped stays."""
    docs = table(spark, "documents")
    bench = [tuple(r) for r in table(spark, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "best-fit packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = list(before.items())
        if name == "language id":
            keep = {i for i, t in rows if any(c.isalpha() for c in t)}
        elif name == "exact dedup":
            keep = {i for i, k, _, kept in brute_copies(rows) if kept and i == k}
        elif name == "simhash near-dedup":
            keep = {i for i, _, component in brute_near(rows) if i == component}
        elif name == "benchmark decontamination":
            keep = {r[0] for r in brute_hits(rows, bench, 13) if not r[5]}
        else:
            sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for i, t in rows}
            checked(out.collect(), sizes, packing.LENGTHS)
            continue
        got = out.collect()
        assert sorted(r.doc_id for r in got) == sorted(keep), name
        assert all(r.text == before[r.doc_id] for r in got)
        docs = out


def test_pipeline_takes_edge_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() == 0) == (docs.filter("doc_id is not null").count() == 0)


def test_run_packs_every_kept_document_once(spark, edge):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and len({(r.doc_id, r.piece) for r in got}) == len(got)


@pytest.mark.parametrize("name", ORACLES)
def test_query_against_sql(spark, edge, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = df.select(*columns).collect()
    assert sorted(df.columns) == sorted(columns)
    assert by_row(got) == by_row(cursor.fetchall())


def test_contract_queries(spark, edge):
    """Queries without SQL, by brute force over the whole smallest tables."""
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    bench = [tuple(r) for r in table(spark, "benchmark").collect()]
    hits = entry.queries()["op3_decontamination"](spark, SF)
    assert by_row(hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == by_row(
        brute_hits(docs, bench, 13)
    )
    near = entry.queries()["op10_simhash_near_dedup"](spark, SF)
    assert by_row(near.select("doc_id", "fingerprint", "component_id").collect()) == by_row(brute_near(docs))
    pii = entry.queries()["op2_pii"](spark, SF).collect()
    assert len(pii) == len(docs)
    toxic = entry.queries()["op4_toxicity"](spark, SF).collect()
    assert len(toxic) == len(docs) and all(0 <= r.score <= 1 for r in toxic)
