import math
from collections import Counter

import numpy as np

from sitegrade.llm import language as L

SF = "/root/testdata/sf0.001"


def plain_cells(text, bits):
    """Trigrams with a letter in the middle, one by one."""
    out, run = [], "".join(c if c.isalpha() else " " for c in text.lower())
    run = " " + " ".join(run.split()) + " "
    for i in range(len(run) - 2):
        if run[i + 1] != " ":
            a, b, c = (0 if x == " " else ord(x) for x in run[i : i + 3])
            h = ((a * 0x9E3779B1 + b) * 0x85EBCA77 + c) & (1 << 64) - 1
            out.append((h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits))
    return out


def test_trigrams_against_a_plain_loop():
    texts = ["", "a", "Ab c", "  x\ny  ", "éß 1,2 ñandú", "\x00a\x00b", "!!!", "ab" * 50, "日本語 text"]
    cells, sizes = L.trigram_cells(["ab", *texts], 14)
    assert cells[: sizes[0]].tolist() == plain_cells("ab", 14)
    cells, sizes = cells[sizes[0] :], sizes[1:]
    want = [plain_cells(t, 14) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert cells.tolist() == [c for w in want for c in w]


def test_held_out_documents(spark, edge):
    """Nothing is declared for every third document; its language is found all the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    partly = docs.selectExpr("doc_id", "text", "lang as truth", "if(doc_id % 3 = 0, null, lang) as lang", "source")
    got = L.identify_documents(partly).collect()
    hidden = [r for r in got if r.doc_id % 3 == 0]
    right = np.mean([r.language == r.truth for r in hidden if len(r.text) > 40])
    assert right > 0.97 and all(r.accepted for r in got)
    # A wrong declaration does not outweigh a long text.
    wrong = docs.selectExpr("doc_id", "text", "lang as truth", "if(doc_id % 50 = 0, 'fr', lang) as lang", "source")
    found = [r for r in L.identify_documents(wrong).collect() if len(r.text) > 400]
    assert all(r.language == r.truth for r in found)


def test_posterior_against_a_plain_sum(spark, edge):
    """Evidence of a few rows, fused step by step."""
    e = L.Evidence(languages=("en", "fr"))
    base = [("the house and the tree with", "en", "a.uk"), ("la maison et les arbres avec", "fr", "b.fr")] * 20
    rows = [(i, *r) for i, r in enumerate(base)] + [(90, "la the", None, "www.b.fr"), (91, "la the", None, None), (92, "1 2 3", "en", "a.uk")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    got = {r.doc_id: r for r in L.identify(docs, "text", "lang", "source", evidence=e).collect()}
    counts = np.full((2, 1 << e.cell_bits), e.smoothing)
    for _, text, lang, _ in rows:
        for c in plain_cells(text, e.cell_bits) if lang else ():
            counts[e.languages.index(lang), c] += 1
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def likely(text):
        cells = plain_cells(text, e.cell_bits)
        sums = [float(sum(m[c] for c in cells)) for m in model] + [-len(cells) * e.cell_bits * math.log(2)]
        return [x / (1 + len(cells) / e.saturation) for x in sums] if cells else None

    guess = [np.argmax(s) if (s := likely(t)) else None for _, t, _, _ in rows]
    totals = np.ones(3) + np.bincount([g for g in guess if g is not None], minlength=3)
    prior = totals / totals.sum()
    prior[-1] = e.undetermined
    prior /= prior.sum()

    def shrunk(names, parent):
        n = np.zeros(3)
        for g, (_, _, _, source) in zip(guess, rows):
            if g is not None and source in names:
                n[g] += 1
        return (n + e.host_weight * parent) / (n.sum() + e.host_weight)

    hosts = {r[3] for r in rows if r[3]}
    for doc_id in (90, 91):
        source = "www.b.fr" if doc_id == 90 else None
        total = np.array(likely("la the"))
        if source:
            domain = {h for h in hosts if ".".join(h.split(".")[-2:]) == "b.fr"}
            total += np.log(np.maximum(shrunk({source}, shrunk(domain, prior)), 1e-6))
            ending = Counter(g for g, r in zip(guess, rows) if g is not None and (r[3] or "").endswith(".fr"))
            total += [math.log((ending[i] + 1) / (totals[i] + 1)) for i in range(3)]
        else:
            total += np.log(prior)
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[doc_id].language == e.classes[int(np.argmax(total))]
        assert abs(got[doc_id].posterior - share.max()) < 1e-6
    assert (got[92].language, got[92].accepted) == ("und", False)


def test_pages(spark, edge):
    got = L.identify_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert all(f'lang="{r.language}"' in r.html[:60] for r in got)


def test_edge_rows(edge, nothing):
    got = L.identify_documents(edge, carry=["doc_id", "text"]).collect()
    assert len(got) == edge.count()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.language, r.posterior, r.accepted) == ("und", 1.0, False)
    kept = L.keep_accepted(edge)
    assert kept.columns == edge.columns and kept.count() <= edge.count() - 4
    assert L.identify_documents(nothing).collect() == [] and L.keep_accepted(nothing).collect() == []
