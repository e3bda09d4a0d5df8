import hashlib
import random
from collections import Counter

import pytest
from llm_rows import by_row

from sitegrade.llm import alignment as A


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    paths = A.Vocabularies()
    first = Tokenizer.from_file(paths.a)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=paths.b)


def brute(rows, models):
    """Token by token, with byte offsets of the whole text."""
    first, second = models
    letters = A.byte_alphabet()
    names = {i: t for t, i in first.get_vocab().items()}

    def bytes_b(i):
        piece = second.id_to_piece(i)
        if len(piece) == 6 and piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    texts = []
    for _, text in rows:
        if not text:
            texts.append(None)
            continue
        data = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        parts_a = [bytes(letters[c] for c in names[i]) for i in a]
        parts_b = [bytes_b(i) for i in b]
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            texts.append(None)
            continue
        ends = []
        for parts in (parts_a, parts_b):
            at, here = 0, []
            for p in parts:
                at += len(p)
                here.append(at)
            ends.append(here)
        links = [(i, j) for i, e in zip(a, ends[0]) for j, f in zip(b, ends[1]) if e == f] if len(a) < 400 else None
        if links is None:
            by_end = dict(zip(ends[1], b))
            links = [(i, by_end[e]) for i, e in zip(a, ends[0]) if e in by_end]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, ia, ib = [], 0, 0
        for cut in shared:
            ga, gb = [], []
            while ia < len(a) and ends[0][ia] <= cut:
                ga.append(str(a[ia]))
                ia += 1
            while ib < len(b) and ends[1][ib] <= cut:
                gb.append(str(b[ib]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        texts.append((len(a), len(b), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(link for t in texts if t for link in t[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (doc_id, _), t in zip(rows, texts):
        if t is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = t[3]
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out.append((doc_id, t[0], t[1], t[2], len(links), n_best, sum(counts[x] for x in links), t[4]))
    return by_row(out)


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41> stay text", "ﬁ ligature ½ ² Å", "tab\tand\nlines \r\n\r\n  end  ", "▁ itself",
    "　wide　space hard", "混合テキスト and English", "\U0001f600\U0001f468‍\U0001f469", "a" * 500, " ", "  lead", "\x00nul\x01",
    "it's we'll I'M 3.14159 100,000", "é combining", "﻿bom", "don't  stop   now    ok", "\x85next\x1cseparator",
]


def found(docs, **more):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return by_row(tuple(r) for r in A.align_tokenizers(docs, **more).select(*names).collect())


@pytest.mark.parametrize("segment", [1 << 16, 40])
def test_against_brute_force(spark, edge, models, segment):
    """Segments of 40 characters give what whole texts give."""
    rng = random.Random(2)
    words = "the of unbelievable Tokenization antidisestablishmentarianism été naïve x1 3,000 www.example.org/path".split()
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(40)]
    rows += [(200 + i, t + " " + rows[20 + i][1]) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(docs, segment=segment) == brute(rows, models)


def test_edge_rows(edge, nothing, models):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert found(edge) == brute(rows, models)
    got = A.align_tokenizers(edge, carry=["score", "n_words"])
    assert got.columns[:3] == ["doc_id", "score", "n_words"]
    assert A.align_tokenizers(nothing).collect() == []


def test_bytes_that_are_no_text(spark, edge):
    docs = spark.sql("select 1L as doc_id, unhex('61FF62') as text union all select 2L, cast('ab' as binary)")
    assert sorted(r.n_a > 0 for r in A.align_tokenizers(docs).collect()) == [False, True]


def test_segments_give_the_text_back():
    text = " " + "some words, here and there " * 50
    parts = A.segments(text, True, 30)
    assert "".join(parts) == text and len(parts) > 20 and all(p.startswith(" ") for p in parts)
    assert A.segments(text, False, 30) == [text]
    assert A.segments(" " + "x" * 1000, True, 30) == [" " + "x" * 1000]
