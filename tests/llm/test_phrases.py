import random
import re
from collections import Counter

import pytest
from llm_rows import by_row

from sitegrade.llm import phrases as P


def pieces_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, longest, min_count, top):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < min_count:
                continue
            inside = any(
                len(q) > len(p) and b >= min_count and b >= a
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in c.items()
            )
            if inside:
                continue
            score, cut = min((1000 * a * words[lang] // (c[p[:j]] * c[p[j:]]), j) for j in range(1, len(p)))
            found.append((score, a, " ".join(p), c[p[:cut]], c[p[cut:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        for rank, (score, a, phrase, left, right) in enumerate(found[:top], 1):
            out.append((lang, rank, phrase, a, left, right, words[lang], score))
    return by_row(out)


def texts(rng, n):
    """A few words, so that everything repeats; passages, runs of one word, all piece ends."""
    words = ["alpha", "Beta", "gämma", "δ", "e-mail", "zeta7", "the", "of"]
    passage = "one Two three four five six seven eight nine"
    out = []
    for i in range(n):
        parts = [rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", ". ", "\n", "\x0b", "\r", "; "]) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), passage + rng.choice([" ", ". "]))
        if i % 10 == 0:
            parts.append("the " * 12)
        out.append((rng.choice(["en", "de", None]), "".join(parts)))
    return out


@pytest.mark.parametrize(("longest", "min_count", "bits"), [(5, 4, 24), (5, 4, 9), (3, 2, 12), (4, 30, 16)])
def test_against_brute_force(spark, edge, longest, min_count, bits):
    rows = texts(random.Random(longest * min_count), 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = P.collocations(docs, longest=longest, min_count=min_count, top=60, sketch_bits=bits)
    got = by_row(tuple(r)[:-1] for r in found.collect())
    assert got == brute(rows, longest, min_count, 60)
    assert got


def test_counts_across_flushes(spark, edge, monkeypatch):
    """The same with tiny buffers: pieces stay whole, nothing is lost or counted twice."""
    rows = texts(random.Random(5), 150)
    want = Counter()
    for lang, text in rows:
        for w in pieces_of(text):
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    want[(lang or "und", " ".join(w[i : i + k]), k)] += 1
    for name in ("_CHUNK", "_FLUSH_WORDS", "_FLUSH_ALL", "_CACHE"):
        monkeypatch.setattr(P, name, 7)
    held = {}
    lists = P._word_lists((lang or "und", text.encode()) for lang, text in rows)
    for lang, words in lists:
        held.setdefault(lang, []).extend(words)
    got = Counter()
    for lang, words in held.items():
        for piece in b" ".join(words).decode().split("\n"):
            w = piece.split(" ")
            w = [x for x in w if x]
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    got[(lang, " ".join(w[i : i + k]), k)] += 1
    assert got == want


def test_passages(spark, edge):
    """A passage repeated in many texts is one path; branches and equal counts decide its ends."""
    passage = [f"p{i}" for i in range(40)]
    rows = [("en", f"start{i} " + " ".join(passage) + f" end{i}") for i in range(6)]
    rows += [("en", " ".join(passage[:20]))] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    counts = P.phrase_counts(docs, min_count=3)
    paths = P.passages(counts)
    found = P.passage_texts(paths).collect()
    assert by_row((r.text, r.words, r.f) for r in found) == by_row(
        [(" ".join(passage[:20]), 20, 8), (" ".join(passage[16:]), 24, 6)]
    )
    long = spark.createDataFrame([("en", " ".join(f"w{i}" for i in range(3000)))] * 3, "lang string, text string")
    parts = P.passage_texts(P.passages(P.phrase_counts(long, min_count=3))).orderBy("segment").collect()
    assert [r.segment for r in parts] == [0, 1, 2] and {r.words for r in parts} == {3000}
    assert " ".join(r.text for r in parts) == " ".join(f"w{i}" for i in range(3000))


def test_edge_rows(edge, nothing):
    rows = [(r.lang, r.text) for r in edge.select("lang", "text").collect()]
    counts = {(r.lang, r.phrase): r.f for r in P.phrase_counts(edge, min_count=2).collect()}
    want, totals = Counter(), Counter()
    for lang, text in rows:
        for w in pieces_of(text):
            totals[lang or "und"] += len(w)
            for k in range(1, 6):
                want.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    expected = {key: n for key, n in want.items() if n >= 2}
    expected |= {(lang, ""): n for lang, n in totals.items() if n}
    assert {k: v for k, v in counts.items() if v or k[1]} == expected
    assert P.collocations(nothing).collect() == []
    assert P.collocations(edge.filter("text is null")).collect() == []


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", "", 0, 10**13), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, k int, f bigint")
    [row] = P._scored(counts, 5).collect()
    assert row.score == 1000 * (big - 1) * 10**13 // (big * (big + 1))
