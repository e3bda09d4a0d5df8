import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrade.llm import toxicity as X

HELD = "crc32(cast(doc_id as string)) % 4 = 2"
INSULTS = ["grumblewit", "snorfhead", "plonker"]


def spelt(word, rng):
    """The word with characters put in between."""
    how = rng.randrange(4)
    if how == 0:
        return word
    if how == 1:
        return " ".join(word)
    if how == 2:
        return ".".join(word)
    at = rng.randrange(2, len(word) - 2)
    return word[:at] + rng.choice("xz*7-") + word[at:]


def made(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioutrslnmd", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(20, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                body.insert(rng.randrange(len(body)), spelt(rng.choice(INSULTS), rng))
        body[rng.randrange(len(body))] += "."
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"),
    )


def test_held_out_texts(spark, edge):
    docs, labels = made(1200, 21)
    got = X.score_toxicity(*tables(spark, docs, labels), HELD).filter("held_out").collect()
    toxic = [r.score for r in got if r.doc_id % 4 == 0]
    clean = [r.score for r in got if r.doc_id % 4]
    assert len(got) > 200
    above = np.mean([t > c for t in toxic for c in clean])
    assert above > 0.97
    assert np.mean([t >= 0.3 for t in toxic]) > 0.9 and np.mean([c >= 0.3 for c in clean]) < 0.05


def plain_kernel(a, b, decay=0.6):
    """All four-letter subsequences within six letters, by enumeration."""
    from itertools import combinations

    def features(s):
        out = {}
        for places in combinations(range(len(s)), X.ORDER):
            span = places[-1] - places[0] + 1
            if span <= X.SPAN:
                key = "".join(s[p] for p in places)
                out[key] = out.get(key, 0) + decay ** (span - X.ORDER)
        return out

    f, g = features(a), features(b)
    size = (sum(x * x for x in f.values()) * sum(x * x for x in g.values())) ** 0.5
    return sum(w * g.get(k, 0) for k, w in f.items()) / size if size else 0


def test_kernel_against_enumeration():
    rng = random.Random(22)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcde", k=rng.randint(0, 10))) for _ in range(2))
        got = X.kernel(X.features(a, 0.6), X.features(b, 0.6))
        assert got == pytest.approx(plain_kernel(a, b))


def test_sentences_against_plain_strings():
    """Vectorised values equal those of each sentence's strings, one by one."""
    rng = random.Random(23)
    s = X.Settings(least=0.25)
    landmarks = X.Landmarks(["grumblewit", "snorfhead", "plonker"], s)
    vectors = [X.features(x, s.decay) for x in landmarks.strings]
    texts = [t for _, t in made(60, 24)[0]] + ["", "g r u m b l e w i t", "Plonker! you. PLON-KER 7?\nok", "x" * 3000]
    owner, values = landmarks.sentences(texts)
    got = {}
    for t, row in zip(owner.tolist(), values):
        got[t] = np.maximum(got.get(t, 0), row)
    for t, text in enumerate(texts):
        best = np.zeros(3)
        for string in X.strings_of(text):
            own = X.features(string, s.decay)
            size = landmarks.sizes(np.array([len(string)]))[0]
            for i, other in enumerate(vectors):
                norm = sum(w * w for w in other.values()) ** 0.5
                value = min(sum(w * other.get(k, 0.0) for k, w in own.items()) / (size * norm), 1.0)
                best[i] = max(best[i], value if value >= s.least else 0.0)
        assert np.allclose(got.get(t, np.zeros(3)), best), text
    assert rng


def test_edge_rows(spark, edge, nothing):
    docs, labels = made(200, 25)
    _, known = tables(spark, docs, labels)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 5), (3, 1), (3, 0)], "doc_id bigint, toxic int")
    got = X.score_toxicity(edge, known.unionAll(odd), HELD, carry=["doc_id"]).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert X.score_toxicity(nothing, known, HELD).collect() == []
    for few in (known.filter("false"), known.filter("toxic = 0"), known.filter("toxic = 1")):
        flat = X.score_toxicity(edge, few, HELD, carry=["doc_id"]).collect()
        assert len({r.score for r in flat}) == 1


def test_text_ids(spark, edge):
    """Ids that are no numbers give the scores that numbers give."""
    docs, labels = made(200, 25)
    table, known = tables(spark, docs, labels)
    want = {r.doc_id: r.score for r in X.score_toxicity(table, known, "false", carry=["doc_id"]).collect()}
    named = [t.withColumn("doc_id", F.expr("concat('d-', doc_id)")) for t in (table, known)]
    got = {r.doc_id: r.score for r in X.score_toxicity(*named, "false", carry=["doc_id"]).collect()}
    assert got == {f"d-{k}": pytest.approx(v) for k, v in want.items()}
