import hashlib
import math
import random
import re

from llm_rows import by_row

from sitegrade.llm import pii as P

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(text):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits(text)))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


TESTS = {
    "email": lambda t: True,
    "ip": lambda t: all(int(p) <= 255 for p in t.split(".")),
    "card": lambda t: 16 <= len(digits(t)) <= 19 and luhn(t),
    "phone": lambda t: 8 <= len(digits(t)) <= 15,
}


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if TESTS[k](m[0])]


def test_patterns_match_the_plain_ones():
    rng = random.Random(11)
    parts = ["a", "b.c", "@", ".", "-", " ", "1", "25", "255", "300", "+", "(", ")", "é", "%", "_", "\n", "0",
             "4111111111111111", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+49 30 1234567"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for part in ("a", "1", "1.", "+", "@", "a@", "1 ", "+1(", "a@b."):
        P.base_spans(part * 300_000)


def test_long_runs_of_zeros():
    for n in (3, 10_000, 1_000_000):
        text = "0" * n + "1.2.3.4 1." + "0" * n + ".3.255 1.2.3." + "0" * n + "256"
        got = [(s, e) for k, s, e in P.base_spans(text) if k == "ip"]
        first, second = n + 7, n + 8 + n + 8
        assert got == [(0, first), (first + 1, second)], n


def made(spark):
    """A nickname that stands near one address only, among many other texts."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{say(5)} zorbax {say(3)} jo.doe@mail.example {say(6)}") for i in range(12)]
    rows += [(100 + i, say(40)) for i in range(300)]
    copied = f"{say(4)} qwertix {say(2)} ann@mail.example {say(4)}"
    rows += [(1000 + i, copied) for i in range(50)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows


def test_disclosing_terms(spark, edge):
    docs, rows = made(spark)
    found = {r.doc_id: r for r in P.find_personal_data(docs).collect()}
    for i, text in rows:
        r = found[i]
        assert [tuple(s) for s in r.base_spans] == brute(text)
        terms = {r.text[s.start : s.end] for s in r.term_spans}
        assert terms == ({"zorbax"} if i < 12 else set()), (i, terms)  # copies are one use
    cleaned = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert "zorbax" not in cleaned[3] and "[EMAIL]" in cleaned[3] and cleaned[100] == rows[12][1]


def test_edge_rows_and_digest(spark, edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    rows += [(50, "call +49 (30) 123-4567 or a@b.co, 10.0.0.1; 4111 1111 1111 1111"), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = P.find_personal_data(docs, carry=["doc_id"]).selectExpr("doc_id", *P.digest_columns()).collect()
    want = []
    for i, text in rows:
        spans = brute(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = [sum(k == kind for k, _, _ in spans) for kind in P.KINDS]
        want.append((i, *counts, hashlib.sha256(listed.encode()).hexdigest(), listed))
    assert by_row(got) == by_row(want)
    assert P.find_personal_data(edge).count() == edge.count()
    assert P.find_personal_data(nothing).collect() == [] and P.sanitise(nothing).collect() == []


WORD = re.compile(r"[^\W\d_]{3,}")


def terms_by_hand(rows, s):
    """Row number -> (kind, start, end) of the terms, by plain loops and dictionaries."""
    near, contexts, corpus, total = {}, {}, {}, 0
    places = []
    for no, (_, text) in enumerate(rows):
        text = text or ""
        total += text.count(" ") + 1
        spans = brute(text)
        every = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        for i, (_, _, w) in enumerate(every):
            corpus.setdefault(w, set()).add((every[i - 1][2] if i else "", every[i + 1][2] if i + 1 < len(every) else ""))
        free = [w for w in every if not any(a < w[1] and w[0] < b for _, a, b in spans)]
        for kind, a, b in spans:
            entity = (kind, text[a:b].lower())
            middle = sum(w[0] < a for w in free)
            low, high = max(0, middle - s.window), min(len(free), middle + s.window)
            if low < high:  # a context without words tells nothing
                contexts.setdefault(entity, set()).add(tuple(w[2] for w in free[low:high]))
            for i in range(low, high):
                use = (free[i - 1][2] if i else "", free[i + 1][2] if i + 1 < len(free) else "")
                near.setdefault((entity, free[i][2]), set()).add(use)
                places.append((no, entity, free[i]))
    best = {}
    for no, entity, (start, end, term) in places:
        n_te = len(near[entity, term])
        if n_te < s.support:
            continue
        n_t = max(len(corpus[term]), n_te)
        ratio = 1 + math.log(n_te / n_t) / math.log(max(total / len(contexts[entity]), 2.0))
        if ratio >= s.generalise:
            best[no, start, end] = max(best.get((no, start, end), 0), ratio)
    out = {}
    for (no, start, end), ratio in best.items():
        out.setdefault(no, set()).add(("removed" if ratio >= s.remove else "generalised", start, end))
    return out


def planted():
    """Many addresses, shared words, copies, all kinds."""
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    people = [f"{w}@mail{i % 3}.example" for i, w in enumerate(words[:9])] + ["10.0.0.1", "+49 30 1234567"]
    nicks = {p: f"nick{chr(97 + i)}" for i, p in enumerate(people)}
    rows = []
    for i in range(260):
        p = rng.choice(people)
        parts = rng.choices(words, k=rng.randint(0, 12))
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, len(parts)), nicks[p] if rng.random() < 0.8 else nicks[rng.choice(people)])
        if rng.random() < 0.7:
            parts.insert(rng.randint(0, len(parts)), p)
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(None, None), (5000, "")]
    return rows


def test_terms_against_plain_loops(spark, edge):
    """Every ratio near its thresholds counts."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    seen = set()
    for s in (P.Disclosure(), P.Disclosure(window=4, support=2, generalise=0.6, remove=0.8)):
        want = terms_by_hand(rows, s)
        assert want
        for r in P.find_personal_data(docs, settings=s).collect():
            for no, (i, text) in enumerate(rows):
                if i == r.doc_id and text == r.text:
                    found = {tuple(x) for x in r.term_spans}
                    assert found == want.get(no, set()), (r.doc_id, r.text)
                    seen |= {k for k, _, _ in found}
    assert seen == {"generalised", "removed"}
