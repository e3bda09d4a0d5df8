import random

import xxhash
from llm_rows import by_row

from sitegrade.llm import simhash as S
from sitegrade.llm.components import components


def fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Smallest reachable value by comparing all pairs."""
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= radius and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def brute(rows, radius=2):
    prints = [fingerprint(t) for _, t in rows]
    root = groups(set(prints), radius)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        old = least.get(root[p])
        least[root[p]] = doc_id if old is None else old if doc_id is None else min(old, doc_id)
    return [(doc_id, f"{p:016x}", least[root[p]]) for (doc_id, _), p in zip(rows, prints)]


def near(rng, n):
    """Values in tight families, all bits used."""
    out = set()
    for _ in range(n):
        center = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            out.add(center ^ flips)
    return out


def test_links_lose_nothing(spark, edge):
    rng = random.Random(8)
    values = near(rng, 40) | {0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) + 3}
    prints = spark.createDataFrame([(S.signed(v),) for v in values], "print bigint").repartition(3)
    for radius, shard_nodes in ((2, 2048), (2, 3), (1, 2048), (1, 1), (0, 2048), (3, 2048)):
        found = {r.node: r.root for r in components(S.links(prints, radius, shard_nodes)).collect()}
        got, want = {}, {}
        for v, root in groups(values, radius).items():
            want.setdefault(root, set()).add(v)
            got.setdefault(found.get(S.signed(v), S.signed(v)), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(9)
    values = list(near(rng, 60))
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for query in values[::7] + [rng.getrandbits(64) for _ in range(50)]:
        for radius in (0, 2, 5):
            assert sorted(tree.within(query, radius)) == sorted(v for v in values if (v ^ query).bit_count() <= radius)


def test_edge_rows(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = S.near_duplicates(edge).collect()
    assert by_row((r.doc_id, r.fingerprint, r.component_id) for r in got) == by_row(brute(rows))
    kept = S.keep_one(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({b[2] if b[2] is not None else b[1] for b in brute(rows)})
    assert S.near_duplicates(nothing).collect() == [] and S.keep_one(nothing).collect() == []


def test_long_paths(spark, edge):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}
