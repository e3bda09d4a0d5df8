import itertools
from collections import defaultdict

import numpy as np

from sitegrade.llm import packing as P


def checked(got, sizes, lengths):
    """Every token once, no overlap, no bin over its length, and no shorter length would do."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        bins[r.bin_id].append((r.bin_start, r.n_tokens, r.bin_length))
    for doc_id, size in sizes.items():
        at = 0
        for start, n in sorted(pieces[doc_id]):
            assert start == at
            at += n
        assert at == size
    for parts in bins.values():
        at = 0
        for start, n, _ in sorted(parts):
            assert start == at
            at += n
        (length,) = {p[2] for p in parts}
        assert length == min(x for x in lengths if x >= at)
    return bins


def test_documents(spark, edge):
    rng = np.random.default_rng(3)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(1, 3000, 3000))} | {9000: 50_000, 9001: 0, 9002: 8192}
    docs = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n int").selectExpr("*", "'' as text").repartition(4)
    got = P.pack_documents(docs, tokens="n", shard_pieces=500).collect()
    bins = checked(got, sizes, P.LENGTHS)
    held = sum(sizes.values()) / sum(parts[0][2] for parts in bins.values())
    assert held > 0.95


def test_edge_rows(edge, nothing):
    got = P.pack_documents(edge).collect()
    assert len(got) >= edge.count() and P.pack_documents(nothing).collect() == []
    assert sum(r.n_tokens for r in got if r.doc_id is None) == 2 * 10 + 1
    assert [r.n_tokens for r in got if r.doc_id in (4, 5, 6)] == [1, 1, 1]
    longest = [r for r in got if r.doc_id == 7]
    assert sum(r.n_tokens for r in longest) == 180_001 and len(longest) == 22


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(4)
    lengths = (8, 16, 64)
    for n in (0, 1, 2, 50, 400):
        sizes = -np.sort(-rng.integers(0, 65, n))
        bins, starts, final = P.pack(sizes, lengths)
        used, room, rest = [], [], int(sizes.sum())
        for i, size in enumerate(map(int, sizes)):
            fits = [(room[b], b) for b in range(len(room)) if room[b] >= size and room[b] > 0]
            if fits:
                b = min(fits)[1]
            else:
                b = len(room)
                room.append(P.choose_length(size, rest, lengths))
                used.append(0)
            assert (bins[i], starts[i]) == (b, used[b])
            used[b] += size
            room[b] -= size
            rest -= size
        assert [int(f) for f in final] == [min(x for x in lengths if x >= used[b]) for b in bins]


def test_least_cost_length():
    lengths = P.LENGTHS
    for piece, fill in itertools.product((1, 500, 513, 8000), (1, 600, 5000, 10**6)):
        chosen = P.choose_length(piece, fill, lengths)
        assert chosen >= piece
        per_token = {x: P.cost(x) / min(x, max(piece, fill)) for x in lengths if x >= piece}
        assert per_token[chosen] == min(per_token.values())
