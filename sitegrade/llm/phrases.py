"""Phrase collocations from a weighted de Bruijn graph of word grams.

A text is split into pieces and those into words. Every position of a piece opens one gram: the
longest, of ``longest`` words, or a shorter one where the piece ends. Longest grams are the edges
of the graph, each from the node of its first to the node of its last ``longest - 1`` words. Only
the grams are counted over the corpus, once. A shorter phrase occurs as often as the grams
that begin with it: the flow out of its nodes plus the grams that piece ends cut short. Grams are
dealt by language and their first two words, so that all these sums stay where the grams are.

Unary paths: where an edge brings the whole flow of a node and another takes all of it away, the
two are one. ``passages`` compacts such chains (pointer doubling, so the rounds grow with the
logarithm of the longest) into texts with one weight: what a corpus repeats word for word.

Work is saved, and never a result, by a sketch of fixed size: a first pass counts the hashes of all
adjacent word pairs in ``2 ** sketch_bits`` cells. A cell below ``min_count`` proves that its pairs
are in no candidate, so the second pass ends grams there. A phrase of frequent pairs still has all
its occurrences. In a corpus so large that all cells reach the count, the sketch saves nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.llm.shared import cut, numbered, quoted
from sitegrade.operators.keyed import attach

NO_LANG = "und"
SKETCH_BITS = 24
SLICES = 64
SEGMENT = 1024  # edges of a passage that are put together in one row

_END = b"\n"
# Upper case to lower case, tab to space, everything that ends a piece to a line feed.
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n"
)
_CHUNK = 1 << 20
_FLUSH_WORDS, _FLUSH_ALL, _FLUSH_GRAMS, _CACHE = 1 << 16, 1 << 20, 1 << 19, 1 << 20


class _Codes(dict):
    """Hash of a word, never zero; the end of a piece is zero."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        code = 0 if word == _END else xxhash.xxh64_intdigest(word, 1) | 1
        self[word] = code
        return code


def _word_lists(texts: Iterator[tuple[str, bytes | None]]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) with a line feed after each piece; whole pieces, about a flush at a time."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for lang, text in texts:
        data = text.translate(_TABLE) if text else b""
        start = 0
        while start < len(data):
            end = data.find(_END, start + _CHUNK)
            end = len(data) if end < 0 else end
            words = held.setdefault(lang, [])
            before = len(words)
            for piece in data[start:end].split(_END):
                found = piece.split()
                if found:
                    words += found
                    words.append(_END)
            total += len(words) - before
            start = end + 1
            if len(words) >= _FLUSH_WORDS:
                total -= len(words)
                yield lang, held.pop(lang)
            if total > _FLUSH_ALL:
                yield from held.items()
                held, total = {}, 0
    yield from held.items()


def _pair_cells(words: list[bytes], lang: str, codes: _Codes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(is word i + 1 in the same piece as word i, cell of this pair) for all but the last word."""
    hashes = np.fromiter((codes[w] for w in words), np.uint64, len(words))
    first, second = hashes[:-1], hashes[1:]
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(xxhash.xxh64_intdigest(lang, 2))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (first != 0) & (second != 0), (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("body")):
            yield lang.as_py(), text.as_py()


def frequent_cells(rows: DataFrame, min_count: int, bits: int) -> bytes:
    """A bit per cell of the sketch: set where its pairs occur ``min_count`` times or more together.

    Each task counts into a fixed array; counts are cut at the threshold before they are added,
    which changes no bit. The driver gets ``2 ** bits / 8`` bytes at any corpus size.
    """
    top = min(min_count, 1 << 15)
    size = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, codes = np.zeros(1 << bits, np.uint32), _Codes()
        for lang, words in _word_lists(_texts(batches)):
            inside, cell = _pair_cells(words, lang, codes, bits)
            np.add.at(cells, cell[inside], 1)
        kept = np.minimum(cells, top).astype("<u2").reshape(SLICES, size)
        for number, part in enumerate(kept):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "cells"]
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                values = np.frombuffer(part.as_py(), "<u2")
                old = sums.get(number)
                sums[number] = values.copy() if old is None else np.minimum(old + values, top)
        bitmaps = [np.packbits(v >= top, bitorder="little").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(bitmaps, pa.binary())], names=["slice", "bitmap"]
        )

    counted = rows.mapInArrow(count, "slice int, cells binary").repartition(SLICES, "slice")
    found = {r["slice"]: bytes(r["bitmap"]) for r in counted.mapInArrow(add, "slice int, bitmap binary").collect()}
    return b"".join(found.get(i, bytes(size // 8)) for i in range(SLICES))


def count_grams(rows: DataFrame, longest: int, bitmap: bytes, bits: int) -> DataFrame:
    """(lang, gram, k, n): what each task has counted of grams of ``k`` words.

    ``k`` from 2 to ``longest``: the gram each position opens. ``k`` = 1: every word. ``k`` = 0:
    all words of a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, codes = np.frombuffer(bitmap, np.uint8), _Codes()
        counts: dict[str, list[Counter]] = {}
        held = 0

        def taken() -> Iterator[pa.RecordBatch]:
            for lang, levels in counts.items():
                for k, level in enumerate(levels):
                    names, values = list(level), list(level.values())
                    for i in range(0, len(names), 1 << 16):
                        part = names[i : i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(part), pa.string()),
                                pa.array(part, pa.binary()).cast(pa.string()),
                                pa.array(np.full(len(part), k, np.int32)),
                                pa.array(values[i : i + (1 << 16)], pa.int64()),
                            ],
                            names=["lang", "gram", "k", "n"],
                        )
            counts.clear()

        for lang, words in _word_lists(_texts(batches)):
            inside, cell = _pair_cells(words, lang, codes, bits)
            linked = inside & (allowed[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            # Words of the gram that opens here: one more for each linked pair that follows.
            length = np.ones(len(words), np.int8)
            more = linked
            for step in range(1, longest):
                length[: len(more)] += more
                more = more[:-1] & linked[step:]
            levels = counts.setdefault(lang, [Counter() for _ in range(longest + 1)])
            before = sum(map(len, levels))
            levels[1].update(words)
            levels[0][b""] += len(words) - levels[1].pop(_END, 0)
            for k in range(2, longest + 1):
                places = np.flatnonzero(length == k).tolist()
                levels[k].update([b" ".join(words[i : i + k]) for i in places])
            held += sum(map(len, levels)) - before
            if held > _FLUSH_GRAMS:
                yield from taken()
                held = 0
        yield from taken()

    return rows.mapInArrow(count, "lang string, gram string, k int, n bigint")


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 5,
    min_count: int = 100,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """(lang, phrase, k, f): phrases of 2 to ``longest`` words and single words with ``f >= min_count``.

    The row with ``k`` = 0 of each language holds the number of all its words. A null text counts
    as empty, a null language as ``und``; repeated rows count each time; an empty table gives an
    empty result. Texts are read whole; memory holds one piece at least.
    """
    rows = docs.select(
        F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.col(quoted(text)).cast("binary").alias("body"),
    )
    grams = count_grams(rows, longest, frequent_cells(rows, min_count, sketch_bits), sketch_bits)
    head = "substring_index(gram, ' ', 2) as head"
    dealt = grams.selectExpr("*", head).repartition("lang", "head")
    # No exchange from here to the end: all groups lie within language and first two words.
    edges = dealt.groupBy("lang", "head", "gram", "k").agg(F.sum("n").alias("n"))
    flow = edges.selectExpr("lang", "head", "gram", "n", "explode(sequence(least(k, 2), k)) as k")
    flow = flow.selectExpr("lang", "head", "substring_index(gram, ' ', k) as phrase", "k", "n")
    sums = flow.groupBy("lang", "head", "phrase", "k").agg(F.sum("n").alias("f"))
    kept = sums.filter(f"k = 0 or f >= {int(min_count)}").select("lang", "phrase", "k", "f")
    return cut(kept, "phrases")


def passages(counts: DataFrame, longest: int = 5) -> DataFrame:
    """(lang, edge, passage, place, words): the unary path that each frequent edge lies on.

    ``passage`` numbers the path, ``place`` is the edge's place on it from 0, ``words`` how many
    words the whole path has. Paths have no cycles: every occurrence of a node on one would need
    another one before it in the same piece.
    """
    edges = counts.filter(f"k = {longest}").selectExpr(
        "lang", "phrase as edge", "f",
        f"substring_index(phrase, ' ', {longest - 1}) as source",
        f"substring_index(phrase, ' ', -{longest - 1}) as target",
    )
    edges = cut(numbered(edges, "id"), "edges")
    nodes = counts.filter(f"k = {longest - 1}").selectExpr("lang", "phrase as node", "f")
    into = edges.selectExpr("lang", "target as node", "f", "id as before")
    out = edges.selectExpr("lang", "source as node", "f", "id as after")
    on = ["lang", "node", "f"]
    joints = nodes.join(into, on).join(out, on).filter("before <> after").select("before", "after")
    # Each edge points to one before it, `steps` further back each round.
    ways = edges.select("id").join(joints.selectExpr("after as id", "before as back"), "id", "left")
    ways = cut(ways.selectExpr("id", "coalesce(back, id) as back", "if(back is null, 0L, 1L) as steps"), "ways")
    while True:
        further = ways.selectExpr("id as back", "back as _back", "steps as _steps")
        ways = cut(
            ways.join(further, "back").selectExpr("id", "_back as back", "steps + _steps as steps", "_steps > 0 as open"),
            "ways",
        )
        if not ways.agg(F.bool_or("open")).first()[0]:
            break
    sizes = ways.groupBy("back").agg((F.max("steps") + longest).alias("words"))
    placed = attach(ways.drop("open"), sizes, ["back"])
    return edges.join(placed, "id").selectExpr("lang", "edge", "back as passage", "steps as place", "words", "f")


def passage_texts(paths: DataFrame) -> DataFrame:
    """(lang, passage, segment, text, words, f): the compacted paths as texts.

    A row holds at most ``SEGMENT`` edges of a path; segment 0 begins with a whole edge, every
    further edge adds its last word.
    """
    parts = paths.selectExpr(
        "lang", "passage", f"place div {SEGMENT} as segment", "words", "f",
        "struct(place, if(place = 0, edge, substring_index(edge, ' ', -1)) as added) as part",
    )
    joined = parts.groupBy("lang", "passage", "segment", "words", "f").agg(
        F.expr("array_join(transform(array_sort(collect_list(part)), p -> p.added), ' ')").alias("text")
    )
    return joined.select("lang", "passage", "segment", "text", "words", "f")


def _scored(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate, by its lowest-scoring cut."""
    known = counts.filter("k > 0").selectExpr("lang", "phrase as part", "f")
    splits = counts.filter("k > 1").selectExpr("lang", "phrase", "f as a", "k", "explode(sequence(1, k - 1)) as at")
    splits = splits.selectExpr(
        "lang", "phrase", "a", "at",
        "substring_index(phrase, ' ', at) as `left`", "substring_index(phrase, ' ', at - k) as `right`",
    )
    for side, name in (("left", "l"), ("right", "r")):
        splits = attach(splits, known.selectExpr("lang", f"part as `{side}`", f"f as {name}"), ["lang", side])
    words = counts.filter("k = 0").selectExpr("lang", "f as n")
    wide = {c: f"cast({c} as decimal(20, 0))" for c in "anlr"}
    score = f"(cast(1000 as decimal(4, 0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})"
    splits = attach(splits, words, ["lang"]).selectExpr("*", f"{score} as score")
    best = splits.groupBy("lang", "phrase").agg(F.expr("min(struct(score, at, a, l, r, n))").alias("best"))
    return best.selectExpr("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def _within_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a candidate that is one word longer.

    Counts fall with every word added, so no longer candidate needs a look.
    """
    longer = counts.filter("k > 2").selectExpr(
        "lang",
        "explode(array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))) as phrase",
        "f",
    )
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 5,
    min_count: int = 100,
    top: int | None = 2000,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """Each language's ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score, passage_words.

    The score is ``floor(1000 * a * n / (l * r))`` of the cut that scores lowest, in exact numbers.
    Phrases inside a longer one that occurs as often are left out. ``passage_words`` is the
    length of the repeated passage (unary path) a phrase of ``longest`` words lies on, else null.
    Ties in score go to the more frequent, then to the first phrase in UTF-8 order. Nulls, empty
    texts and empty tables: see :func:`phrase_counts`.
    """
    counts = phrase_counts(docs, text, lang, longest, min_count, sketch_bits)
    scored = attach(_scored(counts, longest), _within_longer(counts), ["lang", "phrase"])
    kept = scored.filter("longer is null or longer < a").drop("longer")
    order = "row_number() over (partition by lang order by score desc, a desc, phrase) as rank"
    ranked = kept.selectExpr("*", order)
    if top is not None:
        ranked = ranked.filter(f"rank <= {int(top)}")
    paths = passages(counts, longest).selectExpr("lang", "edge as phrase", "words as passage_words")
    return ranked.join(paths, ["lang", "phrase"], "left").selectExpr(
        "lang", "cast(rank as bigint) as rank", "phrase", "a", "l", "r", "n", "score", "passage_words"
    )
