"""Alignment of two tokenizers over a corpus: which tokens end at the same byte, and how often.

Everything inside a task is Arrow: token lists are flattened with their parent indices, byte ends are
cumulative sums of token lengths less the start of the segment, an Acero hash join on (segment, end)
finds the links, and ``Table.group_by`` counts id pairs. Spark adds these partial counts up. Each text
is encoded once; its links are written as distinct pairs with their number.

Before a space between two characters that are no white space both vocabularies always end a token
(checked when they are loaded), so neither tokens nor groups cross such a place. Texts are cut there:
into parts of bounded size, so that memory holds a part and the pairs of one text, and those into words,
of which each different one is encoded and joined once per part. Where a script or a vocabulary has
no such places, a text is one word.

The table of pair counts reaches every task. Its size is bounded by the vocabularies and not by the
corpus: of two tokens that end together the shorter one is a suffix of the longer, so an id has no
more partners than its token has bytes (times two, as a byte may have two ids).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, quoted

_SEGMENT_CHARS = 1 << 20
_FLUSH_CHARS = 1 << 22
# Latin letters and ASCII are no white space to anyone; other characters stay uncut.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLACE = re.compile(f"(?<=[!-~{_LETTERS}])(?= [0-9{_LETTERS}])")


@dataclass(frozen=True)
class Vocabularies:
    """Paths that every executor can open."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


# ---- vocabularies -----------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible, else one from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _load(paths: Vocabularies):
    """(encode A, encode B, token bytes of A, of B, whether texts may be cut)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(paths.a)
    first.encode_special_tokens = True
    letters = byte_alphabet()
    table_a: list[bytes] = [b""] * (max(first.get_vocab().values()) + 1)
    for entry, number in first.get_vocab().items():
        known = all(c in letters for c in entry)
        table_a[number] = bytes(letters[c] for c in entry) if known else entry.encode()
    second = sentencepiece.SentencePieceProcessor(model_file=paths.b)
    table_b, whole = [], True
    for number in range(second.get_piece_size()):
        piece = second.id_to_piece(number)
        whole = whole and "▁" not in piece.lstrip("▁")
        table_b.append(
            bytes([int(piece[1:-1], 16)]) if second.is_byte(number) else piece.replace("▁", " ").encode()
        )
    set_up = json.loads(first.to_str())
    words = set_up["pre_tokenizer"] or {}
    cuttable = whole and words.get("type") == "ByteLevel" and words.get("use_regex") and not set_up["normalizer"]

    def encode_a(parts: list[str]) -> list[list[int]]:
        return [e.ids for e in first.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_b(parts: list[str]) -> list[list[int]]:
        return second.encode([p[1:] for p in parts], num_threads=1)  # it adds the space itself

    return encode_a, encode_b, pa.array(table_a, pa.binary()), pa.array(table_b, pa.binary()), bool(cuttable)


def segments(text: str, cuttable: bool, size: int = _SEGMENT_CHARS) -> list[str]:
    """``text`` in parts of about ``size`` characters; every part begins with a space, as ``text`` does."""
    parts, start = [], 0
    while cuttable and len(text) - start > size:
        place = _PLACE.search(text, start + size)
        if place is None:
            break
        parts.append(text[start : place.start()])
        start = place.start()
    return [*parts, text[start:]]


# ---- words ------------------------------------------------------------------------------------


def _tokens(lists: list[list[int]], table: pa.BinaryArray) -> tuple[pa.Table, pa.Array]:
    """((seg, end, id) of every token in order, bytes of every segment)."""
    ids = pa.array(lists, pa.list_(pa.int32()))
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    text = table.take(flat)
    running = pc.cumulative_sum(pc.binary_length(text).cast(pa.int64()))
    # Segmented sum: less what had run up when the segment began.
    starts = ids.offsets.to_numpy()[:-1]
    base = np.r_[0, running.to_numpy()][starts]
    ends = pc.subtract(running, pa.array(base).take(parent))
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, text), b"")
    return pa.table({"seg": parent, "end": ends, "id": flat}), joined


def _listed(ids: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
    """The ids of each group as decimal numbers with commas; ``group`` does not fall."""
    offsets = np.searchsorted(group, np.arange(groups + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids).cast(pa.string())), ",")


@dataclass
class _Aligned:
    """Per word or segment: whether it is whole, numbers of tokens, groups and links, groups as text;
    and its id pairs, by number of the word or segment.
    """

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    texts: pa.StringArray
    pairs: pa.Table  # seg, code, times


def _align_words(words: list[str], paths: Vocabularies) -> _Aligned:
    encode_a, encode_b, table_a, table_b, _ = _load(paths)
    n = len(words)
    data = pa.array([w.encode() for w in words], pa.binary())
    a, bytes_a = _tokens(encode_a(words), table_a)
    b, bytes_b = _tokens(encode_b(words), table_b)
    whole = pc.and_(pc.equal(bytes_a, data), pc.equal(bytes_b, data))
    a, b = (t.filter(whole.take(t["seg"])) for t in (a, b))
    links = a.rename_columns(["seg", "end", "a"]).join(
        b.rename_columns(["seg", "end", "b"]), ["seg", "end"], join_type="inner", use_threads=False
    )
    # Ends as places in all segments one after the other, so that one search serves all.
    lengths = pc.binary_length(data).to_numpy().astype(np.int64)
    begin = np.r_[0, np.cumsum(lengths)]

    def places(table: pa.Table) -> np.ndarray:
        return begin[table["seg"].to_numpy()] + table["end"].to_numpy()

    cuts = np.unique(places(links))
    listed = [
        _listed(t["id"].to_numpy(), np.searchsorted(cuts, places(t)), len(cuts)) for t in (a, b)
    ]
    groups = pc.binary_join_element_wise(*listed, "|")
    seg_of_cut = np.searchsorted(begin, cuts, side="left") - 1
    bounds = np.searchsorted(seg_of_cut, np.arange(n + 1)).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), groups), ";")

    def per_segment(values) -> np.ndarray:
        return np.bincount(values, minlength=n)

    code = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), 32), links["b"].cast(pa.int64()))
    pairs = pa.table({"seg": links["seg"], "code": code}).group_by(["seg", "code"], use_threads=False)
    return _Aligned(
        whole.to_numpy(zero_copy_only=False),
        per_segment(a["seg"].to_numpy()),
        per_segment(b["seg"].to_numpy()),
        np.diff(bounds),
        per_segment(links["seg"].to_numpy()),
        texts,
        pairs.aggregate([([], "count_all")]).rename_columns(["seg", "code", "times"]),
    )


def align(parts: list[str], paths: Vocabularies) -> _Aligned:
    """Segments, by way of their different words."""
    cuttable = _load(paths)[4]
    lists = pa.array([_PLACE.split(p) if cuttable else [p] for p in parts], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    found = _align_words(coded.dictionary.to_pylist(), paths)
    word, offsets = coded.indices.to_numpy(), lists.offsets
    starts = offsets.to_numpy()[:-1]

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[word], starts)

    # The pairs of every word of every segment, one after the other.
    pairs = found.pairs.sort_by("seg")
    sizes = np.bincount(pairs["seg"].to_numpy(), minlength=len(found.whole))
    first = np.cumsum(sizes) - sizes
    each = sizes[word]
    place = np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    expanded = pa.table(
        {
            "seg": np.repeat(pc.list_parent_indices(lists).to_numpy(), each),
            "code": pairs["code"].to_numpy()[place],
            "times": pairs["times"].to_numpy()[place],
        }
    )
    return _Aligned(
        np.logical_and.reduceat(found.whole[word], starts),
        *(total(v) for v in (found.n_a, found.n_b, found.n_groups, found.n_links)),
        pc.binary_join(pa.ListArray.from_arrays(offsets, found.texts.take(coded.indices)), ";"),
        expanded.group_by(["seg", "code"], use_threads=False)
        .aggregate([("times", "sum")])
        .rename_columns(["seg", "code", "times"]),
    )


# ---- texts ------------------------------------------------------------------------------------


class _Text:
    """What the segments of one text have added up to."""

    def __init__(self) -> None:
        self.whole, self.begun = True, False
        self.numbers = np.zeros(4, np.int64)
        self.digest = hashlib.sha256()
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, found: _Aligned, i: int) -> None:
        self.whole = self.whole and bool(found.whole[i])
        if self.whole:
            self.numbers += [found.n_a[i], found.n_b[i], found.n_groups[i], found.n_links[i]]
            self.digest.update(((";" if self.begun else "") + found.texts[i].as_py()).encode())
            self.begun = True

    def row(self) -> tuple:
        if not (self.whole and self.begun):
            return (0, 0, 0, 0, "", [], [])
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.int64)
        times = np.concatenate(self.times) if self.times else np.empty(0, np.int64)
        if len(self.codes) > 1:
            codes, place = np.unique(codes, return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, place, times)
            times = sums
        return (*self.numbers.tolist(), self.digest.hexdigest(), codes, times)


_FIELDS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]
_ARROW = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_SPARK = [*[T.LongType()] * 4, T.StringType(), *[T.ArrayType(T.LongType())] * 2]


def _decoded(text: bytes | None) -> str | None:
    """None where there is nothing to encode: null, empty, or bytes that are no UTF-8."""
    try:
        return text.decode() if text else None
    except UnicodeDecodeError:
        return None


def _aligned_rows(texts: list[bytes | None], paths: Vocabularies, segment: int) -> list[tuple]:
    states = [_Text() for _ in texts]
    parts: list[str] = []
    owner: list[int] = []

    def flush() -> None:
        if not parts:
            return
        found = align(parts, paths)
        for i, o in enumerate(owner):
            states[o].add(found, i)
        seg = found.pairs["seg"].to_numpy()
        order = np.argsort(np.asarray(owner)[seg], kind="stable")
        owners = np.asarray(owner)[seg][order]
        codes, times = found.pairs["code"].to_numpy()[order], found.pairs["times"].to_numpy()[order]
        for o in np.unique(owners).tolist():
            low, high = np.searchsorted(owners, [o, o + 1])
            states[o].codes.append(codes[low:high])
            states[o].times.append(times[low:high])
        parts.clear()
        owner.clear()

    cuttable, held = _load(paths)[4], 0
    for i, data in enumerate(texts):
        text = _decoded(data)
        if text is None:
            continue
        for part in segments(" " + text, cuttable, segment):
            parts.append(part)
            owner.append(i)
            held += len(part)
            if held >= _FLUSH_CHARS:
                flush()
                held = 0
    flush()
    return [s.row() for s in states]


def encoded(
    docs: DataFrame, text: str, keep: list[str], paths: Vocabularies, segment: int = _SEGMENT_CHARS
) -> DataFrame:
    """``keep`` with the numbers of each text and its distinct id pairs (``codes``, ``times``)."""
    rows = docs.withColumn("_body", F.col(quoted(text)).cast("binary")).select(*keep, "_body")
    schema = T.StructType([*(rows.schema[c] for c in keep), *map(T.StructField, _FIELDS, _SPARK)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 2048):
                batch = whole.slice(start, 2048)
                found = list(zip(*_aligned_rows(batch.column("_body").to_pylist(), paths, segment)))
                arrays = [pa.array(list(values), kind) for values, kind in zip(found, _ARROW)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), *arrays], names=[*keep, *_FIELDS]
                )

    return rows.mapInArrow(encode, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best) of every id pair that is linked anywhere in the corpus.

    ``best`` marks the pairs that no other pair of the same B id exceeds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"code": batch.column("codes").flatten(), "n": batch.column("times").flatten()})
            summed = table.group_by("code", use_threads=False).aggregate([("n", "sum")])
            yield from summed.rename_columns(["code", "n"]).combine_chunks().to_batches()

    partial = rows.select("codes", "times").mapInArrow(count, "code bigint, n bigint")
    counts = partial.groupBy("code").agg(F.sum("n").alias("n"))
    counts = cut(counts.selectExpr("code", "code & 4294967295L as b", "n"), "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").selectExpr("code", "shiftright(code, 32) as a", "b", "n", "n = highest as best")


def align_tokenizers(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    paths: Vocabularies = Vocabularies(),
    carry: list[str] | None = None,
    segment: int = _SEGMENT_CHARS,
) -> DataFrame:
    """Every row with the numbers of its tokens, groups and links, and how its links stand in the corpus.

    ``n_best`` counts links whose pair count is the highest of their B id, ``count_sum`` adds the
    pair counts of all links. ``groups_sha256`` is the digest of the groups as text. Texts that are
    null, empty, no UTF-8, or that either tokenizer does not give back byte for byte, have zeros and an
    empty digest and no part in the counts. Repeated rows count each time. ``carry`` names the
    columns of ``docs`` in the result (the id always is); columns named like a result column are
    replaced. An empty table gives an empty result.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted = [c for c in dict.fromkeys([doc_id, *(carry or [])]) if c.lower() not in added]
    source = docs.select(
        F.struct(*[F.col(quoted(c)) for c in wanted]).alias("_row"), F.col(quoted(text)).alias("_text")
    )
    rows = cut(encoded(source, "_text", ["_row"], paths, segment), "links")
    counts = pair_counts(rows).select("code", "n", "best").orderBy("code").toArrow()
    codes, n = counts["code"].to_numpy(), counts["n"].to_numpy()
    best = counts["best"].to_numpy().astype(np.int64)
    keep = ["_row", *_FIELDS[:5]]
    schema = T.StructType(
        [
            *(rows.schema[c] for c in keep),
            T.StructField("n_best", T.LongType()),
            T.StructField("count_sum", T.LongType()),
        ]
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("codes")
            times = batch.column("times").flatten().to_numpy()
            place = np.searchsorted(codes, listed.flatten().to_numpy())
            linked = pa.table(
                {"row": pc.list_parent_indices(listed), "best": best[place] * times, "n": n[place] * times}
            )
            sums = linked.group_by("row", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
            columns = np.zeros((2, len(batch)), np.int64)
            columns[:, sums["row"].to_numpy()] = [sums["best_sum"].to_numpy(), sums["n_sum"].to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *map(pa.array, columns)], names=schema.names
            )

    return rows.mapInArrow(look_up, schema).select("_row.*", *added)
