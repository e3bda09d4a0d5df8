"""Personal data: patterns, and terms that give protected entities away.

Base spans come from patterns (email, ip, card, phone). Each distinct value found is a protected
entity. Corpus co-occurrence tells how much a term near it reveals: the pointwise mutual
information of term and entity in relation to the entity's own information content,
``PMI(t; e) / IC(e) = 1 + log(n(t, e) / n(t)) / log(N / n(e))``. At 1 the term occurs with the
entity only. Terms above a first threshold are generalised to their class, above a second one
removed, where they stand near that entity.

A use of a term is counted once per distinct neighbourhood (word before, word after), so copies of
a document add no evidence. Uses of terms anywhere in the corpus are counted, but only for
candidate terms: a Bloom filter of fixed size holds back the words that cannot matter, and the exact
join after it removes its false positives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, free_name, numbered, quoted
from sitegrade.operators.keyed import attach

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")


@dataclass(frozen=True)
class Disclosure:
    window: int = 12  # words on each side of an entity
    support: int = 3  # distinct uses of a term near an entity
    generalise: float = 0.93
    remove: float = 0.98
    bloom_bits: int = 23  # 2 ** bits


# ---- patterns ---------------------------------------------------------------------------------

# The possessive forms match what the plain ones match, in linear time: no character that may
# follow a run belongs to it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from every ``@`` to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and start; code points."""
    spans = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        # No part is read as a number before its zeros are gone: runs of them may be of any length.
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


# ---- terms ------------------------------------------------------------------------------------

_TERM = re.compile(r"[^\W\d_]{3,}")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def contexts(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple]:
    """(entity, context, use, term, start, end) of the terms near every base span."""
    if not spans:
        return []
    covered = sorted((s, e) for _, s, e in spans)
    words, at = [], 0
    for m in _TERM.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or covered[at][0] >= m.end():
            words.append((m.start(), m.end(), m[0].lower()))
    starts = np.array([w[0] for w in words], np.int64)
    out = []
    for kind, start, end in spans:
        entity = _hash(kind, text[start:end].lower())
        middle = int(np.searchsorted(starts, start))
        low, high = max(0, middle - window), min(len(words), middle + window)
        context = _hash(*(w[2] for w in words[low:high]))
        for i in range(low, high):
            use = _hash(words[i - 1][2] if i else "", words[i + 1][2] if i + 1 < len(words) else "")
            out.append((entity, context, use, words[i][2], words[i][0], words[i][1]))
    return out


_USE = T.StructType(
    [
        T.StructField("entity", T.LongType()),
        T.StructField("context", T.LongType()),
        T.StructField("use", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
_ARROW_USE = pa.struct(
    [
        ("entity", pa.int64()),
        ("context", pa.int64()),
        ("use", pa.int64()),
        ("term", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
    ]
)
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _find(rows: DataFrame, text: str, keep: list[str], window: int) -> DataFrame:
    """``keep`` columns with ``spans``, ``uses`` and ``n_terms`` of every whole text."""
    schema = T.StructType(
        [
            *(rows.schema[c] for c in keep),
            T.StructField("spans", T.ArrayType(_SPAN)),
            T.StructField("uses", T.ArrayType(_USE)),
            T.StructField("n_terms", T.LongType()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _USE]
        for batch in batches:
            spans, uses, sizes = [], [], []
            for value in batch.column(text):
                body = value.as_py() or ""
                found = base_spans(body)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                uses.append([dict(zip(names, u)) for u in contexts(body, found, window)])
                sizes.append(body.count(" ") + 1)
            arrays = [
                pa.array(spans, pa.list_(_ARROW_SPAN)),
                pa.array(uses, pa.list_(_ARROW_USE)),
                pa.array(sizes, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *arrays], names=[*keep, "spans", "uses", "n_terms"]
            )

    return rows.mapInArrow(find, schema)


def _bloom(terms: DataFrame, bits: int) -> np.ndarray:
    """Bit field of the terms' hashes: built in tasks, at most ``2 ** bits / 64`` words collected."""
    placed = terms.selectExpr(f"pmod(xxhash64(term), {1 << bits}) as place")
    words = placed.selectExpr("place div 64 as word", "shiftleft(1L, cast(place % 64 as int)) as bit")
    field = np.zeros((1 << bits) // 64, np.uint64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        field[row.word] = np.uint64(row.bits & ((1 << 64) - 1))
    return field


def _term_uses(docs: DataFrame, text: str, field: np.ndarray, bits: int) -> DataFrame:
    """(term, use) of every word of the corpus that passes the filter; repeats within a task go."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    digest = xxhash.xxh64_intdigest

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, known, mask = sent.value, {}, (1 << bits) - 1

        def passes(word: str) -> bool:
            answer = known.get(word)
            if answer is None:
                if len(known) > 500_000:
                    known.clear()
                place = digest(word, 42) & mask
                answer = known[word] = bool(int(words_of[place // 64]) >> (place % 64) & 1)
            return answer

        for batch in batches:
            found = set()
            for value in batch.column(0):
                words = [w.lower() for w in _TERM.findall(value.as_py() or "")]
                last = len(words) - 1
                for i, word in enumerate(words):
                    if passes(word):
                        before = words[i - 1] if i else ""
                        found.add((word, _hash(before, words[i + 1] if i < last else "")))
            terms, uses = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(uses, pa.int64())], names=["term", "use"]
            )

    return docs.select(F.col(quoted(text)).cast("string")).mapInArrow(find, "term string, use bigint")


def disclosing_terms(uses: DataFrame, docs: DataFrame, text: str, total: int, settings: Disclosure) -> DataFrame:
    """(entity, term, ratio) of the pairs that reach the first threshold.

    The uses of a term near entities alone bound its uses in the corpus from below, and so the
    ratio from above. Common words fail that bound, and the corpus is searched for the rest only.
    """

    def ratio(n_t: str) -> str:
        return f"1 + ln(n_te / greatest({n_t}, n_te)) / ln(greatest({total} / n_e, 2.0))"

    def counted(columns: list[str], distinct: str, name: str) -> DataFrame:
        pairs = uses.select(*columns, distinct).distinct()
        return pairs.groupBy(*columns).agg(F.count("*").alias(name))

    near = counted(["entity", "term"], "use", "n_te").filter(f"n_te >= {settings.support}")
    near = attach(near, counted(["entity"], "context", "n_e"), ["entity"])
    near = attach(near, counted(["term"], "use", "n_near"), ["term"])
    near = cut(near.filter(f"{ratio('n_near')} >= {settings.generalise}"), "pairs")
    field = _bloom(near.select("term").distinct(), settings.bloom_bits)
    if not field.any():
        return near.selectExpr("entity", "term", "cast(null as double) as ratio").filter("false")
    everywhere = _term_uses(docs, text, field, settings.bloom_bits).distinct()
    counts = everywhere.groupBy("term").agg(F.count("*").alias("n_t"))
    joined = attach(near, counts, ["term"])
    return joined.selectExpr("entity", "term", f"{ratio('coalesce(n_t, n_te)')} as ratio").filter(
        f"ratio >= {settings.generalise}"
    )


def find_personal_data(
    docs: DataFrame,
    text: str = "text",
    settings: Disclosure = Disclosure(),
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row with ``base_spans`` and ``term_spans``, arrays of (kind, start, end).

    Positions are code points of the original text, the end exclusive. A null or empty text has no
    spans; repeated rows each have theirs. ``carry`` names the columns of ``docs`` to keep (all by
    default); a column with the name of a result column is replaced. An empty table gives an empty
    result.
    """
    added = ["base_spans", "term_spans"]
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    record, body = free_name(docs, "_record"), free_name(docs, "_body")
    row = F.struct(*[F.col(quoted(c)) for c in kept]) if kept else F.struct(F.lit(0))
    source = docs.select(row.alias(record), F.col(quoted(text)).cast("string").alias(body))
    found = cut(numbered(_find(source, body, [record], settings.window), "_no"), "spans")
    total = found.agg(F.sum("n_terms")).first()[0] or 1
    uses = found.select("_no", F.inline("uses"))
    telling = disclosing_terms(uses, docs, text, total, settings)
    action = f"if(ratio >= {settings.remove}, '{TERM_KINDS[1]}', '{TERM_KINDS[0]}')"
    hits = (
        attach(uses, telling, ["entity", "term"])
        .filter("ratio is not null")
        .groupBy("_no", "start", "end")
        .agg(F.max("ratio").alias("ratio"))
        .groupBy("_no")
        .agg(F.expr(f"array_sort(collect_list(struct({action} as kind, start, end)))").alias("term_spans"))
    )
    spans = f"array<{_SPAN.simpleString()}>"
    return found.drop("uses", "n_terms").join(hits, "_no", "left").selectExpr(
        *([f"{record}.*"] if kept else []),
        "spans as base_spans",
        f"coalesce(term_spans, cast(array() as {spans})) as term_spans",
    )


def redact(text: str, base: list[tuple[str, int, int]], terms: list[tuple[str, int, int]]) -> str:
    """The text with base spans as ``[KIND]``, generalised terms by class, removed terms gone."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in [*base, *terms]):
        if start < at:  # overlapping kinds: the first covers the second
            at = max(at, end)
            continue
        out.append(text[at:start])
        if kind in KINDS:
            out.append(f"[{kind.upper()}]")
        elif kind == TERM_KINDS[0]:
            out.append("[NAME]" if text[start].isupper() else "[WORD]")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", settings: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with the text column sanitised and the spans added. A null text stays null."""
    found = find_personal_data(docs, text, settings)
    names = found.columns
    place = next(i for i, c in enumerate(names) if c == text)
    # The text becomes a string if it wasn't one.
    found = found.withColumn(text, F.col(quoted(text)).cast("string"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = zip(batch.column("base_spans").to_pylist(), batch.column("term_spans").to_pylist())
            texts = [
                None if body is None else redact(body, *([(s["kind"], s["start"], s["end"]) for s in x] for x in both))
                for body, both in zip(batch.column(place).to_pylist(), spans)
            ]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(clean, found.schema)


def digest_columns() -> list[str]:
    """SQL of the counts, the digest of the base spans and all spans as text."""
    ranks = ", ".join(f"'{k}'" for k in (*KINDS, *TERM_KINDS))

    def listed(spans: str) -> str:
        # Rank by kind as listed, then by start.
        ranked = f"transform({spans}, s -> struct(array_position(array({ranks}), s.kind) as k, s.start as start, s.end as end, s.kind as kind))"
        return f"array_join(transform(array_sort({ranked}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    counts = [f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS]
    return [
        *counts,
        f"sha2({listed('base_spans')}, 256) as base_sha256",
        f"{listed('concat(base_spans, term_spans)')} as spans",
    ]
