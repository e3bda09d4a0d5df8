"""Language identification by Bayesian fusion of evidence.

The posterior of a language combines the likelihood of the text (letter trigrams, hashed into a
fixed number of cells), how often the declared language says so when the text is in that
language, the address suffix, and a prior of the host, smoothed towards its domain's and the whole
corpus's. All counts come from grouped aggregation over all documents: trigrams per declared language
first, then declared languages, suffixes and hosts per language that the text alone suggests. An
``und`` (undetermined) class with even trigrams stands for everything else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, free_name, quoted
from sitegrade.operators.keyed import attach

UNDETERMINED = "und"


@dataclass(frozen=True)
class Evidence:
    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    cell_bits: int = 14
    smoothing: float = 0.5
    # The trigrams of a text depend on each other: n of them count as n / (1 + n / saturation).
    saturation: float = 100.0
    # Pages that a parent's share counts for in its child's prior.
    host_weight: float = 10.0
    undetermined: float = 0.001
    least_posterior: float = 0.5

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, UNDETERMINED)


# ---- text -------------------------------------------------------------------------------------

CHUNK_CHARS = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Letter or not, for code points below 2 ** 16; all above count as letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)] + [True])


def trigram_cells(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of every trigram, number of trigrams per text).

    Letters are lower-cased and all else is one space; a text has a space at both ends. Trigrams
    without a letter do not count.
    """
    marked = " ".join(["", *(t.lower().replace("\x00", " ") + "\x00" for t in texts), ""])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = codes == 0
    letter = _letters()[np.minimum(codes, 1 << 16)] & ~ends
    plain = np.where(letter, codes, 0).astype(np.uint64)
    # One space per run; the mark between texts is kept, with a space on each side.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept |= ends
    kept[0] = True
    plain, marks = plain[kept], np.cumsum(ends)[kept]
    h = (plain[:-2] * np.uint64(0x9E3779B1) + plain[1:-1]) * np.uint64(0x85EBCA77) + plain[2:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    owner = marks[1:-1]
    # A middle that is a letter has its neighbours in the same text.
    valid = plain[1:-1] != 0
    cells, owner = h[valid].astype(np.int64), owner[valid]
    return cells, np.bincount(owner, minlength=len(texts))[: len(texts)]


def _chunks(values: Iterator[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for value in values:
        held.append(value or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, text: str, declared: str, e: Evidence) -> np.ndarray:
    """Log-probability of every cell per language, learned from the declared languages of all rows."""
    n = len(e.languages)
    number = {name: i for i, name in enumerate(e.languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n, 1 << e.cell_bits), np.int64)
        for batch in batches:
            names = iter(batch.column(1).to_pylist())
            for texts in _chunks(v.as_py() for v in batch.column(0)):
                cells, sizes = trigram_cells(texts, e.cell_bits)
                which = np.repeat([number.get(next(names), -1) for _ in texts], sizes)
                for i in range(n):
                    counts[i] += np.bincount(cells[which == i], minlength=1 << e.cell_bits)
        language, cell = np.nonzero(counts)
        arrays = [pa.array(language.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[language, cell])]
        yield pa.RecordBatch.from_arrays(arrays, names=["language", "cell", "n"])

    rows = docs.select(F.col(text).cast("string"), F.col(declared)).mapInArrow(
        count, "language int, cell int, n bigint"
    )
    counts = np.full((n, 1 << e.cell_bits), e.smoothing)
    # At most languages * cells rows, whatever the corpus.
    for row in rows.groupBy("language", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.language, row.cell] += row.n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_scores(texts: list[str], model: np.ndarray, e: Evidence) -> np.ndarray:
    """Log-likelihood per text and class, saturated; NaN in all classes for a text without letters."""
    cells, sizes = trigram_cells(texts, e.cell_bits)
    owner = np.repeat(np.arange(len(texts)), sizes)
    sums = np.stack([np.bincount(owner, row[cells], len(texts)) for row in model], axis=1)
    even = -sizes * e.cell_bits * np.log(2.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        weight = 1.0 / (1.0 + sizes / e.saturation)
        scores = np.concatenate([sums, even[:, None]], axis=1) * weight[:, None]
    scores[sizes == 0] = np.nan
    return scores


def _with_text_scores(rows: DataFrame, text: str, keep: list[str], model: np.ndarray, e: Evidence) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("likely", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = []
            for texts in _chunks(v.as_py() for v in batch.column(text)):
                for row in text_scores(texts, sent.value, e):
                    likely.append(None if np.isnan(row[0]) else row.tolist())
            arrays = [*(batch.column(c) for c in keep), pa.array(likely, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "likely"])

    return rows.mapInArrow(score, schema)


# ---- other evidence ---------------------------------------------------------------------------


def language_code(value: str) -> str:
    """SQL: primary subtag of a declared language, in lower case."""
    return f"nullif(regexp_extract(lower({value}), '^\\\\s*([a-z]+)', 1), '')"


def declared_in_markup(html: str) -> str:
    """SQL: language that a page's html element declares."""
    return language_code(f"regexp_extract({html}, '(?is)<html[^>]*\\\\slang\\\\s*=\\\\s*[\"\\']?([a-zA-Z-]+)', 1)")


def host_of(url: str) -> str:
    """SQL: host of an address; a name without scheme is taken as it is."""
    return f"lower(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)', 1))"


def _counts(rows: DataFrame, key: str, e: Evidence) -> DataFrame:
    """Documents per key and class, as an array in class order."""
    per_class = [f"count_if(guess = {i})" for i in range(len(e.classes))]
    return rows.filter(f"{key} is not null").groupBy(key).agg(
        F.expr(f"array({', '.join(per_class)})").alias(f"{key}_n")
    )


def _numbers(values: np.ndarray) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def identify(
    docs: DataFrame,
    text: str = "text",
    declared: str | None = None,
    host: str | None = None,
    suffixes: bool = True,
    evidence: Evidence = Evidence(),
    carry: list[str] | None = None,
    score_again: bool = False,
) -> DataFrame:
    """Every row with ``language``, ``posterior`` and ``accepted``.

    ``declared`` and ``host`` are SQL expressions for the declared language and the host name (see
    ``declared_in_markup``, ``host_of``); null values are no evidence. Rows with a declared language
    are what the text model learns from. A text without letters is ``und``, posterior 1, whatever
    else it declares; ties go to the first language in order. ``accepted``: one of the languages,
    with at least ``least_posterior``. Repeated rows count as often as they occur. ``carry`` names
    the columns of ``docs`` to keep (all by default), columns named like a result column are
    replaced. An empty table gives an empty result. ``score_again``: store only what the priors are
    counted from and score the texts a second time for the result; for rows that carry long columns.
    """
    e, n = evidence, len(evidence.classes)
    added = ["language", "posterior", "accepted"]
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    record, body = free_name(docs, "_record"), free_name(docs, "_body")
    row = F.struct(*[F.col(quoted(c)) for c in kept]) if kept else F.struct(F.lit(0))
    source = docs.select(
        row.alias(record),
        F.col(quoted(text)).cast("string").alias(body),
        F.expr(language_code(declared) if declared else "cast(null as string)").alias("declared"),
        F.expr(f"nullif({host}, '')" if host else "cast(null as string)").alias("host"),
    )
    model = train(source, body, "declared", e)
    keep = [record, "declared", "host"]
    scored = _with_text_scores(source, body, keep, model, e)
    guess = "cast(array_position(likely, array_max(likely)) - 1 as int)"
    known = ", ".join(f"'{name}'" for name in e.languages)
    scored = scored.selectExpr(
        "*",
        f"{guess} as guess",
        f"if(declared is null, null, cast(array_position(array({known}), declared) as int)) as said",
    )
    if score_again:
        counted = cut(scored.select("host", "guess", "said"), "guesses")
    else:
        scored = counted = cut(scored, "likelihoods")

    # Shares of the whole corpus, and what is declared per class: a table of fixed size.
    said = np.ones((n, n))
    for r in counted.filter("guess is not null").groupBy("guess", "said").agg(F.count("*").alias("n")).collect():
        said[r.guess, r.said if r.said is not None else 0] += r.n if r.said is not None else 0
    totals = np.ones(n)
    for r in counted.filter("guess is not null").groupBy("guess").agg(F.count("*").alias("n")).collect():
        totals[r.guess] += r.n
    totals[-1] = max(totals[-1], 1.0)
    prior = totals / totals.sum()
    prior[-1] = e.undetermined
    prior /= prior.sum()
    # An undetermined text may declare anything.
    said[-1] = said[:-1].sum(axis=0) + 1
    reliability = np.log(said / said.sum(axis=1, keepdims=True))
    by_said = ", ".join(_numbers(reliability[:, i]) for i in range(n))
    declared_part = f"if(said is null, array_repeat(0D, {n}), element_at(array({by_said}), said + 1))"

    if host:
        labels = "split(host, '[.]')"
        named = counted.filter("guess is not null and host is not null").select("host", "guess")
        hosts = cut(_counts(named, "host", e), "hosts").selectExpr(
            "*",
            f"array_join(slice({labels}, greatest(size({labels}) - 1, 1), 2), '.') as domain",
            f"if(size({labels}) > 1, element_at({labels}, -1), null) as suffix",
        )

        def summed(key: str) -> DataFrame:
            parts = [f"sum(host_n[{i}])" for i in range(n)]
            return hosts.filter(f"{key} is not null").groupBy(key).agg(
                F.expr(f"array({', '.join(parts)})").alias(f"{key}_n")
            )

        def smoothed(counts: str, parent: str) -> str:
            size = f"aggregate({counts}, 0L, (a, b) -> a + b)"
            return (
                f"transform({parent}, (p, i) -> cast((coalesce({counts}[i], 0) + {e.host_weight} * p)"
                f" / (coalesce({size}, 0) + {e.host_weight}) as double))"
            )

        tree = attach(attach(hosts, summed("domain"), ["domain"]), summed("suffix"), ["suffix"])
        tree = tree.withColumn("top", F.expr(_numbers(prior)))
        tree = tree.withColumn("middle", F.expr(smoothed("domain_n", "top")))
        # Suffix given language, smoothed by one page.
        ending = (
            f"transform({_numbers(totals)}, (t, i) -> ln((coalesce(suffix_n[i], 0) + 1) / (t + 1)))"
            if suffixes
            else f"array_repeat(0D, {n})"
        )
        tree = tree.selectExpr(
            "host",
            f"transform({smoothed('host_n', 'middle')}, p -> ln(greatest(p, 1e-6D))) as host_part",
            f"if(suffix is null, array_repeat(0D, {n}), {ending}) as suffix_part",
        )
        scored = attach(scored, tree, ["host"])
    else:
        scored = scored.selectExpr("*", "cast(null as array<double>) as host_part", "cast(null as array<double>) as suffix_part")

    log_prior = _numbers(np.log(prior))
    total = (
        f"transform(likely, (x, i) -> x + {declared_part}[i]"
        f" + coalesce(host_part, {log_prior})[i] + coalesce(suffix_part[i], 0D))"
    )
    names = ", ".join(f"'{name}'" for name in e.classes)
    best = scored.selectExpr(record, f"{total} as total").selectExpr(
        record,
        "cast(array_position(total, array_max(total)) as int) as at",
        "1 / aggregate(total, 0D, (s, x) -> s + exp(x - array_max(total))) as sure",
    )
    out = best.selectExpr(
        *([f"{record}.*"] if kept else []),
        f"coalesce(element_at(array({names}), at), '{UNDETERMINED}') as language",
        "coalesce(sure, 1D) as posterior",
    )
    return out.selectExpr(
        "*", f"language <> '{UNDETERMINED}' and posterior >= {e.least_posterior} as accepted"
    )


def identify_documents(
    docs: DataFrame, carry: list[str] | None = None, score_again: bool = False
) -> DataFrame:
    """Table ``documents``: its language column is what is declared, its source the host."""
    return identify(
        docs, "text", "lang", host_of("source"), carry=carry, score_again=score_again
    )


def identify_pages(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Table ``pages``: language in the markup, host of the url, text without tags."""
    plain = pages.withColumn(
        name := free_name(pages, "_plain"),
        F.expr("regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</\\\\1>', ' '), '<[^>]*>|&[a-z]+;', ' ')"),
    )
    kept = pages.columns if carry is None else carry
    return identify(plain, name, declared_in_markup("html"), host_of("url"), carry=kept)


def keep_accepted(docs: DataFrame) -> DataFrame:
    """Documents whose language is determined, with the columns of ``docs``. Texts are not stored."""
    name = free_name(docs, "_document")
    whole = docs.withColumn(name, F.struct(*[F.col(quoted(c)) for c in docs.columns]))
    marked = identify_documents(whole, carry=[name], score_again=True)
    return marked.filter("accepted").select(f"{name}.*")
