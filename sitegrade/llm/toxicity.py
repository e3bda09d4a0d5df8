"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear SVM.

A string's features are its subsequences of four letters within a span of six; an occurrence with g
letters skipped counts ``decay ** g``. The kernel of two strings is the normalised product of their
features, so an insult with letters inserted or spelt with gaps stays close to itself. Landmarks
are strings that labelled toxic texts have more often than clean ones. A sentence is described by its
closest string to every landmark, mapped by the Nystroem matrix (inverse root of the landmarks' own
kernel); a linear SVM with calibrated output scores it. A text scores as its worst sentence.

Strings are words without their punctuation and digits; single letters in a row are one string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, free_name, quoted

ORDER, SPAN = 4, 6
GAPS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]
CHUNK_CHARS = 1 << 20


@dataclass(frozen=True)
class Settings:
    decay: float = 0.6
    landmarks: int = 64
    # Toxic sample texts that a landmark occurs in, at least.
    support: int = 3
    # Least evidence for a landmark: toxic texts with it times the logarithm of its odds. Among
    # thousands of rare words some stand in toxic texts only by chance; 20 rules those out.
    evidence: float = 20.0
    # Labelled texts learned from, per label: those with the smallest hash of their id.
    sample: int = 8000
    # Kernel values below count as none.
    least: float = 0.3
    ridge: float = 1e-3
    threshold: float = 0.3


# ---- strings ----------------------------------------------------------------------------------

_SENTENCE = re.compile(r"(?<=[.!?\n])(?=\s|\Z)")


@cache
def _letter_class() -> np.ndarray:
    """Class 1 to 31 of letters, 0 of others, -1 of white space, -2 of sentence ends; code points
    above 2 ** 16 are one letter class."""
    table = np.zeros((1 << 16) + 1, np.int8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            table[code] = code - 96 if "a" <= c <= "z" else 27 + code % 5
        elif c.isspace():
            table[code] = -1
    table[1 << 16] = 27
    for c in ".!?":
        table[ord(c)] = -2
    return table


def strings_of(text: str) -> list[str]:
    """The strings of a text, as class letters; sentence by sentence."""
    found = []
    for sentence in _SENTENCE.split(text.lower()):
        single = False
        for word in sentence.split():
            letters = "".join(c for c in word if c.isalpha())
            if not letters:
                continue
            if len(letters) == 1 and single:
                found[-1] += letters
            else:
                found.append(letters)
            single = len(letters) == 1
    return found


def encode(string: str) -> np.ndarray:
    codes = np.frombuffer(string.encode("utf-32-le", "surrogatepass"), "<u4")
    return _letter_class()[np.minimum(codes, 1 << 16)].astype(np.int64)


def features(string: str, decay: float) -> dict[int, float]:
    """Feature number -> weight of one string."""
    letters, out = encode(string), {}
    for gaps in GAPS:
        weight = decay ** (gaps[-1] + 1 - ORDER)
        for i in range(len(letters) - gaps[-1]):
            number = 0
            for g in gaps:
                number = number << 5 | int(letters[i + g])
            out[number] = out.get(number, 0.0) + weight
    return out


def kernel(a: dict[int, float], b: dict[int, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    product = sum(w * b.get(number, 0.0) for number, w in a.items())
    size = (sum(w * w for w in a.values()) * sum(w * w for w in b.values())) ** 0.5
    return product / size if size else 0.0


# ---- sentences against landmarks --------------------------------------------------------------


class Landmarks:
    """Kernel values of many texts' sentences against fixed strings."""

    def __init__(self, strings: list[str], s: Settings) -> None:
        self.strings, self.s, self.m = strings, s, len(strings)
        vectors = [features(x, s.decay) for x in strings]
        entries: dict[int, list[tuple[int, float]]] = {}
        for i, vector in enumerate(vectors):
            size = sum(w * w for w in vector.values()) ** 0.5
            for number, w in vector.items():
                entries.setdefault(number, []).append((i, w / size))
        # Features by number, with their landmarks one after the other.
        self.row = np.zeros(1 << (5 * ORDER), np.int32)
        self.largest = np.zeros(len(entries) + 1)
        begin, owner, weight = [0, 0], [], []
        for place, number in enumerate(sorted(entries), 1):
            self.row[number] = place
            self.largest[place] = max(w for _, w in entries[number])
            owner += [i for i, _ in entries[number]]
            weight += [w for _, w in entries[number]]
            begin.append(len(owner))
        self.begin = np.array(begin, np.int64)
        self.owner, self.weight = np.array(owner, np.int64), np.array(weight)

    def sizes(self, lengths: np.ndarray) -> np.ndarray:
        """Norm of strings without a repeated subsequence; repeats only make it larger."""
        total = np.zeros(len(lengths))
        for gaps in GAPS:
            weight = self.s.decay ** (2 * (gaps[-1] + 1 - ORDER))
            total += np.maximum(lengths - gaps[-1], 0) * weight
        return np.sqrt(np.maximum(total, 1e-9))

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, kernel values) of the sentences with some value of at least ``least``."""
        none = np.zeros(0, np.int64), np.zeros((0, self.m))
        joined = "\n\x00\n".join(["", *(t.lower().replace("\x00", " ") for t in texts), ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _letter_class()[np.minimum(codes, 1 << 16)]
        space, letter = kinds == -1, kinds > 0
        mark = codes == 0
        ends = codes == 10
        ends[:-1] |= (kinds[:-1] == -2) & space[1:]
        token = np.cumsum(space)
        at = np.flatnonzero(letter)
        if not len(at) or not self.m:
            return none
        # Strings: tokens with letters, single letters of a sentence in a row joined.
        own = token[at]
        fresh = np.r_[True, own[1:] != own[:-1]]
        first = at[fresh]
        count = np.diff(np.r_[np.flatnonzero(fresh), len(at)])
        sentence_of = np.cumsum(ends)[first]
        single = count == 1
        glued = np.r_[False, single[1:] & single[:-1] & (sentence_of[1:] == sentence_of[:-1])]
        string_of = np.cumsum(~glued) - 1
        letters = kinds[at].astype(np.int32)
        unit = np.repeat(string_of, count)
        lengths = np.bincount(unit)
        heads = ~glued
        text_of = (np.cumsum(mark)[first] - 1)[heads]
        sentence_of = sentence_of[heads]

        places, units, weights = [], [], []
        for gaps in GAPS:
            n = len(letters) - gaps[-1]
            if n <= 0:
                continue
            number = letters[:n]
            for g in gaps[1:]:
                number = number << 5 | letters[g : g + n]
            row = self.row[number]
            hit = np.flatnonzero(row)
            hit = hit[unit[hit] == unit[hit + gaps[-1]]]
            places.append(row[hit])
            units.append(unit[hit])
            weights.append(np.full(len(hit), self.s.decay ** (gaps[-1] + 1 - ORDER)))
        if not places:
            return none
        place, owner, weight = np.concatenate(places), np.concatenate(units), np.concatenate(weights)
        size = self.sizes(lengths)
        # No landmark can come closer than the sum of the largest weights.
        bound = np.bincount(owner, weight * self.largest[place], len(lengths)) / size
        near = bound[owner] >= self.s.least
        place, owner, weight = place[near], owner[near], weight[near]
        if not len(place):
            return none
        chosen, compact = np.unique(owner, return_inverse=True)
        fan = self.begin[place + 1] - self.begin[place]
        inner = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        entry = np.repeat(self.begin[place], fan) + inner
        cell = np.repeat(compact, fan) * self.m + self.owner[entry]
        values = np.bincount(cell, np.repeat(weight, fan) * self.weight[entry], len(chosen) * self.m)
        values = np.minimum(values.reshape(-1, self.m) / size[chosen][:, None], 1.0)
        values[values < self.s.least] = 0.0
        some = values.any(axis=1)
        chosen, values = chosen[some], values[some]
        if not len(chosen):
            return none
        names, group = np.unique(sentence_of[chosen], return_inverse=True)
        best = np.zeros((len(names), self.m))
        np.maximum.at(best, group, values)
        texts_of = np.zeros(len(names), np.int64)
        texts_of[group] = text_of[chosen]
        return texts_of, best


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


# ---- the classifier ---------------------------------------------------------------------------


@dataclass
class Model:
    strings: list[str]
    weights: np.ndarray  # of the kernel values
    bias: float
    slope: float
    offset: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        margin = values @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def nystroem(strings: list[str], s: Settings) -> np.ndarray:
    vectors = [features(x, s.decay) for x in strings]
    gram = np.array([[kernel(a, b) for b in vectors] for a in vectors])
    value, vector = np.linalg.eigh(gram)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 0) + s.ridge)) @ vector.T


def train_svm(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps on the current support vectors; ``y`` is 1 or -1."""
    design = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    penalty = np.eye(design.shape[1]) * ridge
    penalty[-1, -1] = 1e-8
    w, active = np.zeros(design.shape[1]), np.ones(len(y), bool)
    for _ in range(30):
        part, weight = design[active], share[active]
        w = np.linalg.solve(penalty + (part * weight[:, None]).T @ part, (part * weight[:, None]).T @ y[active])
        now = y * (design @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, targets drawn in a little."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, design.T @ (p - target) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def labelled_sample(labels: DataFrame, learn: str, label: str, s: Settings) -> tuple[DataFrame, dict]:
    """(id, toxic) of at most ``sample`` rows per label, and how many there are of each."""
    known = (
        labels.filter(f"coalesce({learn}, false) and {quoted(label)} in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max(quoted(label)).alias("toxic"))
    )
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.filter(f"toxic = {y}").orderBy(*order).limit(s.sample) for y in (0, 1)]
    return cut(parts[0].unionAll(parts[1]), "sample"), totals


def train(docs: DataFrame, labels: DataFrame, learn: str, text: str, label: str, s: Settings) -> Model:
    sample, totals = labelled_sample(labels, learn, label, s)
    # The broadcast side has at most 2 * sample rows of 12 bytes.
    rows = docs.selectExpr("doc_id", f"cast({quoted(text)} as string) as body").join(
        F.broadcast(sample), "doc_id"
    )
    rows = cut(rows, "labelled").select("doc_id", "toxic", "body")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, toxic = [], []
            for value, y in zip(batch.column(2), batch.column(1).to_pylist()):
                own = {w for w in strings_of(value.as_py() or "") if ORDER <= len(w) <= 24}
                found += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(toxic, pa.int64())], names=["word", "toxic"]
            )

    counted = rows.mapInArrow(words, "word string, toxic bigint").groupBy("word").agg(
        F.sum("toxic").alias("pos"), F.expr("count_if(toxic = 0)").alias("neg")
    )
    sizes = {y: max(min(totals.get(y, 0), s.sample), 1) for y in (0, 1)}
    odds = f"(pos / {sizes[1]}) / ((neg + 0.5) / {sizes[0]})"
    best = (
        counted.filter(f"pos >= {s.support} and pos * ln({odds}) >= {s.evidence}")
        .orderBy(F.expr(f"pos * ln({odds})").desc(), "word")
        .limit(s.landmarks)
    )
    strings = [r.word for r in best.collect()]
    base = (totals.get(1, 0) + 0.5) / (totals.get(0, 0) + totals.get(1, 0) + 1)
    if not strings or not totals.get(0):
        return Model(strings, np.zeros(len(strings)), 0.0, 1.0, float(np.log(base / (1 - base))))

    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's sentence with the largest kernel values; nothing for one without any."""
        landmarks = Landmarks(strings, s)
        for batch in batches:
            ids, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, out = 0, ([], [], [])
            for texts in _chunks(v.as_py() for v in batch.column(2)):
                owner, values = landmarks.sentences(texts)
                best: dict[int, np.ndarray] = {}
                for text_number, row in zip(owner.tolist(), values):
                    if text_number not in best or row.sum() > best[text_number].sum():
                        best[text_number] = row
                for i in range(len(texts)):
                    out[0].append(ids[at + i])
                    out[1].append(toxic[at + i])
                    out[2].append(best[i].tolist() if i in best else [0.0] * len(strings))
                at += len(texts)
            types = [pa.string(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, t) for o, t in zip(out, types)], names=["doc_id", "toxic", "x"]
            )

    # Ids of any type, as text.
    named = rows.selectExpr("cast(doc_id as string) as doc_id", "cast(toxic as bigint) as toxic", "body")
    seen = named.mapInArrow(witnesses, "doc_id string, toxic bigint, x array<double>")
    # One row per sampled id, so at most 2 * sample.
    fitted = seen.groupBy("doc_id").agg(F.min(F.struct("toxic", "x")).alias("r")).select("r.*").collect()
    x, y = np.array([r.x for r in fitted]), np.array([1.0 if r.toxic else -1.0 for r in fitted])
    if not (y > 0).any() or not (y < 0).any():
        return Model(strings, np.zeros(len(strings)), 0.0, 1.0, float(np.log(base / (1 - base))))
    root = nystroem(strings, s)
    w, bias = train_svm(x @ root, y, s.ridge)
    slope, offset = calibrate((x @ root) @ w + bias, y)
    # The sample holds other shares of the labels than the table.
    shift = np.log(base / (1 - base)) - np.log(((y > 0).sum() + 0.5) / ((y < 0).sum() + 0.5))
    return Model(strings, root @ w, bias, slope, offset + float(shift))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: str,
    text: str = "text",
    label: str = "toxic",
    settings: Settings = Settings(),
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    ``held_out`` is SQL over ``doc_id``; labels of such rows are not learned from (a null counts
    as false). An id labelled more than once is toxic if any label says so; other labels than 0 and
    1 are ignored. A null or empty text scores as a sentence without any known string. Without toxic or without clean
    labels the score is the smoothed share of toxic labels. ``carry`` names the columns of ``docs``
    to keep (all by default), columns named like a result column are replaced. An empty table gives
    an empty result.
    """
    s = settings
    added = ["held_out", "score", "predicted"]
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    record, body, out = (free_name(docs, n) for n in ("_record", "_body", "_out"))
    model = train(docs, labels, f"not coalesce({held_out}, false)", text, label, s)
    row = F.struct(*[F.col(quoted(c)) for c in kept]) if kept else F.struct(F.lit(0))
    source = docs.select(
        row.alias(record),
        F.expr(f"coalesce({held_out}, false)").alias(out),
        F.col(quoted(text)).cast("string").alias(body),
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [source.schema[record], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        landmarks = Landmarks(model.strings, s)
        nothing = float(model.scores(np.zeros((1, len(model.strings))))[0])
        for batch in batches:
            scores = []
            for texts in _chunks(v.as_py() for v in batch.column(body)):
                owner, values = landmarks.sentences(texts)
                worst = np.full(len(texts), nothing)
                np.maximum.at(worst, owner, model.scores(values))
                scores += worst.tolist()
            arrays = [batch.column(record), batch.column(out), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(score, schema).selectExpr(
        *([f"{record}.*"] if kept else []),
        "held_out",
        "score",
        f"if(score >= {s.threshold}, 1, 0) as predicted",
    )
