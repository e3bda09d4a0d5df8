"""Hidden Markov language model.

A text is a sequence of words and one end. Hidden states emit word classes, classes emit words:
``P(word, class | state) = P(class | state) * P(word | class)``. Classes are a fixed function of
the word, so the state tables have a fixed size and are trained by Baum-Welch, whose expected counts are
computed in tasks and summed; word counts are those of the whole training corpus, however large.

Texts are read once. They are stored in blocks: a block holds some documents as arrays of local word
numbers, and its own dictionary. Counting, and looking counts up, then moves one row per block and
distinct word instead of one per token. The forward recursion is exact and scaled; long texts are cut
into segments whose transfer matrices are multiplied, so that many segments advance in one step.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrade.llm.shared import cut, free_name, quoted
from sitegrade.operators.keyed import attach

CLASSES = 256
END_CLASS = CLASSES - 1
BLOCK_TOKENS = 1 << 22
SEGMENT = 128
BATCH_TOKENS = 1 << 19
# Steps between rescalings: a step shrinks a value by no more than the least emission allowed.
RESCALE = 8
LEAST = 1e-12


@dataclass(frozen=True)
class Training:
    states: int = 4
    rounds: int = 3
    stay: float = 0.9
    smoothing: float = 0.5  # added to the count of a word within its class
    seed: int = 7


def word_class(word: bytes) -> int:
    """Class by the last two bytes, which carry most of a word's inflection."""
    return zlib.crc32(word[-2:]) % END_CLASS


# ---- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, classes)


def first_model(class_counts: np.ndarray, t: Training) -> Model:
    """Class shares with some seeded noise per state; states are left rarely."""
    k = t.states
    noise = np.random.default_rng(t.seed).uniform(0.5, 1.5, (k, CLASSES))
    emit = (class_counts + 1.0) * noise
    move = np.full((k, k), (1 - t.stay) / max(k - 1, 1))
    np.fill_diagonal(move, t.stay if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, emit / emit.sum(axis=1, keepdims=True))


def updated(counts: np.ndarray, k: int) -> Model:
    """Model of the expected counts (start, move, emit, one after the other), smoothed."""
    start, move, emit = np.split(counts, [k, k + k * k])
    start, move, emit = start + 1e-3, move.reshape(k, k) + 1e-3, emit.reshape(k, CLASSES) + 1e-2
    return Model(
        start / start.sum(),
        move / move.sum(axis=1, keepdims=True),
        emit / emit.sum(axis=1, keepdims=True),
    )


class Batch:
    """Class sequences of several texts, cut into segments that advance together."""

    def __init__(self, sequences: list[np.ndarray], model: Model) -> None:
        self.model, self.texts = model, len(sequences)
        lengths = np.array([len(s) for s in sequences])
        per_text = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(self.texts), per_text)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        size = np.minimum(lengths[owner] - place * SEGMENT, SEGMENT)
        begin = (np.cumsum(lengths) - lengths)[owner] + place * SEGMENT
        order = np.argsort(-size, kind="stable")
        self.owner, self.place, self.size = owner[order], place[order], size[order]
        symbols = np.concatenate(sequences).astype(np.int64)
        grid = begin[order][None, :] + np.arange(SEGMENT)[:, None]
        self.symbols = symbols[np.minimum(grid, len(symbols) - 1)]
        # Segments in falling size: those still running at a step are the first ones.
        self.running = np.searchsorted(-self.size, -np.arange(1, SEGMENT + 1), side="right")
        self.steps = int(self.size[0])
        self.first = self.place == 0
        # Segment number by (text, place), for the scan over a text's segments.
        self.number = np.full((self.texts, int(per_text.max())), -1)
        self.number[self.owner, self.place] = np.arange(len(self.owner))
        self.emissions = np.maximum(model.emit, LEAST).T

    def transfers(self) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, log of its scale) per segment: from the state before it to the one at its end."""
        m, k = self.model, len(self.model.start)
        x = np.tile(np.eye(k), (len(self.owner), 1, 1))
        scale = np.zeros(len(self.owner))
        for step in range(self.steps):
            n = self.running[step]
            moved = (x[:n].reshape(-1, k) @ m.move).reshape(n, k, k)
            if step == 0:
                # Whatever stands before a text leads to the start distribution.
                moved[self.first[:n]] = m.start
            x[:n] = moved * self.emissions[self.symbols[step, :n]][:, None, :]
            if step % RESCALE == RESCALE - 1 or step == self.steps - 1:
                total = x[:n].sum(axis=(1, 2))
                x[:n] /= total[:, None, None]
                scale[:n] += np.log(total)
        return x, scale

    def scan(self, x: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-likelihood per text, forward vector before and backward vector after each segment)."""
        k, segments = len(self.model.start), len(self.owner)
        before, after = np.zeros((segments, k)), np.zeros((segments, k))
        total = np.zeros(self.texts)
        vector = np.full((self.texts, k), 1 / k)
        width = self.number.shape[1]
        for j in range(width):
            texts = np.flatnonzero(self.number[:, j] >= 0)
            s = self.number[texts, j]
            before[s] = vector[texts]
            moved = np.einsum("ni,nij->nj", vector[texts], x[s])
            norm = moved.sum(axis=1)
            vector[texts] = moved / norm[:, None]
            total[texts] += np.log(norm) + scale[s]
        vector = np.full((self.texts, k), 1.0)
        for j in range(width - 1, -1, -1):
            texts = np.flatnonzero(self.number[:, j] >= 0)
            s = self.number[texts, j]
            after[s] = vector[texts]
            moved = np.einsum("nij,nj->ni", x[s], vector[texts])
            vector[texts] = moved / moved.max(axis=1)[:, None]
        return total, before, after

    def likelihoods(self) -> np.ndarray:
        return self.scan(*self.transfers())[0]

    def expected(self) -> tuple[np.ndarray, float]:
        """(expected counts, log-likelihood): the E step."""
        m, k, segments = self.model, len(self.model.start), len(self.owner)
        total, before, after = self.scan(*self.transfers())
        forward = np.zeros((self.steps + 1, segments, k))
        forward[0] = before
        for step in range(self.steps):
            n = self.running[step]
            moved = forward[step, :n] @ m.move
            if step == 0:
                moved[self.first[:n]] = m.start
            moved *= self.emissions[self.symbols[step, :n]]
            forward[step + 1, :n] = moved / moved.sum(axis=1, keepdims=True)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
        backward = after.copy()
        for step in range(self.steps - 1, -1, -1):
            n = self.running[step]
            symbols = self.symbols[step, :n]
            share = forward[step + 1, :n] * backward[:n]
            share /= share.sum(axis=1, keepdims=True)
            for state in range(k):
                emit[state] += np.bincount(symbols, share[:, state], CLASSES)
            seen = self.emissions[symbols] * backward[:n]
            inner = ~self.first[:n] if step == 0 else slice(None)
            left = forward[step, :n][inner]
            reached = seen[inner]
            norm = np.einsum("ni,ij,nj->n", left, m.move, reached)
            move += m.move * (left.T @ (reached / norm[:, None]))
            if step == 0:
                start += share[self.first[:n]].sum(axis=0)
            moved = seen @ m.move.T
            backward[:n] = moved / moved.max(axis=1, keepdims=True)
        return np.concatenate([start, move.ravel(), emit.ravel()]), float(total.sum())


def batched(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for s in sequences:
        held.append(s)
        size += len(s)
        if size >= BATCH_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


# ---- blocks -----------------------------------------------------------------------------------


def _blocks(docs: DataFrame, text: str, record: str, held_out: str, block_tokens: int) -> DataFrame:
    """Documents (``record``, ``held_out``, ``ids``, ``classes``) and dictionary rows (``word``,
    ``class``, ``id``, ``uses`` in training documents), told apart by ``word`` being null."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField(record, docs.schema[record].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("classes", T.BinaryType()),
            T.StructField("word", T.BinaryType()),
            T.StructField("class", T.IntegerType()),
            T.StructField("id", T.IntegerType()),
            T.StructField("uses", T.LongType()),
        ]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        rows: list[tuple[pa.Array, np.ndarray, list]] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().int >> 65
            classes = np.fromiter((word_class(w) for w in known), np.uint8, len(known))
            uses = np.zeros(len(known), np.int64)
            for records, held, texts in rows:
                n = len(texts)
                for out, ids in zip(held, texts):
                    if not out:
                        np.add.at(uses, ids, 1)
                arrays = [
                    pa.array([name] * n, pa.int64()),
                    records,
                    pa.array(held, pa.bool_()),
                    pa.array([ids.tobytes() for ids in texts], pa.binary()),
                    pa.array([classes[ids].tobytes() + bytes([END_CLASS]) for ids in texts], pa.binary()),
                    *(pa.nulls(n, t) for t in (pa.binary(), pa.int32(), pa.int32(), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            n = len(known)
            kind = rows[0][0].type
            arrays = [
                pa.array([name] * n, pa.int64()),
                pa.nulls(n, kind),
                *(pa.nulls(n, t) for t in (pa.bool_(), pa.binary(), pa.binary())),
                pa.array(list(known), pa.binary()),
                pa.array(classes.astype(np.int32)),
                pa.array(np.arange(n, dtype=np.int32)),
                pa.array(uses),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            known.clear()
            rows.clear()

        for batch in batches:
            at, texts = 0, []
            outs = batch.column(held_out).to_pylist()
            for i, value in enumerate(batch.column(text)):
                words = (value.as_py() or b"").lower().split()
                texts.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32))
                size += len(words) + 1
                if size >= block_tokens:
                    rows.append((batch.column(record).slice(at, len(texts)), outs[at : i + 1], texts))
                    yield from block()
                    at, texts, size = i + 1, [], 0
            if texts:
                rows.append((batch.column(record).slice(at, len(texts)), outs[at:], texts))
        if rows:
            yield from block()

    return docs.select(record, held_out, text).mapInArrow(split, schema)


def train(stored: DataFrame, class_counts: np.ndarray, t: Training) -> Model:
    """Baum-Welch over all training documents; ``stored``: column ``classes``."""
    model, k = first_model(class_counts, t), t.states
    for _ in range(t.rounds):
        sent = stored.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(k + k * k + k * CLASSES)
            texts = (np.frombuffer(v.as_buffer(), np.uint8) for b in batches for v in b.column(0))
            for held in batched(texts):
                counts += Batch(held, sent.value).expected()[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts)], names=["place", "n"]
            )

        expected = stored.select("classes").mapInArrow(expect, "place int, n double")
        counts = np.zeros(k + k * k + k * CLASSES)
        # One number per parameter of the model.
        for row in expected.groupBy("place").agg(F.sum("n").alias("n")).collect():
            counts[row.place] = row.n
        model = updated(counts, k)
    return model


def score_texts(
    docs: DataFrame,
    held_out: str,
    text: str = "text",
    training: Training = Training(),
    carry: list[str] | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Every row with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are what stands between ASCII white space, A-Z lower-cased; every text has one end token.
    ``held_out`` (SQL) marks the rows that nothing is learned from; null means false. Unseen words
    of a class share one unknown word. A null or empty text is an end token. Repeated rows count as
    often as they occur. Without training rows all counts are 0 and the states are uniform.
    ``carry`` names the columns of ``docs`` to keep (all by default), columns named like a result
    column are replaced. An empty table gives an empty result.
    """
    t = training
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    record, body, out = (free_name(docs, n) for n in ("_record", "_body", "_out"))
    row = F.struct(*[F.col(quoted(c)) for c in kept]) if kept else F.struct(F.lit(0))
    source = docs.select(
        row.alias(record),
        F.expr(f"coalesce({held_out}, false)").alias(out),
        F.col(quoted(text)).cast("binary").alias(body),
    )
    stored = cut(_blocks(source, body, record, out, block_tokens), "blocks")
    texts = stored.filter("word is null")
    learned = texts.filter("not held_out")
    dictionary = stored.filter("word is not null")

    words = cut(dictionary.groupBy("word", "class").agg(F.sum("uses").alias("uses")), "counts")
    class_uses, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    per_class = words.filter("uses > 0").groupBy("class").agg(F.sum("uses").alias("n"), F.count("*").alias("v"))
    for r in per_class.collect():
        class_uses[r["class"]], class_words[r["class"]] = r.n, r.v
    ends = learned.count()
    class_uses[END_CLASS], class_words[END_CLASS] = ends, int(ends > 0)
    n_all, n_words = int(class_uses.sum()), int(class_words.sum())
    model = train(learned, class_uses, t)

    looked_up = attach(dictionary.select("block", "id", "word"), words.drop("class"), ["word"])
    counts = looked_up.selectExpr("block as home", "id", "uses")
    log_class = np.log10(class_uses + t.smoothing * (class_words + 1))
    sent = docs.sparkSession.sparkContext.broadcast((model, log_class))
    schema = T.StructType(
        [
            texts.schema[record],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        model, per_class = sent.value
        uses = np.zeros(right.num_rows, np.int64)
        uses[right["id"].to_numpy()] = right["uses"].to_numpy()
        base_of = np.log10((uses + 1) / (n_all + n_words + 1))
        word_of = np.log10(uses + t.smoothing)
        end_base = np.log10((ends + 1) / (n_all + n_words + 1))
        tokens, known, base, inner, sequences = [], [], [], [], []
        for ids, classes in zip(left["ids"], left["classes"]):
            ids = np.frombuffer(ids.as_buffer(), np.int32)
            classes = np.frombuffer(classes.as_buffer(), np.uint8)
            sequences.append(classes)
            tokens.append(len(classes))
            known.append(int(np.count_nonzero(uses[ids])) + int(ends > 0))
            base.append(float(base_of[ids].sum() + end_base))
            inner.append(float((word_of[ids] - per_class[classes[:-1]]).sum()))
        chain = [Batch(held, model).likelihoods() for held in batched(iter(sequences))]
        total = np.array(inner) + (np.concatenate(chain) / np.log(10.0) if chain else 0.0)
        arrays = [
            left[record],
            left["held_out"],
            pa.array(tokens, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(total, pa.float64()),
        ]
        return pa.Table.from_arrays(arrays, names=schema.names)

    scored = (
        texts.selectExpr("block as holder", quoted(record), "held_out", "ids", "classes")
        .groupBy("holder")
        .cogroup(counts.groupBy("home"))
        .applyInArrow(score, schema)
    )
    return scored.selectExpr(
        *([f"{record}.*"] if kept else []),
        "held_out", "n_tokens", "n_known", f"{n_all}L as train_tokens", "base_score", "score",
    )
