"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Every word bucket has a fixed sparse random vector; a bucket's context vector is the sum of those of its
neighbours in the training sample.  A document is the weighted mean of its words' vectors.  A two-layer network
in numpy scores it, and a temperature fitted on held-back sample rows calibrates the probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import modest_batches, stored
from granary.llm.hashing import slices, words_of

#: Bound of the training sample, and the tasks that go through it.
SAMPLE_ROWS, SAMPLE_TASKS = 6000, 4
WORDS, SHAPES, DIM, ONES, REACH = 1 << 15, 1 << 10, 48, 6, 2
BUCKETS = WORDS + SHAPES
WIDE = 2 * DIM + 2
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4
#: Words whose vectors are gathered at once.
GATHERED = 1 << 15
SEED = 20240607


#: Signs that don't count at a word's edges; and of its shape, letters and digits by their kind, runs of one kind as two.
EDGES = b"""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"""
CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)


class Codes:
    """Words to bucket numbers: one for the word without its edges, one for its shape.  A bounded memory of words
    holds what was computed before."""

    def __init__(self, room: int = 250_000):
        self.room, self.known = room, {}

    @staticmethod
    def code(word: bytes) -> int:
        bare = word.strip(EDGES).lower()
        shape = RUN.sub(rb"\1\1", word.translate(CLASSES))[:12]
        return zlib.crc32(bare) % WORDS * SHAPES + zlib.crc32(shape) % SHAPES

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word of texts laid end to end: its two buckets, and its text's number."""
        hashes, starts, lengths, text = words_of(data, ends, lower=False)
        different, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        known, codes = self.known, np.empty(len(different), np.int64)
        for i, h in enumerate(different.tolist()):
            c = known.get(h)
            if c is None:
                at = starts[first[i]]
                c = known[h] = self.code(data[at : at + lengths[first[i]]].tobytes())
            codes[i] = c
        if len(known) > self.room:
            known.clear()
        word, shape = np.divmod(codes, SHAPES)
        return word[of], WORDS + shape[of], text


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same in every run."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.float32)
    rows = np.arange(BUCKETS)
    for _ in range(ONES):
        out[rows, rng.integers(0, DIM, BUCKETS)] += rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


def add_contexts(word: np.ndarray, shape: np.ndarray, text: np.ndarray, index: np.ndarray, context: np.ndarray, counts: np.ndarray) -> None:
    """Add to each bucket's context the index vectors of the words up to ``REACH`` before and after, and count it."""
    for at in range(0, len(word), GATHERED):
        low, high = max(0, at - REACH), min(len(word), at + GATHERED + REACH)
        own, t = index[word[low:high]] + index[shape[low:high]], text[low:high]
        near = np.zeros_like(own)
        for step in range(1, REACH + 1):
            together = (t[step:] == t[:-step])[:, None]
            near[:-step] += own[step:] * together
            near[step:] += own[:-step] * together
        inside = slice(at - low, min(len(word), at + GATHERED) - low)
        for bucket in (word[low:high][inside], shape[low:high][inside]):
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            context[bucket[order][first]] += np.add.reduceat(near[inside][order], first, axis=0, dtype=np.float64)
            counts += np.bincount(bucket, minlength=BUCKETS)


def word_vectors(context: np.ndarray, counts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Weighted vector of each bucket, with its weight as the last column."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = context / np.maximum(norm, 1e-9) + index / np.sqrt(ONES)
    weight = 1e-3 / (1e-3 + counts / max(1.0, counts.sum()))
    # Shapes are few and frequent, and all the more telling for it.
    weight[WORDS:] = 1.0
    return np.hstack([vectors * weight[:, None], weight[:, None]]).astype(np.float32)


def pooled(word: np.ndarray, shape: np.ndarray, text: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Of each of ``n`` texts the mean word vector, the mean shape vector, and of its words the shares that repeat the one
    before and that are different; zeros without words."""
    out, ones = [], np.ones(min(GATHERED, len(word)), np.float32)
    bounds = np.searchsorted(text, np.arange(n + 1))
    for bucket in (word, shape):
        total = np.zeros((n, DIM + 1))
        for i in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            for at in range(bounds[i], bounds[i + 1], GATHERED):
                own = bucket[at : min(at + GATHERED, bounds[i + 1])]
                total[i] += ones[: len(own)] @ table[own]
        out.append(total[:, :DIM] / np.maximum(total[:, DIM:], 1e-9))
    same = (word[1:] == word[:-1]) & (shape[1:] == shape[:-1]) & (text[1:] == text[:-1])
    count = lambda t: np.bincount(t, minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
    return np.column_stack([*out, count(text[1:][same]), count(np.unique(text * WORDS + word) // WORDS)])


@dataclass
class Model:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def network(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> Model:
    """Fitted with Adam on four fifths; the rest sets the temperature."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    mean = x[fit].mean(0) if len(fit) else np.zeros(x.shape[1])
    scale = x[fit].std(0) + 1e-3 if len(fit) else np.ones(x.shape[1])
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z = (x - mean) / scale
    for _ in range(ROUNDS if 0 < y.sum() < len(y) else 0):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            h = np.tanh(z[at] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[at]) / len(at)
            dh = np.outer(d, w[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((z[at].T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = Model(table, mean, scale, w[0], w[1], w[2], float(w[3]))
    if len(held):
        logit = model.logits(x[held])

        def loss(temperature: float) -> float:
            s = np.clip(logit / temperature, -30, 30)
            return float(np.mean(np.log1p(np.exp(-s)) * y[held] + np.log1p(np.exp(s)) * (1 - y[held])))

        model.temperature = min(np.geomspace(0.5, 5, 41).tolist(), key=loss)
    return model


def held_out(id_col: str) -> Column:
    """Whether a row's label stays unseen: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled documents, whole, however long they are.

    The sample is the labelled ids, not held out, that come first by hash; ids with contradicting or null
    labels are left out, and rows without words teach nothing about words.  Repeated rows of an id all count.
    Without labels, or with those of one kind, every score is the share of good ones.  The texts stay on the
    executors: what reaches the driver are the ids, a matrix of fixed size from each of a few tasks, and a row of
    features for each text.
    """
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    agreed = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
        .where("low = high")
    )
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.col("low").cast("double").alias("y")).collect()
    index = index_vectors()
    context, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    if not chosen:
        return network(np.zeros((0, WIDE)), np.zeros(0), word_vectors(context, counts, index))
    named = spark.createDataFrame(chosen, "doc_id long, y double")
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(named), "doc_id")  # at most sample_rows
    sample = stored(wanted.repartition(SAMPLE_TASKS, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text"), "quality-sample")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums, seen, codes = index_vectors(), np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS), Codes()
        for batch in batches:
            for _, _, data, ends in slices(batch.column("text")):
                add_contexts(*codes(data, ends), vectors, sums, seen)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["context", "counts"])

    for row in sample.select("text").mapInArrow(contexts, "context binary, counts binary").toLocalIterator():
        context += np.frombuffer(row["context"], np.float32).reshape(BUCKETS, DIM)
        counts += np.frombuffer(row["counts"])
    table = word_vectors(context, counts, index)
    rows = with_features(sample.select("doc_id", "y", F.xxhash64("text").alias("h"), "text"), table).drop("text").orderBy("doc_id", "h").collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(-1, WIDE)
    return network(x, np.array([r["y"] for r in rows], float), table)


def with_features(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with their ``text``'s pooled vectors as x, doubles in a binary."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*rows.schema.fields, T.StructField("x", T.BinaryType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            x = features(batch.column("text"), codes, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in x], pa.binary())], names=schema.names)

    return rows.mapInArrow(made, schema)


def features(texts: pa.Array, codes: Codes, table: np.ndarray) -> np.ndarray:
    parts = [pooled(*codes(data, ends), last - first, table) for first, last, data, ends in slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDE))


def classify(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (the higher, the likelier of good quality) and predicted of every row.

    Whole texts are read.  A null or empty text gets the score of a document without words; repeated rows each
    get their row; an empty table gives no rows; other columns are ignored unless named in ``keep``, which
    carries them as they are.  The model, of fixed size, is sent to each worker once.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep]
    )
    types = [("doc_id", docs.schema[id_col].dataType), ("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in types] + [T.StructField(f"kept_{c}", docs.schema[c].dataType) for c in keep])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, codes = shared.value, Codes()
        for batch in batches:
            score = learned.score(features(batch.column("text"), codes, learned.table))
            made = {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in schema.names], names=schema.names)

    return rows.mapInArrow(scored, schema)


def reject(docs: DataFrame, model: Model, **how) -> DataFrame:
    """The documents of predicted good quality, with their columns as they were, whatever their names; rows as in
    :func:`classify`, null and empty texts among them."""
    columns = docs.columns
    return classify(docs, model, keep=tuple(columns), **how).where("predicted = 1").select(*[F.col(f"kept_{c}").alias(c) for c in columns])
