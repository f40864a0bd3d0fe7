"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: log counts of its words in ``BUCKETS`` hashed
slots (scaled to length one), statistics of its structure, and its length. The
score is the sigmoid of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

- all pairwise interactions, by the sum-of-squares identity in time linear in
the entries of x. Language, source, labels and doc_id are never part of x.

Fitting: Adagrad on the log loss over at most ``SAMPLE`` labelled rows, the
first in order of a hash of doc_id among those whose crc32 of doc_id as text
isn't divisible by 5. That bound is the one place that doesn't see all rows;
scoring reads every whole text, in one pass without a shuffle.

Defined results: a null text counts as empty and is scored; where no row is
labelled every score is 0.5; labels of a document that contradict each other
count as 0; rows without doc_id are scored and not held out; repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, numbered, slices, small_batches, table

BUCKETS, FACTORS, SAMPLE, THRESHOLD = 1 << 15, 8, 6_000, 0.3
#: Marks whose share of the text is a statistic of its own.
MARKS = "!|#$%&*.,"
STATISTICS = 11 + len(MARKS)
_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
_UPPER = np.array([chr(b).isupper() for b in range(128)] + [False] * 128)
_DIGIT = np.array([chr(b).isdigit() for b in range(128)] + [False] * 128)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the sparse vector of a whole text."""
    words = text.split()
    counts = Counter(words)
    slots = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in counts), dtype=np.int64, count=len(counts)) % BUCKETS
    values = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(values):
        values /= np.sqrt(values @ values)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(raw, minlength=256) / max(1, len(raw))
    letters, n = max(share @ _LETTER, 1e-9), max(1, len(words))
    most = max(counts.values(), default=0)
    statistics = [
        1.0,
        np.log1p(len(raw)) / 12,
        np.log1p(text.count("\n")) / 8,
        (share @ _UPPER) / letters,
        share @ _DIGIT,
        share[128:].sum(),
        1 - letters - share[128:].sum(),
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        most / n,
        min(1.0, len(raw) / n / 20),
        *(min(1.0, 5 * share[ord(c)]) for c in MARKS),
    ]
    return np.concatenate([slots, BUCKETS + np.arange(STATISTICS)]), np.concatenate([values, statistics])


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, seed: int = 7):
        n = BUCKETS + STATISTICS
        self.bias, self.linear = 0.0, np.zeros(n)
        self.factors = np.random.default_rng(seed).normal(0, 0.01, (n, FACTORS))
        self.fitted = False

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the factor sums, of rows that begin at ``starts``."""
        weighted = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted * weighted, starts, axis=0)
        linear = np.add.reduceat(self.linear[slots] * values, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(rows), 0.5)
        z, _ = self.raw(*_joined(rows)[:3])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
        """Adagrad over small batches, in an order fixed by ``seed``."""
        if not len(rows):
            return self
        p = min(max(labels.mean(), 0.01), 0.99)
        self.bias, self.fitted = float(np.log(p / (1 - p))), True
        past_b, past_w, past_v = 1e-6, np.full(len(self.linear), 1e-6), np.full(self.factors.shape, 1e-6)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            turn = order.permutation(len(rows))
            for begin in range(0, len(rows), 64):
                some = turn[begin : begin + 64]
                slots, values, starts, row = _joined([rows[i] for i in some])
                z, sums = self.raw(slots, values, starts)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
                here, inverse = np.unique(slots, return_inverse=True)
                slope = error[row] * values
                step_w = np.bincount(inverse, slope, len(here)) + decay * self.linear[here]
                each = slope[:, None] * (sums[row] - self.factors[slots] * values[:, None])
                step_v = np.stack([np.bincount(inverse, each[:, f], len(here)) for f in range(FACTORS)], axis=1) + decay * self.factors[here]
                past_b += error.sum() ** 2
                past_w[here] += step_w**2
                past_v[here] += step_v**2
                self.bias -= rate * error.sum() / np.sqrt(past_b)
                self.linear[here] -= rate * step_w / np.sqrt(past_w[here])
                self.factors[here] -= rate * step_v / np.sqrt(past_v[here])
        return self


def _joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s, _ in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts, np.repeat(np.arange(len(rows)), lengths)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on a bounded sample of the labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                ["doc_id", "quality", "slots", "values"],
            )

    got = rows.mapInArrow(work, "doc_id long, quality int, slots binary, values binary").toArrow().sort_by("doc_id")
    vectors = [(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for s, v in zip(got["slots"].to_pylist(), got["values"].to_pylist(), strict=True)]
    return Machine().fit(vectors, np.array(got["quality"].to_pylist(), dtype=np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row; the weights, of fixed size, go to the workers with the function."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=256):
            scores = machine.score([features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(work, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    small_batches(docs.sparkSession)
    plain, text, _ = numbered(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{text}", rows=256):
            scores = machine.score([features(t or "") for t in batch.column(text).to_pylist()])
            yield batch.filter(pa.array(scores >= threshold))

    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels.quality."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
