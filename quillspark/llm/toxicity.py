"""Toxic passages: maximum-scoring segments over token log-odds, with Dirichlet priors and extreme-value significance.

Token scores. Documents marked toxic and documents marked clean are two samples
of tokens, each token counted once a document. Their prior is the whole corpus:
a token has ``FLOOR`` and its share of ``PRIOR`` pseudo-counts in either. The
score is the difference of the posterior log-odds, drawn to zero by ``SURE``
of its standard deviations, less ``DRIFT`` - so that rare words say little and
ordinary text scores below zero on the average. Tokens are counted in
``BUCKETS`` hashed counters, over all documents for the prior; a table of fixed
size leaves the counting and goes to the workers.

Segments. One pass over a text's tokens keeps a list of disjoint segments that
can't be made better by lengthening, shortening or joining: all maximal ones, in
linear time (each token enters and leaves the list once).

Significance. In clean text of n tokens, segments of score s or more are
expected E = K n exp(-lambda s) times. lambda is the positive solution of
sum p exp(lambda s) = 1 over the clean documents' token distribution, K the
likeliest value for the best segments of clean documents (censored at zero where
a document has none). A segment is significant if E is at most ``ALPHA``. A
document's evidence is the sum of -ln E over its significant segments; a
logistic curve, fitted to the labelled documents, turns it into the score.

Fitting uses at most ``SAMPLE`` labelled rows, the first by a hash of doc_id of
those that aren't held out (crc32 of doc_id as text mod 4 is 2: held out).
Scoring reads every whole text in one pass without a shuffle.

Defined results: a null or empty text has no segments and is scored; where no
document is marked toxic, nothing is known and every score is 0; a document that
is marked twice is toxic if either mark says so; rows without doc_id are scored
and not held out; repeated rows get equal scores; an empty table gives no rows;
other columns are ignored, whatever their names. Memory follows the longest
text, its tokens in a few arrays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import delete, documents, slices, stored, table, written

BUCKETS, SAMPLE, THRESHOLD = 1 << 20, 50_000, 0.3
FLOOR, PRIOR, SURE, DRIFT, ALPHA = 0.05, 1_000.0, 1.0, 1.0, 0.05
#: Evidence is counted in so many steps of so much when the curve is fitted.
STEPS, STEP = 200, 0.5
_TOKEN = re.compile(r"[^\W\d_]+")


class Slots(dict):
    """Token to counter; forgets all when it has grown too large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = slot = crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return slot


_SLOTS = Slots()


def tokens(text: str) -> np.ndarray:
    """The counters of a text's tokens (runs of letters, whatever their case), in order."""
    found = _TOKEN.findall(text)
    return np.fromiter(map(_SLOTS.__getitem__, found), np.int64, len(found))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Begin, end (exclusive) and sum of all maximal-scoring segments, in order."""
    after = np.cumsum(scores)
    places = np.flatnonzero(scores > 0)
    rights = after[places]
    lefts = rights - scores[places]
    #: begin, end, sum before, sum after, and the last segment before it whose sum before is less.
    kept: list[tuple[int, int, float, float, int]] = []
    for begin, left, right in zip(places.tolist(), lefts.tolist(), rights.tolist(), strict=True):
        end = begin + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((begin, end, left, right, j))
                break
            begin, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(begin, end, right - left) for begin, end, left, right, _ in kept]


class Model:
    """Token scores, the law of the best segment in clean text, and the curve from evidence to score."""

    def __init__(self, weights: np.ndarray, decay: float = 1.0, k: float = 1.0, level: float = -math.inf, slope: float = 0.0):
        self.weights, self.decay, self.k, self.level, self.slope = weights, decay, k, level, slope

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        slots = tokens(text)
        return len(slots), segments(self.weights[slots]) if len(slots) else []

    def expected(self, n: int, score: float) -> float:
        """How many segments of clean text of n tokens score as much."""
        return self.k * n * math.exp(-self.decay * score)

    def significant(self, text: str) -> list[tuple[int, int, float, float]]:
        """Begin and end in tokens, score and E of each significant segment."""
        n, found = self.found(text)
        told = [(b, e, s, self.expected(n, s)) for b, e, s in found]
        return [x for x in told if x[3] <= ALPHA]

    def score(self, evidence: float) -> float:
        if self.level == -math.inf:
            return 0.0
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.level + self.slope * math.log1p(evidence)))))


def evidence(significant: list[tuple[int, int, float, float]]) -> float:
    return sum(-math.log(max(e, 1e-300)) for *_, e in significant)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of the labelled rows to learn from: ``sample`` at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def counts(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Documents that hold a token, by counter: of all, of those marked clean, of those marked toxic."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS), np.int64)
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                slots = np.unique(tokens(text))
                total[0, slots] += 1
                if toxic is not None:
                    total[1 + toxic, slots] += 1
        some = np.flatnonzero(total[0])
        for low in range(0, len(some), 50_000):
            part = some[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(total[i, part]) for i in range(3))], ["slot", "n", "clean", "toxic"])

    rows = documents(docs).join(F.broadcast(known), "doc_id", "left").select("text", "toxic").mapInArrow(work, "slot int, n long, clean long, toxic long")
    got = rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", "clean", "toxic"))).toArrow()  # BUCKETS rows at most
    total = np.zeros((3, BUCKETS), np.int64)
    for i, name in enumerate(("n", "clean", "toxic")):
        total[i, got["slot"].to_numpy()] = got[name].to_numpy()
    return total


def log_odds(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token scores, and the distribution of tokens in clean documents."""
    seen, clean, toxic = total.astype(np.float64)
    prior = FLOOR + PRIOR * seen / max(1.0, seen.sum())
    a, b = toxic + prior, clean + prior
    delta = np.log(a) - np.log(a.sum() - a) - np.log(b) + np.log(b.sum() - b)
    spread = SURE * np.sqrt(1 / a + 1 / b)
    return np.sign(delta) * np.maximum(0, np.abs(delta) - spread) - DRIFT, b / b.sum()


def decay_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; 1 where no score is positive or their mean isn't negative."""
    if scores.max() <= 0 or scores @ shares >= 0:
        return 1.0
    value = lambda x: float(shares @ np.exp(x * scores))
    high = 1.0
    while value(high) < 1:
        high *= 2
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return high


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Level and slope of the logistic curve over log1p(evidence) for (evidence, clean, toxic) counts; the slope isn't negative."""
    x = np.log1p(np.array([e for e, _, _ in bins]))
    clean, toxic = (np.array([b[i] for b in bins], np.float64) for i in (1, 2))
    level, slope = math.log((toxic.sum() + 1) / (clean.sum() + 1)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(level + slope * x, -30, 30)))
        error, w = toxic - (toxic + clean) * p, (toxic + clean) * p * (1 - p) + 1e-9
        step = np.linalg.solve([[w.sum() + 0.1, w @ x], [w @ x, w @ (x * x) + 0.1]], [error.sum(), error @ x - 0.1 * slope])
        level, slope = level + float(np.clip(step[0], -2, 2)), slope + float(np.clip(step[1], -2, 2))
    return level, max(0.0, slope)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Count, score tokens, and calibrate on the sample of labelled documents."""
    before = written()
    known = stored(sampled(labels, sample), "toxic-labels")
    total = counts(docs, known)
    if not total[2].any():
        delete(docs.sparkSession, [p for p in written() if p not in before])
        return Model(np.full(BUCKETS, -DRIFT))
    weights, shares = log_odds(total)
    model = Model(weights.astype(np.float32).astype(np.float64), decay_rate(weights, shares))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            told = [model.found(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in told], pa.int64()), pa.array([[s for *_, s in found] for _, found in told], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    rows = stored(documents(docs).join(F.broadcast(known), "doc_id").select("text", "toxic").mapInArrow(work, "toxic int, n long, scores array<double>"), "toxic-segments")
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    law = rows.where("toxic = 0").agg(F.count_if(best > 0).alias("some"), F.sum(F.col("n") * F.exp(-best * model.decay)).alias("weight")).first()
    # Half a document stands for none, so that K is never 0.
    model.k = (law["some"] + 0.5) / max(1.0, law["weight"] or 0.0)
    surprise = lambda s: s * model.decay - F.log(F.col("n") * model.k)
    told = F.aggregate(F.transform("scores", surprise), F.lit(0.0), lambda t, v: t + F.when(v >= -math.log(ALPHA), v).otherwise(0.0))
    step = F.least(F.ceil(told / STEP), F.lit(STEPS)).cast("int")
    binned = rows.groupBy(step.alias("step")).agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).collect()  # STEPS + 1 rows
    model.level, model.slope = curve([(r["step"] * STEP, r["clean"], r["toxic"]) for r in binned])
    delete(docs.sparkSession, [p for p in written() if p not in before])
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, begin and end in code points, passage, score and E of every significant segment of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if told := model.significant(text):
                    spans = [m.span() for m in _TOKEN.finditer(text)]
                    out += [(doc, spans[b][0], spans[e - 1][1], text[spans[b][0] : spans[e - 1][1]], s, x) for b, e, s, x in told]
            kinds = [("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("passage", pa.string()), ("score", pa.float64()), ("expected", pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return documents(docs).mapInArrow(work, "doc_id long, begin long, end long, passage string, score double, expected double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, the number of significant passages and the least E among them (null: none) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            told = [model.significant(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([model.score(evidence(t)) for t in told], pa.float64()), pa.array([len(t) for t in told], pa.int64()), pa.array([min((x[3] for x in t), default=None) for t in told], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "passages", "least_expected"])

    return documents(docs).mapInArrow(work, "doc_id long, score double, passages long, least_expected double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels.toxic."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages", "least_expected")
