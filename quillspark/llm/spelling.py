"""Spelling variants: every word's commonest near word, without making pairs of words.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. Words get a rank in the order of falling count and then of code
points, so that the best of a set of words is the one of least rank. Every word
of the vocabulary puts down keys of a few bytes:

* one a position, the word with that position left open. Words that meet under
  such a (position, prefix, suffix) differ there and only there, so a group's
  size and its two least ranks tell each of its words how many it meets and
  which is the best of them;
* one a distinct string that a deletion leaves, and one for the word itself.
  Where a word meets the deletions of longer ones, it learns their number and
  the best, and each of them learns it.

A group holds a word a letter of the alphabet at most for replacements, and a
word a letter and place for insertions; a word meets each near word under one
key. So the work is in proportion to the letters of the vocabulary, whatever a
word's frequency or the number of its variants, and no pair of words is made.

Keys are two independent sums of 64-bit hashes of (place, code point): prefix
sums give those of all positions of a word in time linear in its length.

Defined results: a null text holds no words; a null doc_id counts as the empty
string; repeated rows count each; a run of any length is one word; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import delete, slices, stored, table, written

SHORTEST, EVERY, LEAST, RATIO = 7, 31, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of keys: a position left open, what a deletion leaves, the word itself.
OPEN, SHORTER, ITSELF = 0, 1, 2
#: No code points: the open position, and the end of a string.
STAR, END = 0x110000, 0x110001
#: Letters whose keys are made at once.
PIECE = 1 << 18


def words(docs: DataFrame, shortest: int = SHORTEST, every: int = EVERY) -> DataFrame:
    """word and n, its occurrences in all texts: maximal runs of letters, one letter left out where a hash of document and run says so."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    # A run that is too short stays so without a letter: only long ones leave the row.
    runs = F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    less = F.overlay("run", F.lit(""), (h % F.length("run")).cast("int") + 1, F.lit(1))
    word = F.when(h % every == 0, less).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """r, word and n of the words that occur often enough; r grows with falling n, then with the word's code points."""
    often = words(docs).where(F.col("n") >= least)
    # Ids grow with partition and place, so in a sorted table with the order; stored, they stay.
    return stored(often.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("r"), "word", "n"), "words")


def _mixed(place: np.ndarray, point: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each pair."""
    with np.errstate(over="ignore"):
        h = (place.astype(np.uint64) << np.uint64(21)) + point.astype(np.uint64) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def keys(texts: list[str], shortest: int = SHORTEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Both halves of keys, the number of their word and their kind, some ``PIECE`` letters at a time."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    if not len(points):
        return
    ends = [_mixed(lengths, np.full(len(lengths), END), s) for s in SEEDS]
    ends_less = [_mixed(lengths - 1, np.full(len(lengths), END), s) for s in SEEDS]
    whole = [np.zeros(len(texts), np.uint64) for _ in SEEDS]
    shifted = [np.zeros(len(texts), np.uint64) for _ in SEEDS]

    def pieces() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for low in range(0, len(points), PIECE):
            part = slice(low, min(low + PIECE, len(points)))
            word = np.searchsorted(begins, np.arange(part.start, part.stop), side="right") - 1
            yield part, word, np.arange(part.start, part.stop) - begins[word]

    # Sums over whole words, of letters where they stand and one place earlier.
    for part, word, place in pieces():
        firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        for a, seed in enumerate(SEEDS):
            whole[a][word[firsts]] += np.add.reduceat(_mixed(place, points[part], seed), firsts)
            earlier = np.where(place > 0, _mixed(np.maximum(place - 1, 0), points[part], seed), np.uint64(0))
            shifted[a][word[firsts]] += np.add.reduceat(earlier, firsts)
    itself = [whole[a] + ends[a] for a in range(2)]
    yield itself[0], itself[1], np.arange(len(texts)), np.full(len(texts), ITSELF, np.int8)
    # Sums up to each letter carry on from one piece to the next.
    before = [np.zeros(2, np.uint64) for _ in SEEDS]
    for part, word, place in pieces():
        here = points[part]
        firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(word))))
        open_, less = [], []
        for a, seed in enumerate(SEEDS):
            z = _mixed(place, here, seed)
            earlier = np.where(place > 0, _mixed(np.maximum(place - 1, 0), here, seed), np.uint64(0))
            carried = before[a] if place[0] > 0 else np.zeros(2, np.uint64)
            run, run_earlier = np.cumsum(z) + carried[0], np.cumsum(earlier) + carried[1]
            base, base_earlier = run[firsts] - z[firsts], run_earlier[firsts] - earlier[firsts]
            if place[0] > 0:
                base[0] = base_earlier[0] = np.uint64(0)
            prefix, prefix_earlier = run - base[group] - z, run_earlier - base_earlier[group]
            before[a] = np.concatenate([prefix[-1:] + z[-1:], prefix_earlier[-1:]])
            open_.append(whole[a][word] - z + _mixed(place, np.full(len(place), STAR), seed) + ends[a][word])
            less.append(prefix + (shifted[a][word] - prefix_earlier) + ends_less[a][word])
        yield open_[0], open_[1], word, np.full(len(word), OPEN, np.int8)
        # Of equal neighbours the first: leaving out another gives the same string.
        previous = np.append(points[part.start - 1] if part.start else -1, here[:-1])
        new = ((place == 0) | (here != previous)) & (lengths[word] > shortest)
        yield less[0][new], less[1][new], word[new], np.full(int(new.sum()), SHORTER, np.int8)


def keyed(vocab: DataFrame) -> DataFrame:
    """k1, k2, kind and r: all keys of all words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            ranks = batch.column("r").to_numpy()
            for k1, k2, word, kind in keys(batch.column("word").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(kind), pa.array(ranks[word])], ["k1", "k2", "kind", "r"])

    return vocab.select("r", "word").mapInArrow(work, "k1 long, k2 long, kind byte, r long")


def near(vocab: DataFrame) -> DataFrame:
    """r, n_near and best (the least rank of a near word) of every word that has a near word."""
    group = Window.partitionBy("k1", "k2")
    order = group.orderBy("kind", "r")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = keyed(vocab).select(
        "kind",
        "r",
        F.count("*").over(everything).alias("size"),
        F.first("r").over(everything).alias("top"),
        F.nth_value("r", 2).over(everything).alias("second"),
        F.max("kind").over(everything).alias("last_kind"),
        F.last("r").over(everything).alias("last"),
    ).where("size > 1")
    # A group of open positions: the others are near, the best of them is the top or, for the top itself, the second.
    # Else the word itself, if there is one, stands last and the longer words before it.
    opened = F.col("kind") == OPEN
    longer = (F.col("kind") == SHORTER) & (F.col("last_kind") == ITSELF)
    itself = F.col("kind") == ITSELF
    told = seen.where(opened | longer | itself).select(
        "r",
        F.when(longer, 1).otherwise(F.col("size") - 1).alias("met"),
        F.when(longer, F.col("last")).when(opened & (F.col("r") == F.col("top")), F.col("second")).otherwise(F.col("top")).alias("best"),
    )
    return told.groupBy("r").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """r and root: where following forms ends. A form's form takes its place in each round, so the rounds grow with the logarithm of the longest way."""
    spark, before = forms.sparkSession, written()
    way = stored(forms.select("r", F.col("form").alias("root")), "roots")
    while True:
        on = way.select(F.col("r").alias("root"), F.col("root").alias("further"))
        new = stored(way.join(on, "root", "left").select("r", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots")
        mine = [p for p in written() if p not in before]
        delete(spark, mine[:-1])
        way = new.select("r", "root")
        if not new.where("went").limit(1).count():
            return way


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    spark, before = docs.sparkSession, written()
    vocab = vocabulary(docs)
    met = near(vocab)
    best = vocab.select(F.col("r").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = stored(met.join(best, "best").select("r", "n_near", "best", "form", "form_n"), "near")
    rows = vocab.join(told, "r", "left")
    often = F.col("form_n") >= F.col("n") * ratio
    rows = stored(rows.select("r", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(often, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")
    delete(spark, [p for p in written() if p not in before][:-1])
    way = roots(rows.where("form IS NOT NULL").select("r", F.col("best").alias("form")))
    ends = way.join(rows.select(F.col("r").alias("root"), F.col("word").alias("root_word")), "root").select("r", "root_word")
    return rows.join(ends, "r", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with its commonest near word."""
    return variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT id, run, count(*) AS k FROM (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, steps),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
spot AS MATERIALIZED (SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
shorter AS MATERIALIZED (SELECT DISTINCT spot.word, v.word AS other FROM spot JOIN v ON v.word = a || b),
pairs AS (SELECT x.word, y.word AS other FROM spot x JOIN spot y ON x.i = y.i AND x.a = y.a AND x.b = y.b WHERE x.word <> y.word UNION ALL SELECT word, other FROM shorter UNION ALL SELECT other, word FROM shorter),
best AS (SELECT pairs.word, count(*) AS n_near, first(other ORDER BY v.n DESC, encode(other)) AS form, max(v.n) AS form_n FROM pairs JOIN v ON v.word = other GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, form AS further FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.further)
SELECT f.word, f.form, here AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND further IS NULL
"""
