"""Overlaps of word sets of some texts with all texts, counted where blocks of both meet: no pair and no shared word is shuffled.

Words are 64-bit hashes. New texts are dealt into parts and existing ones into
cells, by a hash of their ids; each part meets each cell in one task, which
holds the part's words as postings and counts, for a few existing texts at a
time, how many words they share with every new one. What leaves a task is a
row or a few a new text, so shuffles grow with the texts, not with the pairs;
the pairs themselves are counted one by one, as an exact answer needs.

The overlap of two texts is the number of shared words over the smaller set's
size. Rows of one id count as one text with all their words, of the least size
among them. Rows without id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.stores import kept

#: Texts of a part and of a cell; shared words and pairs that are counted at once.
BLOCK, STEP = 16_384, 1 << 20
#: Sets of so few words meet all others at once, so many to a part; counters of words; words looked up beyond those that a prefix filter needs.
SMALL, MANY, COUNTERS, EXTRA = 16, 65_536, 1 << 20, 4
_NONE = np.iinfo(np.int64).max
#: Places of both sides, and a figure of the pair.
_Met = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def hashed(texts: DataFrame) -> DataFrame:
    """id and the hashes of a text's words."""
    return texts.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.transform(T.word_set("content"), lambda w: F.xxhash64(w)).alias("words"))


class _Side:
    """Distinct ids in their order, set sizes, and all words with the place of their id."""

    def __init__(self, table: pa.Table, least: int):
        words = table["words"].combine_chunks()
        n = np.asarray(words.value_lengths().fill_null(0), np.int64)
        flat = words.flatten().to_numpy(zero_copy_only=False)
        held = n >= least
        flat, ids, n = flat[np.repeat(held, n)], table["id"].to_numpy()[held], n[held]
        self.ids, place = np.unique(ids, return_inverse=True)
        self.sizes = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(self.sizes, place, n)
        at = np.repeat(place, n)
        order = np.argsort(at, kind="stable")
        self.at, self.words = at[order], flat[order]


def _shared(ours: tuple[np.ndarray, np.ndarray], n_ours: int, theirs: tuple[np.ndarray, np.ndarray], n_theirs: int) -> _Met:
    """Places of both sides that share a word, and how many they share, for ranges of the second side one after another; a side is (at, words) in the order of its places."""
    (our_at, our_words), (at, words) = ours, theirs
    if not len(our_at) or not len(at):
        return
    known, word = np.unique(our_words, return_inverse=True)
    posts = our_at[np.argsort(word, kind="stable")]
    ends = np.cumsum(np.bincount(word, minlength=len(known)))
    starts = np.concatenate([[0], ends[:-1]])
    found = np.minimum(np.searchsorted(known, words), len(known) - 1)
    hit = known[found] == words
    at, found = at[hit], found[hit]
    lengths = ends[found] - starts[found]
    # Shared words of all before each place; a range ends where these or its pairs are enough for a step.
    before = np.concatenate([[0], np.cumsum(np.bincount(at, lengths, n_theirs))]).astype(np.int64)
    first_hit = np.searchsorted(at, np.arange(n_theirs + 1))
    i, wide = 0, max(1, STEP // n_ours)
    while i < n_theirs:
        j = max(i + 1, min(i + wide, int(np.searchsorted(before, before[i] + STEP, "right")) - 1, n_theirs))
        lo, hi = first_hit[i], first_hit[j]
        n = lengths[lo:hi]
        if total := int(n.sum()):
            skip = np.cumsum(n) - n
            post = posts[np.repeat(starts[found[lo:hi]] - skip, n) + np.arange(total)]
            shared = np.bincount(np.repeat((at[lo:hi] - i) * n_ours, n) + post)
            pair = np.flatnonzero(shared)
            o, m = np.divmod(pair, n_ours)
            yield m, o + i, shared[pair]
        i = j


def _met(new: _Side, old: _Side) -> _Met:
    """Places of new and old texts of different ids that share a word, and their overlap."""
    for m, o, shared in _shared((new.at, new.words), len(new.ids), (old.at, old.words), len(old.ids)):
        apart = new.ids[m] != old.ids[o]
        m, o = m[apart], o[apart]
        yield m, o, shared[apart] / np.minimum(new.sizes[m], old.sizes[o])


def _dealt(new: DataFrame, existing: DataFrame, least: int, schema: str, work: Callable[[_Side, _Side], dict], block: int) -> DataFrame:
    """What ``work`` tells of every part of new texts with every cell of existing ones that aren't superseded."""
    known = existing.where(~F.col("content").contains("<!-- superseded"))
    parts, cells = (max(1, -(-side.count() // block)) for side in (new, existing))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = hashed(new).withColumn("part", dealt(parts)).withColumn("cell", copied(cells))
    every = hashed(known).withColumn("cell", dealt(cells)).withColumn("part", copied(parts))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        told = work(_Side(ours, least), _Side(theirs, 1))
        return pa.table({name: told[name] for name in names})

    return some.groupBy("part", "cell").cogroup(every.groupBy("part", "cell")).applyInArrow(meet, schema)


def figures(new: DataFrame, existing: DataFrame, threshold: float, least: int = 3, block: int = BLOCK) -> DataFrame:
    """new_id, candidates, first and last: how many existing texts overlap so much at least with each new one of so many words, the least id and the greatest."""

    def work(ours: _Side, theirs: _Side) -> dict:
        n = np.zeros(len(ours.ids), np.int64)
        first, last = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
        for m, o, similarity in _met(ours, theirs):
            fits = similarity >= threshold
            m, ids = m[fits], theirs.ids[o[fits]]
            n += np.bincount(m, minlength=len(n))
            np.minimum.at(first, m, ids)
            np.maximum.at(last, m, ids)
        some = n > 0
        return {"new_id": ours.ids[some], "candidates": n[some], "first": first[some], "last": last[some]}

    told = _dealt(new, existing, least, "new_id long, candidates long, first long, last long", work, block)
    return told.groupBy("new_id").agg(F.sum("candidates").alias("candidates"), F.min("first").alias("first"), F.max("last").alias("last"))


def top(new: DataFrame, existing: DataFrame, n: int, threshold: float, least: int = 3, block: int = BLOCK) -> DataFrame:
    """new_id, old_id, similarity and rank: the n existing texts that overlap most with each new one of so many words, above the threshold, ties by id."""

    def work(ours: _Side, theirs: _Side) -> dict:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        # A new text's n-th overlap so far: what lies below it can't be among its n best.
        floor = np.zeros(len(ours.ids))
        for m, o, similarity in _met(ours, theirs):
            may = (similarity > threshold) & (similarity >= floor[m])
            if not may.any():
                continue
            m, o, s = (np.concatenate([b, x[may]]) for b, x in zip(best, (m, o, similarity), strict=True))
            order = np.lexsort((o, -s, m))
            m, o, s = m[order], o[order], s[order]
            nth = np.arange(len(m)) - np.searchsorted(m, m)
            floor[m[nth == n - 1]] = s[nth == n - 1]
            best = [x[nth < n] for x in (m, o, s)]
        return {"new_id": ours.ids[best[0]], "old_id": theirs.ids[best[1]], "similarity": best[2]}

    told = _dealt(new, existing, least, "new_id long, old_id long, similarity double", work, block)
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= n)


class _Sets:
    """Distinct word sets in the order of the least live id that has them (none: last), words rarest first."""

    def __init__(self, table: pa.Table):
        words = table["words"].combine_chunks()
        n, flat = np.asarray(words.value_lengths(), np.int64), words.flatten().to_numpy(zero_copy_only=False)
        first = table["first"].fill_null(_NONE).to_numpy()
        order = np.argsort(first, kind="stable")
        begins = (np.cumsum(n) - n)[order]
        self.keys, self.first, self.last, self.n = table["key"].to_numpy()[order], first[order], table["last"].to_numpy()[order], n[order]
        self.begins = np.cumsum(self.n) - self.n
        self.nth = np.arange(self.n.sum()) - np.repeat(self.begins, self.n)
        self.words = flat[np.repeat(begins, self.n) + self.nth]
        self.at = np.repeat(np.arange(len(self.n)), self.n)

    def looked(self, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Each set's rarest words that are looked up, and how many of them a set that holds enough of it must have."""
        least = np.floor(self.n * threshold).astype(np.int64) + 1
        n = np.minimum(self.n, self.n - least + 1 + EXTRA)
        some = self.nth < np.repeat(n, self.n)
        return (self.at[some], self.words[some]), least - self.n + n

    def marks(self) -> np.ndarray:
        return np.sort(_mark(self.at, self.words))


def _mark(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words ^ ((at + 1) * np.int64(0x1E3779B97F4A7C15))


def _common(small: _Sets, s: np.ndarray, marks: np.ndarray, large: np.ndarray) -> np.ndarray:
    """How many words of each small set the large one holds, whose marks are sorted."""
    n = small.n[s]
    skip = np.cumsum(n) - n
    words = small.words[np.repeat(small.begins[s] - skip, n) + np.arange(n.sum())]
    mark = _mark(np.repeat(large, n), words)
    held = marks[np.minimum(np.searchsorted(marks, mark), len(marks) - 1)] == mark
    return np.add.reduceat(held.astype(np.int64), skip) if len(s) else n


def _told(sides: list[tuple[_Sets, np.ndarray]]) -> pa.Table:
    key, other = (np.concatenate(x) for x in zip(*[(side.keys[best < _NONE], best[best < _NONE]) for side, best in sides], strict=True))
    return pa.table({"key": key, "other": other})


def _met_sets(ours: DataFrame, n_ours: int, theirs: DataFrame, n_theirs: int, work: Callable[[_Sets, _Sets], pa.Table]) -> DataFrame:
    """key and the least id of a near set, of every part of one side with every cell of the other."""
    columns = ["key", "first", "last", "words"]
    parts, cells = (max(1, n) for n in (n_ours, n_theirs))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = ours.select(*columns, dealt(parts).alias("part")).withColumn("cell", copied(cells))
    every = theirs.select(*columns, dealt(cells).alias("cell")).withColumn("part", copied(parts))
    told = some.groupBy("part", "cell").cogroup(every.groupBy("part", "cell")).applyInArrow(lambda a, b: work(_Sets(a), _Sets(b)), "key long, other long")
    return told.groupBy("key").agg(F.min("other").alias("other"))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with their words rarest first, by counters of their hashes: one order for all sets."""
    slot = lambda w: F.pmod(w, F.lit(COUNTERS)).cast("int")
    counts = rows.select(F.explode("words").alias("w")).groupBy(slot(F.col("w")).alias("slot")).agg(F.count("*").alias("n")).toArrow()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[counts["slot"].to_numpy()] = counts["n"].to_numpy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1_024):
                batch = whole.slice(i, 1_024)
                words = batch.column("words")
                n, flat = np.asarray(words.value_lengths(), np.int64), words.flatten().to_numpy(zero_copy_only=False)
                order = np.lexsort((flat, often[flat % COUNTERS], np.repeat(np.arange(len(n)), n)))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat[order]))
                yield batch.set_column(batch.schema.get_field_index("words"), "words", listed)

    return rows.mapInArrow(work, rows.schema)


def contained(texts: DataFrame, threshold: float, least: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """new_id: texts of so many words at least to which an earlier text, by id, that isn't superseded has a greater overlap.

    Equal word sets are one row. Sets of few words meet all sets first: most
    large sets hold an earlier small one, and need nothing more. What is still
    undecided meets all sets of many words. Of two of those the smaller has
    some of its rarest words in the larger one, as the rest alone could not
    reach the threshold: only those are looked up, and what shares enough of
    them is verified on the sets. No pair leaves its task.
    """
    words = F.array_sort(F.transform(T.word_set("content"), lambda w: F.xxhash64(w)))
    rows = texts.where("id IS NOT NULL AND content IS NOT NULL").select(F.col("id").cast("long").alias("id"), words.alias("words"), (~F.col("content").contains("<!-- superseded")).alias("live"))
    rows = kept(rows.withColumn("key", F.xxhash64("words")).where(F.size("words") > 0), "words")
    sets = rows.groupBy("key").agg(F.first("words").alias("words"), F.min(F.when(F.col("live"), F.col("id"))).alias("first"), F.min("id").alias("least"), F.max("id").alias("last"))
    sets = kept(ranked(sets), "sets").withColumn("n", F.size("words"))
    few = sets.where(F.col("n") <= small)
    figures = sets.agg(F.count("*").alias("all"), F.count_if(F.col("n") <= small).alias("few")).first()
    cells = -(-figures["all"] // block)

    def tiny(ours: _Sets, theirs: _Sets) -> pa.Table:
        best, others = np.full(len(ours.n), _NONE), np.full(len(theirs.n), _NONE)
        for m, o, shared in _shared((ours.at, ours.words), len(ours.n), (theirs.at, theirs.words), len(theirs.n)):
            near = (shared / np.minimum(ours.n[m], theirs.n[o]) > threshold) & (ours.keys[m] != theirs.keys[o])
            m, o = m[near], o[near]
            np.minimum.at(best, m, theirs.first[o])
            np.minimum.at(others, o, ours.first[m])
        return _told([(ours, best), (theirs, others)])

    first = kept(_met_sets(few, -(-figures["few"] // MANY), sets, cells, tiny), "first")
    open_ = sets.where((F.col("n") > small) & (F.col("n") >= least)).join(first, "key", "left").where(F.col("least") <= F.least(F.coalesce("first", F.lit(int(_NONE))), F.coalesce("other", F.lit(int(_NONE)))))
    open_ = kept(open_.select("key", "first", "last", "words"), "open")

    def large(ours: _Sets, theirs: _Sets) -> pa.Table:
        best = np.full(len(ours.n), _NONE)
        if len(ours.n) and len(theirs.n):
            our_marks, their_marks = ours.marks(), theirs.marks()
            (probes, needed), (others, needs) = theirs.looked(threshold), ours.looked(threshold)
            # The other set is the smaller one; then the larger.
            for smaller, a, b in ((True, (ours.at, ours.words), probes), (False, others, (theirs.at, theirs.words))):
                for m, o, hits in _shared(a, len(ours.n), b, len(theirs.n)):
                    fits = (theirs.n[o] <= ours.n[m]) & (hits >= needed[o]) if smaller else (theirs.n[o] > ours.n[m]) & (hits >= needs[m])
                    fits &= (theirs.first[o] < np.minimum(ours.last[m], best[m])) & (ours.keys[m] != theirs.keys[o])
                    m, o = m[fits], o[fits]
                    for i in range(0, len(m), 8_192):
                        x, y = m[i : i + 8_192], o[i : i + 8_192]
                        common = _common(theirs, y, our_marks, x) if smaller else _common(ours, x, their_marks, y)
                        near = common / np.minimum(ours.n[x], theirs.n[y]) > threshold
                        np.minimum.at(best, x[near], theirs.first[y[near]])
        return _told([(ours, best)])

    second = _met_sets(open_, -(-open_.count() // (2 * block)), sets.where((F.col("n") > small) & F.col("first").isNotNull()), cells, large)
    others = first.unionByName(second).groupBy("key").agg(F.min("other").alias("other"))
    asked = rows.where(F.size("words") >= least).select("key", "id").join(sets.select("key", "first").join(others, "key", "left"), "key")
    return asked.where(F.col("id") > F.least("first", "other")).select(F.col("id").alias("new_id"))
