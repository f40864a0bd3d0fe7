"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (a shorter text is one shingle); in scripts
without spaces and in long runs without white space a word is a code point
(``common.words``). A shingle weighs its count times the mean inverse document
frequency of its words, 1 + ln((1 + N) / (1 + df)) / ln(1 + N); df comes from
all documents, counted in ``COUNTERS`` hashed counters, a table of fixed size.
Two texts are linked if the weighted Jaccard similarity of their shingles is
``SIMILARITY`` or more; classes are the connected components of the links.

1. One pass draws ``BANDS`` x ``ROWS`` consistent weighted samples a text
   (Ioffe's improved scheme: the least ln c - r (t - beta) - r with t =
   floor(ln w / r + beta)), hashes each band and keeps a byte of each sample,
   the text's sketch. Equal texts are one from here.
2. Each bucket of a band is compared with its least document: stars, not
   pairs. Sketches rule out most pairs first (agreement in less than ``AGREE``
   bytes has odds of some 1e-5 at similarity 0.8); the others are verified
   exactly, on the two whole texts. The links found are joined into components.
3. What a star may miss is a link of a document that isn't near its bucket's
   centre. So in each bucket that still has several components, the sketches of
   all members outside its largest are compared with those of all members, in
   blocks of about ``BLOCK`` by ``BLOCK`` documents and ``BLOCK_BYTES`` of text.
   Only what agrees with a member of another component meets its text, and is
   verified in its block, a text with many at once (``Shared``). Only links leave
   a block, and only those that join two components within it.

Defined results: texts without a word are near only to equal texts; a null
text counts as empty; rows without doc_id have no class; rows are told apart by
doc_id and text, so two texts of one doc_id may be in two classes; repeated rows
get the same class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, held, hinted, release, slices, stored, table, words
from quillspark.llm.graphs import components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 12, 3
COUNTERS, POOL, BLOCK, BLOCK_BYTES = 1 << 20, 1 << 16, 512, 32_000_000
SAMPLES = BANDS * ROWS
AGREE = 18
#: A centre's documents are compared in as many parts.
PARTS = 32
#: Characters whose words are hashed at once, as that takes some forty bytes each.
TOGETHER = 500_000
_BYTE = np.random.default_rng(13).integers(0, 2**64 - 1, 256, dtype=np.uint64)
_ODD = (np.random.default_rng(11).integers(0, 2**63, 64 + SAMPLES + ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


_POWER = np.multiply.accumulate(np.array([1] + [0x9E3779B97F4A7C15] * 4095, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the lower-cased words of texts: a sum over a word's bytes of random values times powers of an odd number, mixed."""
    found: list[np.ndarray] = []
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > TOGETHER:
            found += _word_hashes(texts[begin:i])
            begin, size = i, 0
        size += len(t)
    return found + _word_hashes(texts[begin:]) if len(texts) > begin else found


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    begins, solid = words(joined)
    ends_of = np.cumsum([len(r) + 1 for r in raw]) + 1  # where each text is over
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    bytes_ = joined[solid]
    first = np.flatnonzero(begins[solid])
    place = np.arange(len(bytes_)) - np.repeat(first, np.diff(np.append(first, len(bytes_))))
    values = _BYTE[bytes_] * _POWER[place & (len(_POWER) - 1)]
    hashes = mix(np.add.reduceat(values, first))
    return np.split(hashes, np.searchsorted(starts, ends_of[:-1]))


class Shingler:
    """Weighted shingles of texts."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def words(self, texts: list[str]) -> list[np.ndarray]:
        return word_hashes(texts) if texts else []

    def weighted(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct shingles, and their weights."""
        if not len(words):
            return np.empty(0, np.uint64), np.empty(0)
        k = min(WORDS, len(words))
        n = len(words) - k + 1
        rarity = self.idf[(words & np.uint64(COUNTERS - 1)).astype(np.int64)]
        h, weight = np.zeros(n, np.uint64), np.zeros(n)
        for j in range(k):
            h += words[j : j + n] * _ODD[j]
            weight += rarity[j : j + n]
        distinct, first, counts = np.unique(mix(h), return_index=True, return_counts=True)
        return distinct, weight[first] / k * counts


def jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    (a, v), (b, w) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    if not len(a):
        return float(not len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    shared = np.minimum(v[same], w[at[same]]).sum()
    return float(shared / (v.sum() + w.sum() - shared))


class Shared:
    """Weighted sets, none of which is empty, that others are compared with all at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets = sets
        self.known, self.at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in sets])
        self.starts = np.concatenate([[0], np.cumsum([len(h) for h, _ in sets])[:-1]])
        self.totals = np.add.reduceat(self.weights, self.starts)
        self.dense = np.zeros(len(self.known))

    def reach(self, one: tuple[np.ndarray, np.ndarray], which: np.ndarray, similarity: float) -> np.ndarray:
        """Which of some sets, by their places, are as similar to ``one``; where sums in another order might tell otherwise, as jaccard() has it."""
        h, w = one
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        same = self.known[at] == h
        self.dense[at[same]] = w[same]
        shared = np.add.reduceat(np.minimum(self.dense[self.at], self.weights), self.starts)[which]
        self.dense[at[same]] = 0
        like = shared / (w.sum() + self.totals[which] - shared)
        good = like >= similarity
        for k in np.flatnonzero(np.abs(like - similarity) < 1e-9).tolist():
            good[k] = jaccard(one, self.sets[which[k]]) >= similarity
        return good


def runs(sizes: list[int], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts with ``most`` characters together; a longer one stands alone."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if len(sizes) > begin:
        yield begin, len(sizes)


class Sampler:
    """Consistent weighted samples; the random variates of a shingle come from pools of fixed size, each addressed by other bits of its hash."""

    def __init__(self):
        rng = np.random.default_rng(5)
        shape = (SAMPLES, POOL)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)

    def draw(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """SAMPLES hashes for each of the sets, none of which is empty."""
        h = np.concatenate([s for s, _ in sets])
        log_w = np.log(np.concatenate([w for _, w in sets])).astype(np.float32)
        lengths = np.array([len(s) for s, _ in sets])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(sets)), lengths)
        out = np.empty((len(sets), SAMPLES), np.uint64)
        for k in range(SAMPLES):
            at = ((h * _ODD[64 + k]) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[k].take(at), self.beta[k].take(at)
            t = np.floor(log_w / r + beta)
            a = self.log_c[k].take(at) - r * (t - beta + 1)
            least = np.flatnonzero(a == np.minimum.reduceat(a, starts).take(owner))
            first = least[np.searchsorted(least, starts)]
            out[:, k] = mix(h[first] + t[first].astype(np.int64).astype(np.uint64) * _ODD[k % 64])
        return out


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and how many hold a word of each of the COUNTERS classes of word hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(np.empty(0))
        total, counts = 0, np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, "text"):
            total += batch.num_rows
            for words in shingler.words(batch.column("text").to_pylist()):
                slots = np.unique((words & np.uint64(COUNTERS - 1)).astype(np.int64))
                counts[slots] += 1
        here = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(here, -1)), pa.array(np.append(counts[here], total))], ["slot", "n"])

    sums = docs.select("text").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # COUNTERS + 1 rows at most
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    counts = np.zeros(COUNTERS, np.int64)
    counts[slot[slot >= 0]] = n[slot >= 0]
    return int(n[slot < 0].sum()), counts


def rarities(total: int, counts: np.ndarray) -> np.ndarray:
    return (1 + np.log((1 + total) / (1 + np.minimum(counts, total))) / np.log(1 + max(1, total))).astype(np.float32)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, of partitions sorted by them."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and any(row[k] != run[0][k] for k in keys):
                yield run
                run = []
            run.append(row)
    if run:
        yield run
    release()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=-1)


def _sketches(column: pa.Array | list[bytes]) -> np.ndarray:
    found = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, SAMPLES)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h1 and h2 (two hashes of the text), class_id (the least doc_id of the class) and ``first`` (whether the row's text stands for the class) of every row."""
    spark = docs.sparkSession
    rows = documents(docs).where(F.col("doc_id").isNotNull())  # with small Arrow batches from here on
    rows = rows.select("doc_id", *text_hashes(F.col("text")), "text")
    total, counts = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(rarities(total, counts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(idf.value), held("sampler", Sampler)
        for batch in slices(batches, "text", rows=512, size=2_000_000):
            texts = batch.column("text").to_pylist()
            sets = [shingler.weighted(w) for w in shingler.words(texts)]
            full = [i for i, s in enumerate(sets) if len(s[0])]
            bands: list[np.ndarray | None] = [None] * len(sets)
            sketches: list[bytes | None] = [None] * len(sets)
            if full:
                drawn = sampler.draw([sets[i] for i in full])
                keys = mix((drawn.reshape(-1, BANDS, ROWS) * _ODD[64 + SAMPLES : 64 + SAMPLES + ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for n, i in enumerate(full):
                    bands[i], sketches[i] = keys[n], drawn[n].astype(np.uint8).tobytes()
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "h1", "h2", "size", "bands", "sketch"])

    signed = stored(rows.mapInArrow(sign, "doc_id long, h1 long, h2 long, size long, bands array<long>, sketch binary"), "signed")
    # One row, of the least doc_id, stands for equal texts. Its number is that doc_id; a hash where one doc_id stands for several texts.
    distinct = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
    distinct = stored(distinct, "distinct")
    several = stored(distinct.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("several")), "several")
    half = F.lit(1 << 62)
    number = F.when(F.col("several"), -F.xxhash64("h1", "h2").bitwiseAND(half - 1) - half).otherwise(F.col("doc"))
    nodes = distinct.withColumn("node", F.col("doc"))
    if not several.isEmpty():
        nodes = stored(distinct.join(hinted(several)(several), "doc", "left").withColumn("node", number).drop("several"), "nodes")
    sketches = nodes.where(F.col("sketch").isNotNull()).select("node", "sketch")

    def fetched(wanted: DataFrame, name: str) -> DataFrame:
        """node and text of the wanted nodes."""
        wanted = stored(wanted.distinct(), f"{name}-wanted")
        few = hinted(wanted)
        named = nodes.select("node", F.col("doc").alias("doc_id"), "h1", "h2").join(few(wanted), "node")
        found = rows.join(few(named), ["doc_id", "h1", "h2"]).select("node", "text")
        return stored(found.dropDuplicates(["node"]), name)

    hashed = nodes.where(F.col("bands").isNotNull()).select("node", "size", F.explode("bands").alias("bucket"))
    centres = hashed.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where(F.col("n") > 1).select((F.col("bucket") + 0).alias("bucket"), "centre")
    buckets = stored(hashed.join(centres, "bucket").select("bucket", "node", "size", "centre"), "buckets")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = _agreement(_sketches(batch.column("sketch")), _sketches(batch.column("other")))
                yield batch.select(["centre", "node"]).filter(pa.array(agree >= AGREE))

    pairs = stored(buckets.where(F.col("node") != F.col("centre")).select("centre", "node").distinct(), "pairs")
    few = hinted(pairs)
    middles = sketches.join(few(pairs.select(F.col("centre").alias("node"))), "node", "left_semi")
    spokes = sketches.join(few(pairs), "node").join(few(middles.select(F.col("node").alias("centre"), F.col("sketch").alias("other"))), "centre").select("centre", "node", "sketch", "other")
    spokes = stored(spokes.mapInArrow(alike, "centre long, node long"), "spokes").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    hubs = spokes.select("centre", "part").distinct().select("centre", F.col("centre").alias("node"), "part")
    texts = fetched(spokes.select("node").unionByName(spokes.select(F.col("centre").alias("node"))), "texts")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(idf.value)
        centre, held = None, None
        for batch in slices(batches, "text"):
            found = []
            sets = [shingler.weighted(w) for w in shingler.words(batch.column("text").to_pylist())]
            for a, b, s in zip(batch.column("centre").to_pylist(), batch.column("node").to_pylist(), sets, strict=True):
                if a == b:
                    centre, held = a, s
                elif a == centre and jaccard(held, s) >= similarity:
                    found.append((a, b))
            yield _pairs(found)

    star = few(hubs.unionByName(spokes.select("centre", "node", "part"))).join(texts, "node").repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("node") != F.col("centre"))
    links = stored(star.select("centre", "node", "text").mapInArrow(stars, "a long, b long"), "links")
    labels = components(links)

    # Buckets that still hold several components: members outside the largest against all.
    labelled = buckets.select("bucket", "node", "size").join(hinted(labels)(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("labels") > 1)
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    split = stored(split.select("bucket", F.col("top.label").alias("top"), parts(F.col("n"), F.col("size")).alias("blocks"), parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("rests")), "split")
    open_ = labelled.join(hinted(split)(split), "bucket")
    # Every member meets the blocks of its row; what is outside the largest component also those of its column.
    spot = lambda rest, block, turn: F.struct(F.lit(rest).alias("rest"), block.alias("block"), turn.alias("turn"))
    at = lambda n: F.pmod(F.xxhash64("node"), n)
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda turn: spot(False, at("blocks"), turn))
    rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda block: spot(True, block, at("rests")))
    spots = F.when(F.col("label") != F.col("top"), F.concat(every, rest)).otherwise(every)
    wanted = stored(open_.select("bucket", "node", "label", spots.alias("spots")), "open")

    def sides(group: list[dict]) -> tuple[list[dict], list[dict], np.ndarray, np.ndarray] | None:
        left, right = [r for r in group if r["rest"]], [r for r in group if not r["rest"]]
        return (left, right, _sketches([r["sketch"] for r in left]), _sketches([r["sketch"] for r in right])) if left and right else None

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, the rows that agree with one of another component on the other side."""
        for group in _grouped(batches, ["bucket", "block", "turn"]):
            if (both := sides(group)) is None:
                continue
            left, right, x, y = both
            label_y = np.array([r["label"] for r in right])
            hit_x, hit_y = np.zeros(len(left), bool), np.zeros(len(right), bool)
            for i, r in enumerate(left):
                agree = (_agreement(x[i], y) >= AGREE) & (label_y != r["label"])
                hit_x[i] = agree.any()
                hit_y |= agree
            kept = [r for side, hit in ((left, hit_x), (right, hit_y)) for r, h in zip(side, hit.tolist(), strict=True) if h]
            if kept:
                kinds = {"sketch": pa.binary(), "rest": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], kinds.get(k, pa.int64())) for k in kept[0]], [*kept[0]])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, the links that join two components."""
        shingler = Shingler(idf.value)
        for group in _grouped(batches, ["bucket", "block", "turn"]):
            if (both := sides(group)) is None:
                continue
            left, right, x, y = both
            root_y = np.array([r["label"] for r in right])
            joined: dict[int, int] = {}

            def root(label: int, joined: dict[int, int] = joined) -> int:
                while joined.get(label, label) != label:
                    label = joined[label]
                return label

            ours = [shingler.weighted(shingler.words([r["text"]])[0]) for r in left]
            found = []
            for begin, end in runs([len(r["text"]) for r in right]):
                theirs = Shared([shingler.weighted(shingler.words([r["text"]])[0]) for r in right[begin:end]])
                for i, r in enumerate(left):
                    agree = _agreement(x[i], y[begin:end])
                    near = np.flatnonzero((agree >= AGREE) & (root_y[begin:end] != root(r["label"])))
                    if not len(near):
                        continue
                    near = near[theirs.reach(ours[i], near, similarity)]
                    for j in near[np.argsort(-agree[near], kind="stable")].tolist():
                        a, b = root(r["label"]), int(root_y[begin + j])
                        if a != b:
                            joined[max(a, b)] = min(a, b)
                            root_y[root_y == max(a, b)] = min(a, b)
                            found.append((r["node"], right[begin + j]["node"]))
            if found:
                yield _pairs(found)

    keys = ["bucket", "block", "turn"]
    met = sketches.join(hinted(wanted)(wanted), "node").select("bucket", "node", "label", "sketch", F.explode("spots").alias("spot"))
    met = met.select("bucket", "spot.block", "spot.turn", "node", "label", "spot.rest", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    met = stored(met.mapInArrow(likely, "bucket long, block long, turn long, node long, label long, rest boolean, sketch binary"), "met")
    more = hinted(met)(met).join(fetched(met.select("node"), "more-texts"), "node").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(blocks, "a long, b long")
    more = more.select("a", "b").unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
    classes = components(more)
    # The least doc_id of a class, among its texts the one of least hashes.
    few = hinted(classes)
    linked = nodes.select("node", "doc", "h1", "h2").join(few(classes), "node")
    firsts = linked.groupBy("label").agg(F.min(F.struct("doc", "h1", "h2")).alias("top"))
    tops = stored(classes.join(few(firsts), "label").select("node", "top"), "tops")
    found = nodes.select("node", "doc", "h1", "h2").join(few(tops), "node", "left").withColumn("top", F.coalesce("top", F.struct("doc", "h1", "h2")))
    found = found.select("h1", "h2", F.col("top.doc").alias("class_id"), ((F.col("h1") == F.col("top.h1")) & (F.col("h2") == F.col("top.h2"))).alias("stands"))
    members = signed.select("doc_id", "h1", "h2").join(found.select((F.col("h1") + 0).alias("h1"), (F.col("h2") + 0).alias("h2"), "class_id", "stands"), ["h1", "h2"])
    return members.select("doc_id", "h1", "h2", "class_id", (F.col("stands") & (F.col("doc_id") == F.col("class_id"))).alias("first"))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that tell texts apart, a null as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
