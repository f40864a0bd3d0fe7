"""Substring dedup by content-defined chunks of a gear rolling hash.

The gear hash of a position sums the table values of the last ``REACH`` bytes,
each shifted by its distance; it is computed for all positions at once by
doubling. A chunk begins at a word whose hash is less than that of the two
words before and the two behind it, so a boundary depends on the bytes near it
alone: text inserted or removed elsewhere moves no boundary, and chunks of
three words or more, five on average, come out alike wherever a passage stands.
In scripts without spaces, and in runs of more than 64 bytes without white
space, words are code points (``common.words``); there a boundary needs the
least hash of six on either side, so that a chunk says as much.

Chunks are told apart by a 64-bit digest. One that occurs in several documents
stays in the one with the least doc_id and is a repeat in the others. Runs of
adjacent repeats of ``RUN`` words or more are cut out (a code point as above
counts for half a word); a passage of 50 words holds such a run, since what its
ends share with their surroundings is about a chunk on either side. Shorter
repeats - a common line, a phrase - stay, and so do repeats within a document.
A false match would need several adjacent chunks to collide at once.

Digests are written once. Counts go through a pre-aggregated minimum and maximum
by digest; the repeats of a digest come from a plain join that splits a hot
digest. The text is moved once, to meet its row's repeats.

Defined results: a null text stays null; rows without doc_id stay as they are;
rows of one doc_id are one document, whose texts are each cut by their own
chunks, and none counts against the others; documents that are repeats as a
whole keep an empty text; other columns stay, one called ``removed`` too (the
spans are then in ``removed_1``); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import documents, fresh, numbered, slices, stored, table, words

REACH, SIDE, WIDE, RUN = 16, 2, 6, 25
GEAR = np.random.default_rng(17).integers(0, 2**64 - 1, 256, dtype=np.uint64)
_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash over the last REACH bytes at every position."""
    h, width = GEAR[raw], 1
    while width < REACH:
        further = h.copy()
        further[width:] += h[:-width] << np.uint64(width)
        h, width = further, 2 * width
    return h


def boundaries(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the chunks' begins and of the end, and each chunk's number of words."""
    begins, solid = words(raw)
    starts = np.flatnonzero(begins)
    lone = np.empty(0, bool)  # words that follow without white space, or are followed so: code points
    if len(starts) and (close := (starts > 0) & solid[starts - 1]).any():
        lone = close.copy()
        lone[:-1] |= close[1:]
    leading = int(len(starts) > 0 and starts[0] == 0)
    size = np.where(lone, 0.5, 1.0) if len(lone) else np.ones(len(starts))
    starts, lone = starts[leading:], lone[leading:]
    n = len(starts)
    padded = np.full(n + 2 * WIDE, np.iinfo(np.uint64).max)
    padded[WIDE : WIDE + n] = gear(raw)[starts - 1] if n else 0
    here = padded[WIDE : WIDE + n]
    least = np.ones(n, bool)
    for d in range(1, (WIDE if len(lone) else SIDE) + 1):
        less = (here < padded[WIDE - d : WIDE - d + n]) & (here < padded[WIDE + d : WIDE + d + n])
        least &= less if d <= SIDE else less | ~lone
    cut = np.flatnonzero(least)
    edges = np.concatenate([[0], starts[cut], [len(raw)]])
    counts = np.concatenate([[0.0], np.cumsum(size)])
    return edges, np.diff(counts[np.concatenate([[0], cut + leading, [len(size)]])])


def chunks(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's bytes, its chunk edges and their numbers of words."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw, *boundaries(np.frombuffer(raw, np.uint8))


def digests(text: str) -> list[int]:
    """Signed 64-bit digests of the chunks, white space at their ends left out."""
    raw, edges, _ = chunks(text)
    at = edges.tolist()
    found = np.array([xxhash.xxh3_64_intdigest(raw[a:b].strip()) for a, b in zip(at, at[1:], strict=False)], dtype=np.uint64)
    return found.view(np.int64)


def cut(text: str, repeats: list[int], least: int = RUN) -> tuple[str, list[tuple[int, int]]]:
    """The text without runs of ``least`` words or more of the given chunks, and what was cut, in code points."""
    raw, edges, words = chunks(text)
    flags = np.zeros(len(words) + 2, np.int8)
    flags[np.asarray(repeats, dtype=np.int64) + 1] = 1
    steps = np.diff(flags)
    kept, spans, end = [], [], 0
    for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
        if words[a:b].sum() >= least:
            kept.append(raw[end : edges[a]])
            end = int(edges[b])
            spans.append((int(edges[a]), end))
    kept.append(raw[end:])
    left = b"".join(kept).decode("utf-8", "surrogatepass")
    points = [(len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass"))) for a, b in spans]
    return left, points


def dedup(docs: DataFrame, least: int = RUN) -> DataFrame:
    """``docs`` with repeats cut out of text (and n_chars counted anew, where it exists), and ``removed``: the spans cut from each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [digests(t) for t in batch.column("text").to_pylist()]
            values = pa.array(np.concatenate(found) if found else [], pa.int64())
            ends = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "key", "digests"])

    rows = documents(docs).where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("key"), "text")
    split = stored(rows.mapInArrow(work, "doc_id long, key long, digests array<long>"), "chunks")
    # What repeats inside a document is no reason to cut.
    seen = split.select("doc_id", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = seen.where(F.col("first") != F.col("last")).select((F.col("digest") + 0).alias("digest"), "first")
    repeats = split.select("doc_id", "key", F.posexplode("digests").alias("chunk", "digest")).join(shared, "digest").where(F.col("doc_id") != F.col("first"))
    flagged = repeats.groupBy("doc_id", "key").agg(F.collect_set("chunk").alias("chunks"))

    # Rows meet their repeats by doc_id and text; rows without doc_id meet none, and are dealt out by their text.
    plain, text, length = numbered(docs)
    key, doc = F.xxhash64(f"c{text}"), F.col(f"c{[c.lower() for c in docs.columns].index('doc_id')}").cast("long")
    near = (F.coalesce(doc, key) == F.col("doc_id")) & (F.when(doc.isNotNull(), key) == F.col("key"))
    joined = plain.join(flagged, near, "left").select(*plain.columns, "chunks")
    schema = T.StructType([*plain.schema.fields, T.StructField("removed", _SPANS)])

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{text}"):
            *columns, flags = batch.columns
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            hit = np.flatnonzero(flags.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if hit:
                texts = columns[text].to_pylist()
                lengths = columns[length].to_pylist() if length is not None else []
                for i in hit:
                    left, found = cut(texts[i], flags[i].as_py(), least)
                    if found:
                        texts[i] = left
                        spans[i] = [{"begin": a, "end": b} for a, b in found]
                        if lengths:
                            lengths[i] = len(left)
                columns[text] = pa.array(texts, columns[text].type)
                if lengths:
                    columns[length] = pa.array(lengths, columns[length].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], schema.names)

    return joined.mapInArrow(strike, schema).toDF(*docs.columns, fresh("removed", docs.columns))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that an earlier document holds, and the spans cut."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return out.select("doc_id", "text", "n_chars", F.size("removed").cast("long").alias("n_removed"), "removed")
