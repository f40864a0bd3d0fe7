"""What several of the operators share: table access, shared storage, Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Collection, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Rows or text bytes that a Python worker handles at once; whole rows only.
SLICE_ROWS, SLICE_BYTES, BATCH_ROWS = 2_000, 8_000_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one set here on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "/tmp/checkpoints/quillspark"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return place


#: Rows of a stored table of a few columns that may go to every task.
FEW = 200_000


def hinted(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For joins with tables of as many rows as the stored ``df`` at most: where these are few by count they go to every task, and the other side isn't shuffled."""
    return F.broadcast if df.limit(FEW + 1).count() <= FEW else lambda side: side


#: Paths that stored() has written and nobody has deleted.
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The paths written so far and not deleted."""
    return [*_WRITTEN]


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that stored() has written, once nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _WRITTEN.remove(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or that with the first number behind it that no column has, upper case or lower."""
    known = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(known) + 2))) if n.lower() not in known)


def numbered(df: DataFrame) -> tuple[DataFrame, int, int | None]:
    """``df`` with its columns called c0, c1, ..., as names may hold any character, and the places of text and n_chars."""
    lower = [c.lower() for c in df.columns]
    return df.toDF(*(f"c{i}" for i in range(len(lower)))), lower.index("text"), lower.index("n_chars") if "n_chars" in lower else None


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_ROWS`` rows at most, if the session has Spark's own bound: buffers of the JVM and of workers are as large as a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def release() -> None:
    """Hand memory that a worker has freed back to the system; workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: dict[str, object] = {}


def held(name: str, build: Callable[[], T]) -> T:
    """What a worker keeps between tasks: one large object, so that those of past stages don't add up."""
    if name not in _HELD:
        _HELD.clear()
        release()
        _HELD[name] = build()
    return _HELD[name]


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of a documents table, a null text as the empty one; other columns are dropped whatever they are called."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], weigh: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``weigh`` column holds about ``size`` bytes at most; a longer row stands alone."""
    import pyarrow.compute as pc

    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(weigh)), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and (held + n > size or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if len(lengths) > begin:
            yield batch.slice(begin)
    release()


class Recent(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one, whose entries return as they are asked for."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def settle(self, keys: Collection) -> list:
        """Make room for ``keys`` and return those that aren't known; the others can be looked up until the next call."""
        missing = [k for k in keys if k not in self]
        if len(self) + len(missing) > self.limit:
            self.old = dict(self)
            self.clear()
            missing = [*keys]
        unseen = []
        for k in missing:
            if (v := self.old.get(k)) is None:
                unseen.append(k)
            else:
                self[k] = v
        return unseen


#: A run of more bytes than this without white space is read by code points.
LONGEST_WORD = 64
_KIND = np.ones(256, np.uint8)  # white space (ASCII), or the rest
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin, and which bytes are no white space.

    A word ends at white space. A code point of the scripts written without
    spaces (Thai, Lao, Burmese, Khmer, kana, Chinese characters) is a word of
    its own, as is every code point of a run of more than LONGEST_WORD bytes.
    """
    solid = _KIND[raw].astype(bool)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    if not len(raw):
        return begins, solid
    if raw.max() >= 0xE0:
        after = np.append(raw[1:], 0)
        dense = (raw >= 0xE3) & (raw <= 0xE9) | (raw == 0xF0) & (after >= 0xA0) | (raw == 0xEF) & (after >= 0xBC)
        dense |= (raw == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (raw == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after == 0x9E) | (after == 0x9F))
        if dense.any():
            inside = dense.copy()
            inside[1:] |= dense[:-1]
            inside[2:] |= dense[:-2]
            inside[3:] |= dense[:-3] & (raw[:-3] == 0xF0)
            begins |= dense
            begins[1:] |= solid[1:] & inside[:-1] & ~inside[1:]
    at = np.flatnonzero(begins)
    if len(at):
        gaps = np.diff(np.append(at, len(raw)))
        if gaps.max() > LONGEST_WORD:
            for i in np.flatnonzero(gaps > LONGEST_WORD).tolist():
                run = slice(at[i], at[i] + gaps[i])
                whole = solid[run]
                size = int(whole.argmin()) if not whole.all() else len(whole)
                if size > LONGEST_WORD:
                    run = slice(at[i], at[i] + size)
                    begins[run] = (raw[run] & 0xC0) != 0x80
    return begins, solid
