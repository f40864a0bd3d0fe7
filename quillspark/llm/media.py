"""Media columns: documents' bytes held as progressive JPEG files, and read back.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64,
are the coefficients of 8 x 8 blocks: byte b is the coefficient b - 256, stored
without quantisation and so without loss. Blocks fill Y, then Cb, then Cr of a
4:2:0 image nearly square; blocks beyond the payload are zero. A comment holds
the payload's length. Reading decodes the file's scans into coefficients, takes
the payload from them, and inverse-transforms them to the full-resolution RGB
tensor, whose size, sums and sums of squares are the features.

Files of a batch of rows are written and read together; rows are handled where
they are read, without a shuffle.

Defined results: a null or empty text is a payload of 64 zero bytes; equal
texts give equal files, features and tensors; repeated rows are stored each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jpeg
from quillspark.llm.common import documents, slices, table

UNIT, LEVEL = 64, 256
#: Bytes of text that a worker stores at once; a longer text stands alone.
AT_ONCE = 2_000_000


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of MCUs, six blocks each, for so many blocks."""
    mcus = -(-blocks // 6)
    wide = int(np.ceil(np.sqrt(mcus)))
    return -(-mcus // wide), wide


def write(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload."""
    grids = [grid(len(p) // UNIT) for p in payloads]
    sizes = [6 * r * c for r, c in grids]
    blocks = np.zeros((sum(sizes), UNIT), np.int32)
    at = 0
    for p, n in zip(payloads, sizes, strict=True):
        blocks[at : at + len(p) // UNIT] = np.frombuffer(p, np.uint8).reshape(-1, UNIT).astype(np.int32) - LEVEL
        at += n
    return jpeg.encode(grids, blocks, [b"payload %d" % len(p) for p in payloads])


def read(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The payload and the RGB tensor of each file."""
    images, blocks, base = jpeg.coefficients(files)
    found = []
    for i, image in enumerate(images):
        length = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
        found.append((blocks[base[i] : base[i] + length // UNIT] + LEVEL).astype(np.uint8).tobytes())
    return found, jpeg.tensors(images, blocks, base)


def feature(rgb: np.ndarray) -> str:
    """Size, sums and sums of squares by channel."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    sums, squares = flat.sum(axis=0).tolist(), (flat * flat).sum(axis=0).tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]};{','.join(map(str, sums))};{','.join(map(str, squares))}"


def store(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, media (the file), payload (read back from it), feature, and with ``tensors`` height, width and rgb (8-bit samples, row by row)."""
    more = ", height int, width int, rgb binary" if tensors else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", size=AT_ONCE):
            texts = batch.column("text").to_pylist()
            files = write([payload(t) for t in texts])
            payloads, rgb = read(files)
            columns = [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(files, pa.binary()), pa.array(payloads, pa.binary()), pa.array([feature(x) for x in rgb], pa.string())]
            names = ["doc_id", "n_bytes", "media", "payload", "feature"]
            if tensors:
                columns += [pa.array([x.shape[0] for x in rgb], pa.int32()), pa.array([x.shape[1] for x in rgb], pa.int32()), pa.array([x.tobytes() for x in rgb], pa.binary())]
                names += ["height", "width", "rgb"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents(docs).mapInArrow(work, "doc_id long, n_bytes long, media binary, payload binary, feature string" + more)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's stored file and of the payload read back from it."""
    return store(table(spark, sf_dir, "documents"), tensors=False).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
