"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each partition keeps open windows by fill level, with N[h] windows at level h
in a level array. A document of s ids goes to the level h (0: a new window)
for which the sum of N[h]^2 over the partially filled levels grows least, ties
to the fuller window; that is one vectorised look at the array. Documents of a
window or more first give off whole windows; only the rest is placed.

When ``max_open`` windows are open, and at a partition's end, the open windows'
pieces are placed anew, largest first, by the same rule; windows that lack
``SPARE`` ids at most are closed then. Only what still is in partial windows at
the end (or, of half of ``max_open`` partial windows, what is left where hardly
any two pieces fit together) is laid end to end, cut at window ends, and the
last partial window is cut into runs whose lengths are powers of two, which
need no padding. So what padding there is, half a per cent of the ids, hardly
depends on how rows fall into partitions.

Rows are packed where they are read: one pass, no shuffle. Window numbers are
the partition's number times 2^33 plus a count, so that a repeated task yields
the same ones.

Defined results: a null or empty text is the separator alone; repeated rows are
packed each; columns other than doc_id and text are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Recent, documents, held, slices, table

WINDOW, SEPARATOR, MAX_OPEN, SPARE = 4096, 2, 1024, 128
#: Bytes of text whose chunks are looked up together.
AT_ONCE = 8_000_000
#: Entries of each generation of a worker's cache of ids by chunk.
CACHE = 500_000
#: ASCII marks that can follow a word without being part of it (the apostrophe can).
MARKS = ".,;:!?*#%$&|()[]{}-_/+=\"<>@^~`\\"
#: Words that the library encodes in one text.
TOGETHER = 256
#: Whatever isn't a character up to the Latin letters that lower-case one by one and alike everywhere (all but the dotted capital I).
BEYOND_LATIN = re.compile("[^\0-\u012f\u0131-\u024f]")
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class ChunkTokenizer:
    """Ids by the tokenizers library, looked up by chunk where the vocabulary allows.

    A tokenizer that drops white space and never joins over it gives the same
    ids for a text as for its chunks between spaces and line feeds, one after
    another; chunks recur, so their ids are kept. If it lower-cases too, texts
    of Latin letters are lower-cased first, and a chunk of letters and marks
    behind them has the ids of either. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.apart = self._drops_space(spec)
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower = any(s.get("type") == "Lowercase" for s in steps) and all(x == x.lower() for x in specials)
        self.known = Recent(cache)

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """Whether the pre-tokenizer keeps only matches of a pattern that no white space is part of."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        split = next((s for s in steps if s.get("type") == "Split"), {})
        pattern = (split.get("pattern") or {}).get("Regex", "")
        plain = all(part in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") or part.startswith("'") for part in pattern.split("|"))
        spaced = any(" " in t["content"] or "\n" in t["content"] for t in spec.get("added_tokens", []))
        return bool(split.get("behavior") == "Removed" and split.get("invert") and plain and not spaced)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False))]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters: ``TOGETHER`` in one text, told apart by the number of the word that each id is from."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        found: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            raw, word = np.array(e.ids, dtype="<u4").tobytes(), np.array(e.word_ids)
            ends = [0, *(4 * (np.flatnonzero(word[1:] != word[:-1]) + 1)).tolist(), len(raw)]
            found += [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)] if len(ends) == len(group) + 1 else self._library(group)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.apart:
            return self._library(texts)
        if self.lower:
            texts = [t if BEYOND_LATIN.search(t) else t.lower() for t in texts]
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        words: set[str] = set()  # of Latin letters
        others: set[str] = set()
        pairs: list[tuple[str, str, str]] = []  # chunk, word, marks
        for chunk in known.settle(set().union(*cut)):
            stem = chunk.rstrip(MARKS)
            plain = stem.isalpha() and not BEYOND_LATIN.search(stem)
            if len(stem) == len(chunk) or not plain:
                (words if plain and len(stem) == len(chunk) else others).add(chunk)
                continue
            marks = chunk[len(stem) :]
            pairs.append((chunk, stem, marks))
            for part, unknown in ((stem, words), (marks, others)):
                if part not in known:
                    if (ids := known.old.get(part)) is None:
                        unknown.add(part)
                    else:
                        known[part] = ids
        for new, encode in (([*words], self._words), ([*others], self._library)):
            known.update(zip(new, encode(new), strict=True))
        for chunk, stem, marks in pairs:
            known[chunk] = known[stem] + known[marks]
        return [b"".join(map(known.__getitem__, c)) for c in cut]


Piece = tuple[int, int, bytes, int]  # document, start, packed ids, ids of the whole document


class SumOfSquares:
    """Open windows of one partition. ``closed`` receives (piece, window number, offset)."""

    def __init__(self, window: int, max_open: int, first: int, spare: int = SPARE):
        self.window, self.max_open, self.next, self.spare = window, max_open, first, spare
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.at: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(window)]
        self.open = 0
        self.closed: list[tuple[Piece, int, int]] = []
        self.cut = 0  # ids in windows that were filled by cutting

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, number: int, pieces: list[Piece]) -> None:
        offset = 0
        for piece in pieces:
            self.closed.append((piece, number, offset))
            offset += len(piece[2]) // 4

    def add(self, doc: int, ids: bytes) -> None:
        total, begin, step = len(ids) // 4, 0, self.window
        while total - begin >= step:
            self._close(self._number(), [(doc, begin, ids[4 * begin : 4 * (begin + step)], total)])
            begin += step
        if begin < total:
            self._place((doc, begin, ids[4 * begin :], total))
            if self.open > self.max_open:
                self._settle()
                if 2 * self.open > self.max_open:
                    self._join()

    def choose(self, size: int) -> int:
        """The level whose window takes ``size`` ids at the least growth of the sum of squares; 0 for a new window."""
        level, full = self.level, self.window - size
        growth = 2 * (level[size + 1 :] - level[1 : full + 1]) + 2
        growth[full - 1] = 1 - 2 * level[full]  # a full window counts no more
        growth[level[1 : full + 1] == 0] = np.iinfo(np.int64).max
        best = full - int(np.argmin(growth[::-1]))
        return best if growth[best - 1] <= 2 * level[size] + 1 else 0

    def _place(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        best = self.choose(size) if self.open else 0
        if best:
            number, pieces = self.at[best].pop()
            self.level[best] -= 1
            self.open -= 1
        else:
            number, pieces = self._number(), []
        pieces.append(piece)
        if best + size == self.window:
            self._close(number, pieces)
            return
        self._keep(best + size, number, pieces)

    def _keep(self, level: int, number: int, pieces: list[Piece]) -> None:
        self.at[level].append((number, pieces))
        self.level[level] += 1
        self.open += 1

    def _taken(self) -> list[tuple[int, list[Piece]]]:
        """The open windows, fullest first; none is open any more."""
        held = [w for windows in reversed(self.at) for w in windows]
        for windows in self.at:
            windows.clear()
        self.level[:] = 0
        self.open = 0
        return held

    def _settle(self) -> None:
        """Place the open windows' pieces anew, largest first, and close the windows that are nearly full."""
        for piece in sorted((p for _, held in self._taken() for p in held), key=lambda p: -len(p[2])):
            self._place(piece)
        for fill in range(self.window - self.spare, self.window):
            for number, pieces in self.at[fill]:
                self._close(number, pieces)
            self.open -= len(self.at[fill])
            self.at[fill].clear()
            self.level[fill] = 0

    def _join(self) -> None:
        """Lay the open windows' pieces end to end, close what is full and keep the rest as one open window."""
        held = self._taken()
        numbers = iter([n for n, _ in held])
        run: list[Piece] = []
        fill = 0
        for doc, start, ids, total in (p for _, pieces in held for p in pieces):
            while ids:
                taken = ids[: 4 * (self.window - fill)]
                run.append((doc, start, taken, total))
                fill += len(taken) // 4
                start += len(taken) // 4
                ids = ids[len(taken) :]
                if fill == self.window:
                    self._close(next(numbers), run)
                    self.cut += fill
                    run, fill = [], 0
        if run:
            self._keep(fill, next(numbers), run)

    def finish(self) -> None:
        """Close all; the last partial window becomes windows of lengths that are powers of two."""
        self._settle()
        self._join()
        rest = [p for _, held in self._taken() for p in held]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            run: list[Piece] = []
            need = size
            while need:
                doc, start, ids, total = rest[0]
                taken = ids[: 4 * need]
                run.append((doc, start, taken, total))
                need -= len(taken) // 4
                if len(taken) == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + len(taken) // 4, ids[len(taken) :], total)
            self._close(self._number(), run)
            self.cut += size
            left -= size


def tokenizer(path: str, cache: int = CACHE) -> ChunkTokenizer:
    return held(f"tokenizer {path} {cache}", lambda: ChunkTokenizer(path, cache))


def pack(docs: DataFrame, path: str, window: int = WINDOW, separator: int = SEPARATOR, max_open: int = MAX_OPEN, cache: int = CACHE) -> DataFrame:
    """Tokenise and pack ``docs``; returns pieces with their ids (binary: little-endian unsigned 32-bit integers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path, cache)
        context = TaskContext.get()
        packer = SumOfSquares(window, max_open, (context.partitionId() if context else 0) << 33)
        end = np.array([separator], dtype="<u4").tobytes()

        def out() -> Iterator[pa.RecordBatch]:
            closed, packer.closed = packer.closed, []
            for begin in range(0, len(closed), 4096):
                some = closed[begin : begin + 4096]
                columns = [[p[0] for p, _, _ in some], [p[1] for p, _, _ in some], [len(p[2]) // 4 for p, _, _ in some], [p[3] for p, _, _ in some], [n for _, n, _ in some], [o for _, _, o in some]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([p[2] for p, _, _ in some], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        ids_of: list[int | None] = []
        texts: list[str] = []

        def place() -> None:
            for doc, ids in zip(ids_of, encoder.encode(texts), strict=True):
                packer.add(doc, ids + end)
            ids_of.clear()
            texts.clear()

        size = 0
        for batch in slices(batches, "text"):
            ids_of += batch.column("doc_id").to_pylist()
            texts += batch.column("text").to_pylist()
            size += batch.column("text").nbytes
            if size >= AT_ONCE:
                place()
                size = 0
                yield from out()
        place()
        packer.finish()
        yield from out()

    return documents(docs).mapInArrow(work, SCHEMA)


def pieces(docs: DataFrame, cache: int = CACHE) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids, packed with the production parameters."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=cache).select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 4096 ids."""
    return pieces(table(spark, sf_dir, "documents"))
