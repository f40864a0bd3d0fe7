"""Byte-level BPE encoding and decoding on segment trees over adjacent pair ranks.

A word is a row of symbols. Leaf i of its segment tree holds the rank of the
pair (symbol i, next symbol) with i itself as the low digits, or infinity where
the pair doesn't merge; an inner node holds the smaller child. The root is then
the leftmost pair of lowest rank. Applying it changes three leaves - the merged
pair's, the swallowed symbol's and the left neighbour's - each a point update
along one path to the root. This goes on until the root is infinite.

Words up to ``LOCKSTEP`` bytes are advanced together, a numpy row each, one
merge per round; longer ones run alone on the same tree in plain Python, so a
word of n bytes costs O(n log n) in any case. Words recur, so each worker keeps
the results of those it has seen in bounded caches.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded each; strings of the added tokens become their ids, as in the
tokenizers library; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Recent, documents, held, slices, table

#: The split pattern of byte-level tokenizers; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to so many bytes are merged side by side.
LOCKSTEP = 64
#: Entries of each generation of a worker's caches.
CACHE = 400_000
INFINITE = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {v: k for k, v in letters.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = {int(k): r for r, k in reversed([*enumerate(keys)])}
        self.split = regex.compile(PATTERN)
        self.crossing = regex.compile(r"\s ")
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = Recent(CACHE)
        self.parts = Recent(CACHE)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, INFINITE where a pair doesn't merge or has a missing (negative) side."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], INFINITE)

    def _lockstep(self, words: list[bytes], width: int) -> list[bytes]:
        """Encode words of up to ``width`` (a power of two) bytes, all by one merge a round."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        symbols = self.byte_ids[raw]
        symbols[np.arange(width) >= length[:, None]] = -1
        beyond = np.full((n, 1), -1, dtype=np.int64)
        following = np.hstack([symbols[:, 1:], beyond])
        rank = self._rank(symbols.ravel(), following.ravel()).reshape(n, width)
        tree = np.full((n, 2 * width), INFINITE, dtype=np.int64)
        np.copyto(tree[:, width:], rank * width + np.arange(width), where=rank != INFINITE)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        # One slot more to either side takes the writes of neighbours that don't exist.
        symbol = np.full((n, width + 2), -1, dtype=np.int64)
        symbol[:, 1:-1] = symbols
        after = np.broadcast_to(np.minimum(np.arange(1, width + 3), width + 1), (n, width + 2)).copy()
        before = np.broadcast_to(np.maximum(np.arange(-1, width + 1), 0), (n, width + 2)).copy()
        symbol, after, before, tree = symbol.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows * (2 * width) + 1] != INFINITE]
            if not len(rows):
                break
            base, root = rows * (width + 2), rows * (2 * width)
            best = tree[root + 1]
            at = best % width + 1
            gone = after[base + at]
            right, left = after[base + gone], before[base + at]
            new = self.merged[best // width]
            symbol[base + at], symbol[base + gone] = new, -1
            after[base + at], before[base + right] = right, at
            pair_right, pair_left = self._rank(new, symbol[base + right]), self._rank(symbol[base + left], new)
            self._put(tree, root, width, gone, np.full(len(rows), INFINITE))
            self._put(tree, root, width, at, np.where(pair_right == INFINITE, INFINITE, pair_right * width + at - 1))
            inside = left > 0
            if inside.any():
                value = np.where(pair_left == INFINITE, INFINITE, pair_left * width + left - 1)
                self._put(tree, root[inside], width, left[inside], value[inside])
        grid = symbol.reshape(n, width + 2)[:, 1:-1]
        live = grid >= 0
        ids = grid[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, root: np.ndarray, width: int, slot: np.ndarray, value: np.ndarray) -> None:
        """Point updates of one leaf in each of the trees at ``root``; slots count from 1."""
        node = width + slot - 1
        tree[root + node] = value
        while width > 1:
            node >>= 1
            width >>= 1
            tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])

    def _alone(self, word: bytes) -> bytes:
        """Encode one word of any length on a segment tree of its own."""
        symbols = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, width = len(symbols), 1
        while width < n:
            width *= 2
        infinite, size, rank_of, merged = float("inf"), self.size, self.rank_of, self.merged.tolist()
        tree: list[float] = [infinite] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(symbols[i] * size + symbols[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(slot: int, value: float) -> None:
            node = width + slot
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                smaller = a if a < b else b
                if tree[node] == smaller:
                    return
                tree[node] = smaller
                node >>= 1

        while (best := tree[1]) != infinite:
            rank, at = divmod(int(best), width)
            gone = after[at]
            right, left = after[gone], before[at]
            symbols[at], symbols[gone], after[at] = merged[rank], -1, right
            put(gone, infinite)
            rank_right = None
            if right < n:
                before[right] = at
                rank_right = rank_of.get(symbols[at] * size + symbols[right])
            put(at, infinite if rank_right is None else rank_right * width + at)
            if left >= 0:
                rank_left = rank_of.get(symbols[left] * size + symbols[at])
                put(left, infinite if rank_left is None else rank_left * width + left)
        return np.array([s for s in symbols if s >= 0], dtype="<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > LOCKSTEP:
                found[i] = self._alone(word)
            elif word:
                by_width.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            for begin in range(0, len(members), 8192):
                some = members[begin : begin + 8192]
                for i, ids in zip(some, self._lockstep([words[j] for j in some], width), strict=True):
                    found[i] = ids
        return found

    def _learn(self, words: set[str]) -> None:
        new = self.words.settle(words)
        self.words.update(zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))

    def _segments(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens.

        Where no white space stands before a space, no word of the split
        pattern reaches over one: each space begins a word. Such texts are cut
        there and the pieces (and their words) looked up; other texts are
        split by the pattern as they are.
        """
        cut = [None if self.crossing.search(t) else t.split(" ") for t in texts]
        pieces = {p for c in cut if c is not None for p in c[1:]}
        unseen = self.parts.settle(pieces)
        split = [self.split.findall(" " + p) for p in unseen]
        heads = [self.split.findall(t if c is None else c[0]) for t, c in zip(texts, cut, strict=True)]
        self._learn({w for ws in split for w in ws} | {w for ws in heads for w in ws})
        look = self.words.__getitem__
        self.parts.update((p, b"".join(map(look, ws))) for p, ws in zip(unseen, split, strict=True))
        part = self.parts.__getitem__
        return [b"".join(map(look, head)) + (b"" if c is None else b"".join(map(part, c[1:]))) for head, c in zip(heads, cut, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if self.special is None or not any(x in t for t in texts for x in self.added):
            return self._segments(texts)
        flat: list[str] = []
        shape: list[list[bytes | int]] = []
        for text in texts:
            row: list[bytes | int] = []
            end = 0
            for m in self.special.finditer(text):
                row += [len(flat), self.added[m[0]].to_bytes(4, "little")]
                flat.append(text[end : m.start()])
                end = m.end()
            row.append(len(flat))
            flat.append(text[end:])
            shape.append(row)
        ids = self._segments(flat)
        return [b"".join(ids[x] if isinstance(x, int) else x for x in row) for row in shape]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, read once in each process."""
    return held(f"bpe {path}", lambda: ByteBPE(path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit integers) and
    decoded (string). One pass over the rows, without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, "text"):
            ids = bpe.encode(batch.column("text").to_pylist())
            decoded = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(work, "doc_id long, ids binary, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
