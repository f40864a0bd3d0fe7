"""Embedding and answering providers. The defaults are deterministic and need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 64
Embed = Callable[[list[str]], np.ndarray]
Chat = Callable[[str, str], str]


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed word counts in hashed slots; a text whose words cancel, or that has none, has its own slot. The empty text alone is zero."""
    from zlib import crc32

    out = np.zeros((len(texts), DIMS))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = crc32(word.encode())
            row[h % DIMS] += 1 if h >> 16 & 1 else -1
        if text and not row.any():
            row[crc32(text.encode()) % DIMS] = 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


#: Texts, and about how many of their bytes, that a provider is given at once; a longer text stands alone.
AT_ONCE, BYTES = 256, 1 << 20


def _some(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, some at once: what Python unpacks doesn't grow with the batch."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= AT_ONCE or held + n > BYTES):
            yield [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
            begin, held = i, 0
        held += n
    if lengths:
        yield [t or "" for t in texts.slice(begin).to_pylist()]


def embed(column: str, provider: Embed = hashing_embedder) -> Column:
    """Vectors of a text column; the provider is given some texts of a batch at once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors = [pa.array([*np.asarray(provider(texts), np.float64)], pa.list_(pa.float64())) for texts in _some(batch)]
            yield pa.concat_arrays(vectors) if vectors else pa.array([], pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(column)


def extractive_chat(system: str, user: str) -> str:
    """The default answerer: the first line of the context."""
    return next((line for line in user.split("\n") if line.strip()), "")


#: What a provider is told, by task; {0} is the text and {1} what stands beside it.
PROMPTS = {
    "decisions": "List the decisions taken in this conversation and why.\n\n{0}",
    "solutions": "List problems of this conversation that were solved, and how.\n\n{0}",
    "patterns": "List ways of working in this conversation that are worth repeating.\n\n{0}",
    "bugs": "List the defects that this conversation found, with their causes.\n\n{0}",
    "insights": "List what was learned in this conversation.\n\n{0}",
    "questions": "List the questions that this conversation leaves open.\n\n{0}",
    "procedures": "List the step-by-step procedures of this conversation.\n\n{0}",
    "preferences": "List what the user prefers, by topic.\n\n{0}",
    "entities": "List people, tools and places of this conversation as name | type | fact.\n\n{0}",
    "summary": "Summarise this conversation in a paragraph.\n\n{0}",
    "context": "Write the context document of a project from its knowledge.\n\n{0}",
    "hyde": "Write the short passage that would answer this question.\n\n{0}",
    "expand": "Give related search terms, separated by commas.\n\n{0}",
    "resolve": "Answer ADD, UPDATE <id>, DELETE <id> or NOOP for the new text beside the known ones.\n\n{0}\n\n{1}",
    "contradict": "Say CONTRADICTS and why if these two texts can't both hold.\n\n{0}\n\n{1}",
    "choose": "Name the ids of up to five entries that help with this question.\n\n{0}\n\n{1}",
    "answer": "Answer the question from the context alone.\n\n{0}\n\n{1}",
    "concise": "Answer the question from the context alone, in a few words.\n\n{0}\n\n{1}",
    "graph": "Give concepts and relationships of this knowledge as JSON.\n\n{0}",
}


def prompt(task: str, text: str, beside: str = "") -> str:
    """The prompt of a task."""
    return PROMPTS[task].format(text, beside)


def echo_chat(system: str, user: str) -> str:
    """A provider that gives back the last paragraph of what it is asked: a fixed reply for tests and offline use."""
    return user.rpartition("\n\n")[2]


def chat_column(column: str, task: str, chat: Chat = echo_chat) -> Column:
    """A provider's replies to a text column, by batches; null texts aren't asked about."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else chat(task, prompt(task, t)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(column)
