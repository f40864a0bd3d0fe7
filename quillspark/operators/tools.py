"""The engine's tools by name: one function each from a store and arguments to a DataFrame, and a dispatcher for requests as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import analytics, documents, graph, learning, quality, retrieval, upkeep
from quillspark.operators import assistant as A
from quillspark.operators import blocks as B
from quillspark.operators.providers import Chat, Embed, extractive_chat, hashing_embedder

#: Rows of a reply.
SHOWN = 50


@dataclass
class Store:
    """What tools work on."""

    blocks: DataFrame
    chunks: DataFrame
    events: DataFrame
    nodes: DataFrame
    edges: DataFrame
    contexts: DataFrame
    observations: DataFrame
    now: Column
    categories: list[str]
    everywhere: str = "_global"
    embed: Embed = hashing_embedder
    chat: Chat = extractive_chat
    extract: Chat = field(default=lambda category, text: "")

    def of(self, project: str | None) -> DataFrame:
        return self.blocks if project is None else self.blocks.where(F.col("project") == project)


def _tool(name: str) -> Callable[[Callable], Callable]:
    def put(f: Callable) -> Callable:
        TOOLS[name] = f
        return f

    return put


TOOLS: dict[str, Callable[..., DataFrame]] = {}


@_tool("index")
def index(s: Store, project: str | None = None) -> DataFrame:
    return B.index_view(s.of(project))


@_tool("recall")
def recall(s: Store, project: str) -> DataFrame:
    return A.recall(s.contexts.where(F.col("project") == project), s.of(project), s.now).orderBy("at")


@_tool("timeline")
def timeline(s: Store, session_id: str, project: str | None = None, width: int = 3) -> DataFrame:
    return B.timeline_window(s.of(project), session_id, s.now, width)


@_tool("search")
def search(s: Store, query: str, project: str | None = None) -> DataFrame:
    return B.keyword_match(s.of(project), query, 1, s.now).select("session_id", "category", "hits").orderBy(F.desc("hits"), "session_id")


@_tool("lookup")
def lookup(s: Store, query: str, project: str | None = None, everything: bool = False) -> DataFrame:
    return B.lookup(s.of(project), query, s.now, everything).select("session_id", "category", "matched")


@_tool("projects")
def projects(s: Store) -> DataFrame:
    return upkeep.project_overview(s.blocks, s.contexts)


@_tool("add")
def add(s: Store, project: str, category: str, content: str, label: str, ttl: str | None = None, ts_raw: str = "") -> DataFrame:
    new = s.blocks.sparkSession.createDataFrame([(project, category, label, content, ttl, ts_raw, 1 << 60)], "project string, category string, label string, content string, ttl string, ts_raw string, pos long")
    return upkeep.add(s.blocks, new, s.everywhere)


@_tool("analytics")
def usage(s: Store) -> DataFrame:
    return analytics.insights(s.events)


@_tool("search_semantic")
def search_semantic(s: Store, query: str, k: int = 8, threshold: float = 0.15) -> DataFrame:
    return retrieval.smart_search(s.chunks, [float(x) for x in s.embed([query])[0]], query, s.now, k, threshold)


@_tool("graph_query")
def graph_query(s: Store, concept: str, hops: int = 2) -> DataFrame:
    starts = s.nodes.where(F.lower("name") == concept.lower()).select("id")
    return graph.neighbours(s.edges, starts, hops).join(s.nodes.select("id", "name"), "id").select("id", "name", "depth")


@_tool("reflect")
def reflect(s: Store, project: str, text: str, day: str) -> DataFrame:
    given = s.blocks.sparkSession.createDataFrame([(project, text)], "project string, text string")
    return A.reflect(given, s.blocks, s.now, day, s.categories, s.extract)


@_tool("update")
def update(s: Store, category: str, session_id: str, content: str, ts_raw: str) -> DataFrame:
    return upkeep.replace_one(s.blocks, category, session_id, content, ts_raw)


@_tool("forget")
def forget(s: Store, topic: str | None = None, expired: bool = False) -> DataFrame:
    gone = B.topic_match(s.blocks, topic) if topic else B.with_expiry(s.blocks, s.now).where("expired") if expired else s.blocks.limit(0)
    return B.forget(s.blocks, gone)


@_tool("status")
def status(s: Store) -> DataFrame:
    return upkeep.worst_first(quality.project_quality(s.blocks, s.now))


@_tool("synthesize")
def synthesize(s: Store, project: str, lines: int | None = None) -> DataFrame:
    return documents.compact_memory(s.contexts.where(F.col("project") == project), s.contexts.select("project", F.lit("").alias("preferences")), lines, None, A.global_knowledge(s.blocks, s.everywhere, s.now))


@_tool("forget_stale")
def forget_stale(s: Store, days: int = 30) -> DataFrame:
    return B.forget(s.blocks, B.stale(s.blocks, s.now, days))


@_tool("observations")
def observations(s: Store, tool: str | None = None) -> DataFrame:
    return s.observations if tool is None else s.observations.where(F.col("tool") == tool)


@_tool("ask")
def ask(s: Store, question: str, k: int = 5, threshold: float = 0.15, use_graph: bool = False) -> DataFrame:
    return A.ask(s.chunks, s.blocks, question, s.now, s.chat, k=k, threshold=threshold, embed=s.embed, graph=(s.nodes, s.edges) if use_graph else None)


@_tool("ask_recursive")
def ask_recursive(s: Store, question: str) -> DataFrame:
    return A.recursive_context(s.blocks, s.chunks, question, s.now, lambda entries: s.chat("choose", entries), s.categories, embed=s.embed)


@_tool("ask_hybrid")
def ask_hybrid(s: Store, question: str, k: int = 10) -> DataFrame:
    vector = [float(x) for x in s.embed([question])[0]]
    picked = A.recursive_ask(s.blocks, s.now, lambda entries: s.chat("choose", entries), s.categories)
    return A.hybrid_ask(picked, retrieval.text_search(s.chunks, vector, question, k))


@_tool("learned")
def learned(s: Store) -> DataFrame:
    return learning.fold(learning.signals(s.events).withColumn("at", F.lit(0).cast("long")))


def dispatch(store: Store, name: str, arguments: dict | None = None) -> DataFrame:
    """A tool's result."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}")
    return TOOLS[name](store, **(arguments or {}))


def serve(store: Store, requests: Iterable[str], shown: int = SHOWN) -> Iterator[str]:
    """Replies to requests, a JSON-RPC object a line: the tools' names, or the first rows of a tool's result; an error where a request can't be read or a tool fails."""
    for line in requests:
        number = None
        try:
            request = json.loads(line)
            number, method, given = request.get("id"), request.get("method"), request.get("params") or {}
            if method == "tools/list":
                result: object = {"tools": sorted(TOOLS)}
            elif method == "tools/call":
                rows = dispatch(store, given.get("name", ""), given.get("arguments")).limit(shown)
                result = {"content": [json.loads(r) for r in rows.toJSON().collect()]}
            else:
                raise KeyError(f"no method {method!r}")
            yield json.dumps({"jsonrpc": "2.0", "id": number, "result": result})
        except Exception as error:
            yield json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32000, "message": f"{type(error).__name__}: {error}"[:300]}})
