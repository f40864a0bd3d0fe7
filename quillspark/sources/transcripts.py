"""Transcripts as a data source: ``spark.read.format("transcripts")`` and ``spark.readStream.format("transcripts")``.

A root holds a folder for each project, and that JSON lines in files, one a
session. A partition is a range of bytes of one file and owns the lines that
begin in it, so a long file is read by many tasks and a task holds one line at a
time. Entries are rows of ``SCHEMA``: ``pos`` is the byte at which a line begins,
and (path, pos) names it. Broken lines, lines that are no object and lines of an
unknown type are rows with ``bad`` set and no values, so that they can be counted;
blank lines are left out. Empty files and roots without files give no rows.

Options: path (a folder, or an address that Arrow's file systems know), pattern
(``*.jsonl``), rangeBytes (64 MB), settle (seconds a file must rest before a
stream reads it, 1). Conditions on project, path and modified choose files
before any is opened.

A stream's offset is the time and path of the last file read. A file that has
grown since comes again as a whole: rows keep their (path, pos), by which
``dropDuplicates`` or an upsert tells them. The newest file of a root must stay
there while streams read it: without it the offset would go back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatch
from io import BufferedReader

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "project string, path string, pos long, modified timestamp, session_id string, type string, timestamp string, role string, model string, text string, input_tokens long, output_tokens long, bad boolean"
#: Types of entries; fixed values of the format.
TYPES = ("user", "assistant", "file-history-snapshot", "progress")
RANGE = 64 << 20
ROWS = 2_000


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from one byte up to another."""

    project: str
    path: str
    modified: int
    begin: int
    end: int


def _opened(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _files(options) -> list[tuple[int, str, str, int]]:
    """(time in microseconds, path, project, size) of the files, in that order."""
    from pyarrow import fs

    system, root = _opened(options["path"])
    root = root.rstrip("/")
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path[len(root) :].strip("/").split("/")
        if info.type == fs.FileType.File and len(parts) == 2 and not parts[1].startswith(("_", ".")) and fnmatch(parts[1], options.get("pattern", "*.jsonl")):
            found.append((info.mtime_ns // 1000, info.path, parts[0], info.size))
    return sorted(found)


def _ranges(files, options) -> list[Range]:
    step = max(int(options.get("rangeBytes", RANGE)), 1)
    return [Range(project, path, at, begin, min(begin + step, size)) for at, path, project, size in files for begin in range(0, size, step)]


def _lines(part: Range, options) -> Iterator[tuple[int, bytes]]:
    """(pos, line) of a range; the line across its begin is the range's before."""
    system, _ = _opened(options["path"])
    with BufferedReader(system.open_input_file(part.path), 1 << 20) as file:
        file.seek(max(part.begin - 1, 0))
        if part.begin:
            file.readline()
        pos = file.tell()
        while pos < part.end and (line := file.readline()):
            yield pos, line.rstrip(b"\n")
            pos += len(line)


def _text(content) -> str | None:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(b["text"] for b in content if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
    return None


def _entry(line: bytes) -> tuple:
    """The values of a line from session_id to bad."""
    bad = (None,) * 8 + (True,)
    try:
        e = json.loads(line)
    except ValueError:
        return bad
    if not isinstance(e, dict) or e.get("type") not in TYPES:
        return bad
    m = e.get("message") if isinstance(e.get("message"), dict) else {}
    u = m.get("usage") if isinstance(m.get("usage"), dict) else {}
    word = lambda v: v if isinstance(v, str) else None
    whole = lambda v: v if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**63 else None
    return (word(e.get("sessionId")), e["type"], word(e.get("timestamp")), word(m.get("role")), word(m.get("model")), _text(m.get("content")), whole(u.get("input_tokens")), whole(u.get("output_tokens")), False)


def _rows(part: Range, options):
    """A range's rows as Arrow batches; Spark passes None where there is no range."""
    import pyarrow as pa

    if part is None:
        return

    instant = pa.timestamp("us", tz="UTC")
    kinds = {"string": pa.string(), "long": pa.int64(), "timestamp": instant, "boolean": pa.bool_()}
    names = [f.split() for f in SCHEMA.split(", ")]
    schema = pa.schema([(n, kinds[t]) for n, t in names])
    held = []
    clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([clean(r[i]) for r in held], kinds[t]) for i, (_, t) in enumerate(names)], schema=schema)
    size = 0
    for pos, line in _lines(part, options):
        if line.strip():
            held.append((part.project, part.path, pos, part.modified, *_entry(line)))
            size += len(line)
        if len(held) >= ROWS or size > 8 << 20:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


class Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.chosen = options, []

    def pushFilters(self, filters):
        for f in filters:
            value, name = getattr(f, "value", None), ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo) and name in ("project", "path"):
                self.chosen.append((name, "in", (value,)))
            elif isinstance(f, In) and name in ("project", "path"):
                self.chosen.append((name, "in", tuple(value)))
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and name == "modified" and isinstance(value, datetime) and value.tzinfo is not None:
                # Chooses files; Spark compares the rows again.
                self.chosen.append((name, "from", value.astimezone(timezone.utc)))
                yield f
            else:
                yield f

    def partitions(self):
        files = _files(self.options)
        for name, how, value in self.chosen:
            if how == "in":
                files = [f for f in files if (f[2] if name == "project" else f[1]) in value]
            else:
                files = [f for f in files if datetime.fromtimestamp(f[0] / 1e6, timezone.utc) >= value]
        return _ranges(files, self.options)

    def read(self, partition):
        return _rows(partition, self.options)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.last = options, {"modified": -1, "path": ""}

    def initialOffset(self):
        return {"modified": -1, "path": ""}

    def latestOffset(self):
        ripe = datetime.now(timezone.utc).timestamp() - float(self.options.get("settle", 1))
        files = [f for f in _files(self.options) if f[0] <= ripe * 1e6]
        if files:
            self.last = max(self.last, {"modified": files[-1][0], "path": files[-1][1]}, key=lambda o: (o["modified"], o["path"]))
        return self.last

    def partitions(self, start, end):
        low, high = (start["modified"], start["path"]), (end["modified"], end["path"])
        return _ranges([f for f in _files(self.options) if low < f[:2] <= high], self.options)

    def read(self, partition):
        return _rows(partition, self.options)


class Transcripts(DataSource):
    @classmethod
    def name(cls):
        return "transcripts"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def register_transcripts(spark: SparkSession) -> None:
    """Make the format known to a session, and let its readers take conditions (Spark refuses a reader that could otherwise; other sources aren't affected)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Transcripts)
