"""The transcript source: ranges, broken lines, file choice, and streams that go on after a restart."""

import json
import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from quillspark.sources.transcripts import Reader, _rows, register_transcripts

LINES = [
    json.dumps({"type": "user", "sessionId": "a", "message": {"role": "user", "content": "één"}}),
    "",
    '{"type": "us',
    json.dumps({"type": "assistant", "sessionId": "a", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "x" * 3000}, {"type": "thinking"}, {"type": "text", "text": "y"}], "usage": {"input_tokens": 3, "output_tokens": "4"}}}),
    json.dumps({"type": "other"}),
    "[1]",
    json.dumps({"type": "progress", "message": None, "path": "clash"}),
]


def write(root, project, name, text, at):
    (root / project).mkdir(parents=True, exist_ok=True)
    (root / project / name).write_bytes(text.encode())
    os.utime(root / project / name, (at, at))


@pytest.fixture
def root(tmp_path):
    write(tmp_path, "p1", "a.jsonl", "\n".join(LINES), 1_700_000_000)
    write(tmp_path, "p1", "empty.jsonl", "", 1_700_000_001)
    write(tmp_path, "p1", "notes.md", "no", 1_700_000_001)
    write(tmp_path, "p2", "b.jsonl", LINES[0] + "\r\n\n", 1_700_000_002)
    return tmp_path


@pytest.mark.parametrize("step", [1, 7, 64, 3000, 1 << 20])
def test_every_line_is_in_one_range(root, step):
    options = {"path": str(root), "rangeBytes": str(step)}
    reader = Reader(options)
    rows = [r for part in reader.partitions() for batch in _rows(part, options) for r in batch.to_pylist()]
    assert [(r["project"], r["pos"], r["bad"]) for r in rows] == [("p1", 0, False), *(("p1", sum(len(x.encode()) + 1 for x in LINES[:i]), i not in (3, 6)) for i in range(2, 7)), ("p2", 0, False)]
    assert rows[0]["text"] == "één" and rows[2]["text"] == "x" * 3000 + "\ny" and (rows[2]["input_tokens"], rows[2]["output_tokens"], rows[2]["model"]) == (3, None, "m")
    assert rows[5]["type"] == "progress" and rows[5]["text"] is None


def test_conditions_choose_files(root):
    from datetime import datetime, timezone

    def chosen(*filters):
        reader = Reader({"path": str(root)})
        left = list(reader.pushFilters(list(filters)))
        return [p.path.rsplit("/", 1)[1] for p in reader.partitions()], len(left)

    assert chosen(EqualTo(("project",), "p2")) == (["b.jsonl"], 0)
    assert chosen(In(("project",), ("p1", "p3"))) == (["a.jsonl"], 0)
    assert chosen(GreaterThanOrEqual(("modified",), datetime.fromtimestamp(1_700_000_001, timezone.utc))) == (["b.jsonl"], 1)
    assert chosen(EqualTo(("type",), "user")) == (["a.jsonl", "b.jsonl"], 1)


def test_pushed_conditions_and_empty_roots(spark, root):
    register_transcripts(spark)
    rows = spark.read.format("transcripts").load(str(root))
    assert rows.where("project = 'p2'").rdd.getNumPartitions() == 1
    assert rows.where("project = 'p2' AND modified >= timestamp'2023-01-01' AND type = 'user'").count() == 1
    assert rows.where("modified < timestamp'2023-01-01'").isEmpty()
    assert rows.where("bad").groupBy("project").count().collect()[0].asDict() == {"project": "p1", "count": 3}
    assert spark.read.format("transcripts").load(str(root / "none")).isEmpty()


def test_a_stream_goes_on_where_it_stopped(spark, root, tmp_path_factory):
    register_transcripts(spark)
    work = tmp_path_factory.mktemp("stream")

    def go_on():
        stream = spark.readStream.format("transcripts").option("rangeBytes", "500").load(str(root)).drop("id")
        query = stream.writeStream.format("parquet").option("path", str(work / "out")).option("checkpointLocation", str(work / "state")).start()
        query.processAllAvailable()
        query.stop()
        rows = spark.read.parquet(str(work / "out")).select("project", "path", "pos", "bad", "text").collect()
        return sorted((r["project"], r["path"].rsplit("/", 1)[1], r["pos"]) for r in rows)

    first = go_on()
    batch = spark.read.format("transcripts").load(str(root)).collect()
    assert first == sorted((r["project"], r["path"].rsplit("/", 1)[1], r["pos"]) for r in batch)
    assert go_on() == first
    write(root, "p3", "c.jsonl", LINES[0], 1_700_000_003)
    write(root, "p0", "d.jsonl", LINES[0] + "\n" + LINES[2], 1_700_000_003)
    assert go_on() == sorted([*first, ("p3", "c.jsonl", 0), ("p0", "d.jsonl", 0), ("p0", "d.jsonl", len(LINES[0].encode()) + 1)])
