"""An embedding index that is kept: vectors by the digest of their text, and deltas of which text an id has.

A store is a folder of parts that are only ever added: ``vectors/<part>`` holds
digests and vectors, ``deltas/<part>`` holds ids with a digest and the part
whose vectors have it, or null where the id was removed. A text is embedded
once, whatever number of ids has it and however often it comes back. Reading
takes each id's row of greatest (version, part). Every writer has parts of its
own, and a part counts once it is whole, so two writers at once lose no rows
and a failed one leaves nothing behind that is read. ``compact`` joins the
parts that are there; what it replaces is named in ``covers/<part>``. A vector
part without its delta part is what a failed writer leaves: its vectors are
right, and later writers may name them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.providers import Embed, embed, hashing_embedder
from quillspark.sources.stores import delete, exists

DELTA = "id long, digest string, home string, version long"
VECTOR = "digest string, vector array<double>"


class Embedded:
    """The index at ``path``: sync, put, remove, read, ids, history, compact."""

    def __init__(self, spark: SparkSession, path: str, provider: Embed = hashing_embedder):
        self.spark, self.path, self.provider = spark, path.rstrip("/"), provider

    def _named(self, kind: str) -> list[str]:
        """Whole parts of a kind; their number is that of updates since the last compaction."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(n for n in names if exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _covered(self) -> set[str]:
        names = self._named("covers")
        rows = self.spark.read.schema("part string").parquet(*(f"{self.path}/covers/{n}" for n in names)).toLocalIterator() if names else ()
        return {r["part"] for r in rows}

    def parts(self) -> list[str]:
        """Parts that a reader takes."""
        covers = self._covered()
        return [n for n in self._named("deltas") if n not in covers]

    def _rows(self, kind: str, schema: str, parts: list[str]) -> DataFrame:
        """Rows of some parts, each with its part's name."""
        one = lambda n: self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{n}").withColumn("part", F.lit(n))
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in f"{schema}, part string".split(", "))]
        return reduce(DataFrame.unionByName, map(one, parts)) if parts else self.spark.range(0).select(*none)

    def _listed(self, parts: list[str]) -> DataFrame:
        """Names of parts as rows (part)."""
        return self.spark.range(1).select(F.explode(F.array(*map(F.lit, parts)).cast("array<string>")).alias("part"))

    def _latest(self, parts: list[str]) -> DataFrame:
        """id, digest, home and version of each id's last row, removals among them."""
        last = F.max_by(F.struct("digest", "home", "version"), F.struct("version", "part"))
        return self._rows("deltas", DELTA, parts).groupBy("id").agg(last.alias("last")).select("id", "last.*")

    def ids(self) -> DataFrame:
        """id, digest and home of what the index holds."""
        return self._latest(self.parts()).where("digest IS NOT NULL").select("id", "digest", "home")

    def read(self) -> DataFrame:
        """id, digest and embedding. A digest is one row of its home, so no vectors are compared or grouped."""
        rows = self.ids()
        vectors = self._rows("vectors", VECTOR, self._named("vectors")).select("digest", F.col("part").alias("home"), F.col("vector").alias("embedding"))
        return rows.join(vectors, ["home", "digest"]).select("id", "digest", "embedding")

    def _next(self) -> int:
        parts = self.parts()
        top = self._rows("deltas", DELTA, parts).agg(F.max("version")).first()[0] if parts else None
        return (top or 0) + 1

    def _write(self, changed: DataFrame) -> str:
        """Add a part of rows (id, text, digest; digest null: removed), embedding texts that the index has no vector for."""
        part, version = uuid.uuid4().hex, self._next()
        # Written first: what changed is decided once, whatever is added meanwhile or computed again.
        beside = f"{self.path}/changed/{part}"
        try:
            changed.select("id", "text", "digest").write.parquet(beside)
            rows = self.spark.read.schema("id long, text string, digest string").parquet(beside)
            covers = self._covered()
            known = self._rows("vectors", VECTOR, [n for n in self._named("vectors") if n not in covers]).groupBy("digest").agg(F.min("part").alias("home"))
            new = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("text").alias("text")).join(known, "digest", "left_anti")
            new.select("digest", embed("text", self.provider).alias("vector")).write.parquet(f"{self.path}/vectors/{part}")
            placed = rows.join(known, "digest", "left").select("id", "digest", F.when(F.col("digest").isNotNull(), F.coalesce("home", F.lit(part))).alias("home"), F.lit(version).cast("long").alias("version"))
            placed.write.parquet(f"{self.path}/deltas/{part}")
        finally:
            delete(self.spark, beside)
        return part

    def put(self, texts: DataFrame) -> str:
        """Add or replace the texts (id, text) that differ from what their ids have; of a repeated id the text of greatest digest counts. A null text removes its id."""
        new = _digested(texts)
        old = self.ids().select("id", F.col("digest").alias("before"))
        rows = new.join(old, "id", "left").where(~F.col("digest").eqNullSafe(F.col("before")))
        return self._write(rows)

    def remove(self, ids: DataFrame) -> str:
        """Take ids out; those that aren't there are passed over."""
        gone = self.ids().join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_semi")
        return self._write(gone.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("digest")))

    def sync(self, texts: DataFrame) -> str:
        """Make the index hold these texts (id, text) and no others: changed and new ones are put, missing ones removed."""
        new = _digested(texts)
        old = self.ids().select("id", F.col("digest").alias("before"))
        return self._write(new.join(old, "id", "full").where(~F.col("digest").eqNullSafe(F.col("before"))))

    def history(self) -> DataFrame:
        """part, version (null where nothing had changed), put, removed and embedded of every part that is read."""
        parts = self.parts()
        rows = self._rows("deltas", DELTA, parts).groupBy("part").agg(F.max("version").alias("version"), F.count("digest").alias("put"), F.count_if(F.col("digest").isNull()).alias("removed"))
        made = self._rows("vectors", VECTOR, [n for n in self._named("vectors") if n in parts]).groupBy("part").agg(F.count("*").alias("embedded"))
        return self._listed(parts).join(rows, "part", "left").join(made, "part", "left").na.fill(0, ["put", "removed", "embedded"])

    def _cover(self, part: str, parts: list[str]) -> None:
        """From here on readers take ``part`` instead of ``parts``."""
        self._listed(parts).write.parquet(f"{self.path}/covers/{part}")

    def compact(self) -> str:
        """Join all parts into one without removed ids and unused vectors.

        What it replaces is deleted by the next compaction, so readers and
        writers that are under way keep their files. A part that is added
        meanwhile stays beside it; a vector that such a part takes from a
        replaced one isn't deleted before the part itself is joined.
        """
        part, parts, before = uuid.uuid4().hex, self.parts(), self._named("covers")
        replaced = self._covered()
        rows = self._latest(parts).where("digest IS NOT NULL")
        old = self._rows("vectors", VECTOR, self._named("vectors"))
        used = rows.select("home", "digest").distinct()
        of_home = old.select(F.col("part").alias("home"), "digest", "vector").join(used, ["home", "digest"])
        of_home.groupBy("digest").agg(F.min_by("vector", "home").alias("vector")).write.parquet(f"{self.path}/vectors/{part}")
        rows.select("id", "digest", F.lit(part).alias("home"), "version").write.parquet(f"{self.path}/deltas/{part}")
        self._cover(part, parts)
        homes = self._rows("deltas", DELTA, self.parts()).where("home IS NOT NULL").select("home").distinct()
        named = {r["home"] for r in homes.toLocalIterator()}  # parts, not rows
        for p in replaced - named:
            delete(self.spark, f"{self.path}/deltas/{p}")
            delete(self.spark, f"{self.path}/vectors/{p}")
        for p in before if not replaced & named else ():
            delete(self.spark, f"{self.path}/covers/{p}")
        return part


def _digested(texts: DataFrame) -> DataFrame:
    """id, text and digest, an id once: of several texts the one of greatest digest; rows without id are left out."""
    rows = texts.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("text"), F.sha2("text", 256).alias("digest"))
    return rows.groupBy("id").agg(F.max(F.struct("digest", "text")).alias("r")).select("id", "r.text", "r.digest")
