"""Queries of versioning, inboxes and packs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import history as H
from quillspark.operators import versioning as V
from quillspark.operators.trees import Snapshots
from quillspark.plans.catalog import register
from quillspark.sources.stores import delete, kept, scratch
from quillspark.sources.views import CATEGORIES, blocks, commits, oracle, packs, table, usage_events

_A = "a AS (SELECT * FROM blocks WHERE pos % 10 < 7)"
_B = "b AS (SELECT session_id, category, CASE WHEN pos % 11 = 0 THEN upper(content) ELSE content END AS content FROM blocks WHERE pos % 10 > 2)"


def _snaps(spark, d):
    x = blocks(spark, d)
    return x.where("pos % 10 < 7"), x.where("pos % 10 > 2").withColumn("content", F.when(F.col("pos") % 11 == 0, F.upper("content")).otherwise(F.col("content"))), x.where("pos % 13 = 0")


@register("vcs_status", oracle(f"WITH {_A}, {_B}, s AS (SELECT session_id FROM blocks WHERE pos % 13 = 0) SELECT session_id, 'new' AS state FROM b WHERE session_id NOT IN (SELECT session_id FROM a) UNION ALL SELECT session_id, 'removed' FROM a WHERE session_id NOT IN (SELECT session_id FROM b) UNION ALL SELECT session_id, 'staged' FROM b WHERE session_id IN (SELECT session_id FROM s)"))
def vcs_status(spark, d):
    a, b, s = _snaps(spark, d)
    return V.status(b, a, s)


@register("vcs_content_hash", oracle("SELECT session_id, substr(sha256(string_agg(category || ':' || content, chr(10) ORDER BY cat_ord)), 1, 16) AS hash FROM blocks GROUP BY 1"))
def vcs_content_hash(spark, d):
    return V.content_hashes(blocks(spark, d))


_HASHES = "h AS (SELECT session_id, substr(sha256(string_agg(category || ':' || content, chr(10) ORDER BY cat_ord)), 1, 16) AS hash FROM blocks GROUP BY 1)"


@register("vcs_commit_hash", oracle(f"WITH {_HASHES}, p AS (SELECT substr(sha256(session_id), 1, 4) AS place, sha256(string_agg(session_id || ':' || hash, chr(10) ORDER BY session_id || ':' || hash)) AS digest FROM h GROUP BY 1), m AS (SELECT substr(place, 1, 2) AS part, sha256(string_agg(digest, chr(10) ORDER BY place)) AS digest FROM p GROUP BY 1) SELECT substr(sha256(string_agg(digest, chr(10) ORDER BY part)), 1, 8) AS commit_id FROM m"))
def vcs_commit_hash(spark, d):
    return V.commit_id(V.content_hashes(blocks(spark, d)))


@register("vcs_listed_hash", oracle(f"WITH {_HASHES} SELECT substr(sha256(string_agg(session_id || ':' || hash, chr(10) ORDER BY session_id || ':' || hash)), 1, 8) AS commit_id FROM h"))
def vcs_listed_hash(spark, d):
    """The id over one list of all lines."""
    return spark.createDataFrame([(V.listed_commit_id(V.content_hashes(blocks(spark, d))),)], "commit_id string")


@register("diff_merged", oracle("SELECT pos AS id, 0 AS seq, 'modified' AS kind, content AS old, content || '!' AS new FROM blocks UNION ALL SELECT pos, 2, 'added', NULL, 'more' FROM blocks UNION ALL SELECT pos, 3, 'removed', 'gone', NULL FROM blocks WHERE pos % 2 = 0"))
def diff_merged(spark, d):
    """Deletions and insertions of a diff, adjacent ones merged."""
    change = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    changes = F.array(change(0, "removed", F.col("content")), change(1, "added", F.concat("content", F.lit("!"))), change(2, "added", F.lit("more")), change(3, "removed", F.lit("gone")))
    rows = blocks(spark, d).select(F.col("pos").alias("id"), F.explode(changes).alias("c")).select("id", "c.*").where("seq < 3 OR id % 2 = 0")
    return V.merged_changes(rows)


@register("diff_function", oracle("SELECT pos AS id, CAST(len(string_split(content, chr(10))) + 1 AS INT) AS line_num, 'added' AS diff_type, 'end' AS new FROM blocks"))
def diff_function(spark, d):
    """The line diff as SQL's table function."""
    V.register_diff(spark)
    return spark.sql("SELECT b.pos AS id, t.line_num, t.diff_type, t.new FROM {b} b, LATERAL line_diff(b.content, concat(b.content, '\nend')) t", b=blocks(spark, d).select("pos", "content"))


_WALK = "w AS (SELECT * FROM (SELECT id, parent, 0 AS depth FROM commits ORDER BY seq DESC LIMIT 1) UNION ALL SELECT c.id, c.parent, depth + 1 FROM w JOIN commits c ON c.id = w.parent)"


def _newest(commits):
    return commits.orderBy(F.desc("seq")).first()["id"]


@register("vcs_log", oracle(f"WITH RECURSIVE {_WALK} SELECT id, CAST(depth AS INT) AS depth, message FROM w JOIN commits USING (id) WHERE contains(lower(message), 'fix')"))
def vcs_log(spark, d):
    """The whole history of the newest commit, as far as its messages name a fix."""
    c = commits(spark, d)
    return H.Ancestry(c, "seq").log(c, _newest(c), None, "fix").select("id", "depth", "message")


@register("vcs_log_limited", oracle(f"WITH RECURSIVE {_WALK} SELECT id, CAST(depth AS INT) AS depth, message FROM w JOIN commits USING (id) WHERE contains(lower(message), 'urgent') ORDER BY depth LIMIT 25"))
def vcs_log_limited(spark, d):
    c = commits(spark, d)
    return H.Ancestry(c, "seq").log(c, _newest(c), 25, "urgent").select("id", "depth", "message")


@register("vcs_depths", oracle("WITH RECURSIVE w AS (SELECT id, id AS root, 0 AS depth FROM commits WHERE parent IS NULL UNION ALL SELECT c.id, root, depth + 1 FROM w JOIN commits c ON c.parent = w.id) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM w"))
def vcs_depths(spark, d):
    """Every commit's root and its distance to it."""
    return H.Ancestry(commits(spark, d), "seq").depths()


@register("vcs_merge_bases", oracle("""WITH RECURSIVE n AS (SELECT seq, CAST(substr(parent, 2) AS BIGINT) AS up, CAST(left(message, 3) = 'Fix' AS BIGINT) AS f FROM commits),
  p AS (SELECT seq AS a, seq - 5 - f AS b FROM n WHERE seq >= 6),
  w AS (SELECT a, b, a AS x, b AS y FROM p UNION ALL SELECT a, b, CASE WHEN x > y THEN n.up ELSE x END, CASE WHEN x > y THEN y ELSE n.up END FROM w JOIN n ON n.seq = greatest(x, y) WHERE x <> y AND x IS NOT NULL AND y IS NOT NULL)
  SELECT 'c' || a AS a, 'c' || b AS b, max(CASE WHEN x = y THEN 'c' || x END) AS base FROM w GROUP BY a, b"""))
def vcs_merge_bases(spark, d):
    """Of every commit and one five or six before it the nearest common ancestor."""
    c = commits(spark, d)
    fix = F.startswith("message", F.lit("Fix")).cast("long")
    pairs = c.where("seq >= 6").select(F.col("id").alias("a"), F.concat(F.lit("c"), (F.col("seq") - 5 - fix).cast("string")).alias("b"))
    return H.Ancestry(c, "seq").merge_bases(pairs)


@register("vcs_checkout_plan", oracle(f"WITH {_A}, {_B}, k AS (SELECT session_id FROM blocks WHERE pos % 2 = 0) SELECT session_id, 'snapshot' AS origin FROM a UNION ALL SELECT session_id, 'uncommitted' FROM b WHERE session_id NOT IN (SELECT session_id FROM k) AND (category, session_id) NOT IN (SELECT category, session_id FROM a)"))
def vcs_checkout_plan(spark, d):
    a, b, _ = _snaps(spark, d)
    return V.checkout(b, a, blocks(spark, d).where("pos % 2 = 0")).select("session_id", "origin")


@register("vcs_conflicts", oracle(f"WITH {_A}, {_B} SELECT b.category, b.session_id FROM b JOIN a USING (category, session_id) WHERE a.content <> b.content"))
def vcs_conflicts(spark, d):
    a, b, _ = _snaps(spark, d)
    return V.conflicts(b, a)


@register("block_diff", oracle(f"WITH {_A}, {_B} SELECT category, session_id, kind FROM (SELECT COALESCE(a.category, b.category) AS category, COALESCE(a.session_id, b.session_id) AS session_id, CASE WHEN a.session_id IS NULL THEN 'added' WHEN b.session_id IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'changed' END AS kind FROM a FULL JOIN b ON a.category = b.category AND a.session_id = b.session_id) WHERE kind IS NOT NULL"))
def block_diff(spark, d):
    a, b, _ = _snaps(spark, d)
    return V.block_diff(a, b)


_DOCS = "SELECT pos AS id, content AS old, replace(content, 'the', 'THE') || chr(10) || 'end' AS new FROM blocks"


def _edited(b):
    return b.select(F.col("pos").alias("id"), F.col("content").alias("old"), F.concat(F.replace(F.col("content"), F.lit("the"), F.lit("THE")), F.lit("\nend")).alias("new"))


@register("line_set_diff", oracle(f"SELECT id, len(list_filter(list_distinct(string_split(new, chr(10))), lambda v: NOT list_contains(string_split(old, chr(10)), v))) AS added, len(list_filter(list_distinct(string_split(old, chr(10))), lambda v: NOT list_contains(string_split(new, chr(10)), v))) AS removed FROM ({_DOCS})"))
def line_set_diff(spark, d):
    return _edited(blocks(spark, d)).select("id", V.line_sets(F.col("old"), F.col("new")).alias("n")).select("id", F.col("n.added").cast("long").alias("added"), F.col("n.removed").cast("long").alias("removed"))


@register("line_diff")
def line_diff(spark, d):
    """Every document, read without its label: a diff needs no join."""
    return V.line_diff(_edited(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("content"))))


@register("line_diff_counts", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT doc_id AS id, 1 AS added, 0 AS removed, count(*) FILTER (WHERE contains(line, 'the')) AS modified FROM l GROUP BY 1""")
def line_diff_counts(spark, d):
    """How many lines a shortest script changes: those that the edit touched, and the line behind the last."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("content"))
    return V.diff_counts(V.line_diff(_edited(rows), texts=False))


_VERSIONS = "v AS (SELECT 'v' || event_id AS version_id, COALESCE(category, 'none') AS category, ts, event_id FROM usage_events WHERE event_type = 'Ingest')"


def _versions(spark, d):
    return usage_events(spark, d).where("event_type = 'Ingest'").select(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version_id"), F.coalesce("category", F.lit("none")).alias("category"), "ts")


@register("version_cleanup", oracle(f"WITH {_VERSIONS} SELECT version_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts DESC, version_id DESC) AS rank FROM v) WHERE rank > 5"))
def version_cleanup(spark, d):
    return V.newest_versions(_versions(spark, d), 5).select("version_id", "category")


@register("version_latest", oracle(f"WITH {_VERSIONS} SELECT category, arg_max(version_id, (ts, version_id)) AS version_id FROM v GROUP BY 1"))
def version_latest(spark, d):
    return V.latest_versions(_versions(spark, d)).select("category", "version_id")


@register("inbox_drain", oracle("SELECT session_id, target, CASE WHEN target IS NULL THEN NULL ELSE session_id || ':' || target END AS promoted_id, CASE WHEN target IS NULL THEN 'unknown' ELSE 'promoted' END AS state FROM (SELECT CASE WHEN pos % 3 = 0 THEN session_id || ':' || category ELSE session_id END AS session_id, CASE WHEN pos % 3 = 0 THEN category WHEN pos % 3 = 1 THEN 'bugs' END AS target FROM blocks)"))
def inbox_drain(spark, d):
    b = blocks(spark, d)
    inbox = b.select(F.when(F.col("pos") % 3 == 0, F.concat_ws(":", "session_id", "category")).otherwise(F.col("session_id")).alias("session_id"), F.when(F.col("pos") % 3 == 1, F.lit("- Category: Bugs\nx")).otherwise("x").alias("content"))
    return V.drain(inbox, CATEGORIES).select("session_id", "target", "promoted_id", "state")


@register("pack_search", oracle("SELECT id, name FROM packs WHERE len(list_filter(keywords, lambda k: contains(lower(k), 'ring'))) > 0 OR contains(lower(name), 'ring') OR contains(lower(description), 'ring')"))
def pack_search(spark, d):
    return V.pack_search(packs(spark, d), "Ring").select("id", "name")


@register("pack_status", oracle("SELECT id, id % 3 = 0 AS installed FROM packs"))
def pack_status(spark, d):
    p = packs(spark, d)
    return V.pack_status(p, p.where("id % 3 = 0")).select("id", "installed")


@register("pack_orphans", oracle("SELECT id, registry FROM packs WHERE registry NOT IN (0, 1, 2)"))
def pack_orphans(spark, d):
    p = packs(spark, d)
    return V.orphans(p, p.select("registry").where("registry < 3").distinct()).select("id", "registry")


@register("pack_first", oracle("SELECT name, min(id) AS id, count(*) AS copies FROM packs GROUP BY 1"))
def pack_first(spark, d):
    return V.first_packs(packs(spark, d))


@register("manifest_changes", oracle("SELECT session_id AS path FROM blocks WHERE pos % 5 = 0 OR pos % 7 = 0"))
def manifest_changes(spark, d):
    b = blocks(spark, d)
    files = b.select(F.col("session_id").alias("path"), F.sha2("content", 256).alias("sha256"), "pos")
    known = files.where("pos % 5 <> 0").select("path", F.when(F.col("pos") % 7 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return V.changed_files(files.drop("pos"), known).select("path")


def _tree_sql(sessions: str) -> str:
    """The root of a tree of digests over (session_id, hash) level by level, for 16^5 leaves."""
    levels = "n5 AS (SELECT p, digest FROM leaf WHERE length(p) = 5)"
    for k in range(4, -1, -1):
        levels += f", n{k} AS (SELECT p, digest FROM leaf WHERE length(p) = {k} UNION ALL SELECT left(p, {k}), sha256('node' || chr(10) || string_agg(right(p, 1) || ':' || digest, chr(10) ORDER BY right(p, 1))) FROM n{k + 1} GROUP BY 1)"
    return f"""WITH {sessions}, e AS (SELECT session_id, hash, sha256(session_id) AS place FROM h), c AS (SELECT k, left(place, k) AS p, count(*) AS n FROM e, range(6) r(k) GROUP BY ALL),
      ends AS (SELECT session_id, min(k) AS depth FROM e JOIN c ON left(place, k) = p AND length(p) = k WHERE n <= 64 GROUP BY 1),
      leaf AS (SELECT left(place, depth) AS p, sha256('leaf' || chr(10) || string_agg(session_id || ':' || hash, chr(10) ORDER BY session_id)) AS digest FROM e JOIN ends USING (session_id) GROUP BY 1), {levels}
      SELECT substr(digest, 1, 8) AS commit_id FROM n0"""


_ENDED = "b AS (SELECT session_id, category, CASE WHEN pos % 11 = 0 THEN content || '!' ELSE content END AS content FROM blocks WHERE pos % 10 > 2)"
_SIDE = "SELECT session_id, substr(sha256(category || ':' || content), 1, 16) AS hash FROM"


def _trees(spark, d):
    """A store of trees with the first snapshot committed and the second by its changes, and both roots."""
    x = blocks(spark, d)
    a, b = x.where("pos % 10 < 7"), x.where("pos % 10 > 2").withColumn("content", F.when(F.col("pos") % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    old, new = kept(V.content_hashes(a), "old"), kept(V.content_hashes(b), "new")
    store = Snapshots(spark, f"{scratch(spark)}/trees/{uuid.uuid4().hex}")
    first = store.commit(old)
    changes = old.select("session_id", F.col("hash").alias("was")).join(new, "session_id", "full_outer").where("NOT was <=> hash").select("session_id", "hash")
    return store, first, store.amend(first, changes)


@register("vcs_tree_commit", oracle(_tree_sql(f"{_ENDED}, h AS ({_SIDE} b)")))
def vcs_tree_commit(spark, d):
    """The id of a commit that changes, adds and removes sessions of the snapshot before; equal to that of a tree built at once."""
    store, _, second = _trees(spark, d)
    delete(spark, store.path)
    return spark.createDataFrame([(second[:8],)], "commit_id string")


@register("vcs_tree_diff", oracle(f"WITH {_A}, {_ENDED}, x AS ({_SIDE} a), y AS ({_SIDE} b) SELECT session_id, CASE WHEN x.hash IS NULL THEN 'added' WHEN y.hash IS NULL THEN 'removed' ELSE 'changed' END AS kind, x.hash AS old, y.hash AS new FROM x FULL JOIN y USING (session_id) WHERE x.hash IS DISTINCT FROM y.hash"))
def vcs_tree_diff(spark, d):
    """What differs between two stored snapshots, found below unequal nodes."""
    store, first, second = _trees(spark, d)
    found = store.differences(first, second)
    delete(spark, store.path)
    return found
