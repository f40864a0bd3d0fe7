"""All pairs of vectors whose cosine lies in a band, exactly, without comparing every vector with every other.

Unit vectors are put in the cell of their nearest pivot. With r the distance of
two unit vectors at the lowest cosine asked for, a vector y of cell q can have
a partner in cell p only if

* d(y, p) <= R(p) + r, where R(p) is the largest distance in p's cell, and
* (d(y, p)^2 - d(y, q)^2) / (2 d(p, q)) <= r: partners are no farther away than
  the plane half way between p and q, on whose other side they lie.

Of two cells the one of higher number visits the lower one. Members and visitors
of a cell are dealt into blocks of bounded size, each by their own number, and
every two blocks of members meet once, as do every block of members and every
block of visitors. Where two blocks meet, their unit vectors are multiplied as
matrices in single precision, tile by tile. A product that lies farther from the
band's ends than rounding can carry it (``_slack``) is settled by that; the
others are computed again from the vectors as they came, in double precision and
in SQL's order of operations, so what lies at the end of a band falls as there.

The bounds hold whatever the pivots, so no pair is lost; how many pairs are
visited depends on how well the vectors cluster. On vectors without structure
in many dimensions every cell is near every other: there is one cell then, and
all pairs are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.stores import kept

#: Vectors from which pivots are drawn; pivots; rows of a block at most.
SAMPLE, PIVOTS, BLOCK = 4_096, 512, 32_768
#: Rows that a block may hold in any case, whatever their length, and components beyond those; rows of a block where there are blocks for all cores anyway.
LEAST, COMPONENTS, SMALL = 4_096, 1 << 21, 2_048
#: Rows of a batch that are placed at once, pairs that are computed singly at once, and rows and columns of a tile.
ROWS, PRODUCTS, TILE = 1_024, 65_536, (512, 2_048)
#: Share of a tile's pairs from which on they are counted by rows and columns, not one by one.
DENSE = 1 / 16
#: Pairs of vectors, if all were visited, for which there is a task of its own.
PAIRS = 1 << 28
#: Cells that a vector may visit on the average before fewer pivots are taken, and how many those are before there is one; rows of a table that goes to all tasks.
VISITS, FEW, SIZES = 6, 16, 100_000
#: Cosines this much lower count as within reach: rounding loses none.
SLACK = 1e-9
_TASK = ["grp", "dims", "cell", "left", "right"]
_ROW = "grp string, dims int, cell int, id long, vector binary"


class Cells:
    """Pivots of the unit vectors of one length."""

    def __init__(self, sample: np.ndarray, pivots: int):
        # Pivots far from each other: a few rounds of means over the sample.
        centres = sample[:pivots].copy()
        for _ in range(4):
            own = self._squares(sample, centres).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, sample)
            counts = np.bincount(own, minlength=len(centres))
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = centres
        self.between = np.sqrt(self._squares(centres, centres))
        self.radius = np.zeros(len(centres))

    @staticmethod
    def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :])

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of vectors and the distance to their pivots."""
        squares = self._squares(units, self.centres)
        own = squares.argmin(axis=1)
        return own, np.sqrt(squares[np.arange(len(own)), own])

    def visits(self, units: np.ndarray, own: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the lower cells that may hold partners of theirs."""
        squares = self._squares(units, self.centres)
        mine = squares[np.arange(len(own)), own]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (squares - mine[:, None]) / (2 * self.between[own])
        beyond = np.where(self.between[own] > 0, beyond, 0)
        near = (np.sqrt(squares) <= self.radius[None, :] + r + 1e-7) & (beyond <= r + 1e-7)
        near &= np.arange(len(self.centres))[None, :] < own[:, None]
        return np.nonzero(near)


def _suited(sample: np.ndarray, numbers: list[int], reach: float) -> Cells:
    """Cells around the first of these numbers of pivots with which the sample's vectors visit ``VISITS`` cells at most on the average, else the last."""
    for number in numbers:
        cells = Cells(sample, number)
        own, far = cells.place(sample)
        np.maximum.at(cells.radius, own, far)
        if len(cells.visits(sample, own, reach)[0]) <= VISITS * len(sample):
            break
    return cells


def _matrix(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), "<f8").reshape(batch.num_rows, -1)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows, "<f8")], pa.binary())


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed one component after another as SQL does."""
    total = np.zeros(len(x))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        total += a * b
    return total


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def measured(vectors: DataFrame, by: str | None) -> DataFrame:
    """id, grp, dims and the vector of every row with an id whose vector has a length and holds finite numbers only."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.select(F.col("id").cast("long").alias("id"), (F.col(by).cast("string") if by else F.lit("")).alias("grp"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("id IS NOT NULL AND grp IS NOT NULL").withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return rows.select("id", "grp", F.size("embedding").alias("dims"), "embedding")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    for i in range(0, batch.num_rows, ROWS):
        some = batch.slice(i, ROWS)
        dims = some.column("dims").to_numpy()
        for d in np.unique(dims):
            yield int(d), some.filter(pa.array(dims == d))


def blocks(vectors: DataFrame, low: float, by: str | None = None, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """grp, dims, cell, left, right, side (0: member, 1: the same rows as partners, 2: visitor), id and vector: rows that meet.

    Blocks of members meet where left <= right, each pair of blocks once; blocks
    of visitors are numbered behind those of members. Two tables are written, the
    vectors and the placed vectors, and nothing of their pairs.
    """
    spark = vectors.sparkSession
    rows = kept(measured(vectors, by), "measured")
    n = rows.count()
    reach = math.sqrt(max(0.0, 2 - 2 * (low - SLACK)))
    # A bounded sample in the order of a hash; an index over it changes no result.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dims", "embedding").toArrow()
    cells: dict[int, Cells] = {}
    dims = sample["dims"].to_numpy()
    for d in np.unique(dims):
        some = _units(np.array([v for v, k in zip(sample["embedding"].to_pylist(), dims, strict=True) if k == d]))
        cells[int(d)] = _suited(some, [max(1, min(pivots, m, len(some))) for m in (4 * math.isqrt(n), math.isqrt(n), FEW, 1)], reach)

    def known(d: int) -> Cells:
        # A length that the sample lacks is one cell.
        return cells[d] if d in cells else Cells(np.ones((1, d)) / math.sqrt(d), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_length(whole):
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                own, far = known(d).place(_units(flat))
                yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("dims"), pa.array(own, pa.int32()), batch.column("id"), _packed(flat), pa.array(far)], ["grp", "dims", "cell", "id", "vector", "far"])

    placed = kept(rows.mapInArrow(place, f"{_ROW}, far double"), "placed")
    for r in placed.groupBy("dims", "cell").agg(F.max("far").alias("far")).collect():  # ``pivots`` rows a length
        if r["dims"] in cells:
            cells[r["dims"]].radius[r["cell"]] = r["far"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_length(whole):
                row, cell = known(d).visits(_units(_matrix(batch)), batch.column("cell").to_numpy(), reach)
                took = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([took.column("grp"), took.column("dims"), pa.array(cell, pa.int32()), took.column("id"), took.column("vector")], ["grp", "dims", "cell", "id", "vector"])

    members = placed.drop("far")
    # Where every length is one cell nobody visits another one.
    visitors = members.mapInArrow(visit, _ROW) if any(len(c.centres) > 1 for c in cells.values()) else members.limit(0)
    place_of = ["grp", "dims", "cell"]
    # A block holds so many rows that its vectors are bounded, and fewer where there would be too few blocks for the cores.
    some = min(block, max(SMALL, -(-n // math.isqrt(6 * spark.sparkContext.defaultParallelism))))
    size = F.least(F.lit(some), F.greatest(F.lit(LEAST), F.floor(F.lit(COMPONENTS) / F.col("dims"))))
    counted = members.select(*place_of, F.lit(0).alias("side")).unionByName(visitors.select(*place_of, F.lit(2).alias("side"))).groupBy(*place_of)
    parts = [F.ceil(F.count_if(F.col("side") == side) / size).cast("int").alias(name) for side, name in ((0, "parts"), (2, "more"))]
    sizes = kept(counted.agg(*parts).where("parts > 0"), "sizes")
    if sizes.count() <= SIZES:
        sizes = F.broadcast(sizes)
    own, theirs = (F.pmod(F.xxhash64("id"), F.col(name)).cast("int") for name in ("parts", "more"))
    here = members.join(sizes, place_of)
    first = here.withColumn("side", F.lit(0)).withColumn("left", own).withColumn("right", F.explode(F.sequence("left", F.col("parts") + F.col("more") - 1)))
    second = here.withColumn("side", F.lit(1)).withColumn("right", own).withColumn("left", F.explode(F.sequence(F.lit(0), "right")))
    third = visitors.join(sizes, place_of).withColumn("side", F.lit(2)).withColumn("right", F.col("parts") + theirs).withColumn("left", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Blocks grow as the square of the rows where vectors have no structure; so do the tasks that they are dealt over.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * n // (2 * PAIRS)))
    return first.unionByName(second).unionByName(third).drop("parts", "more").repartition(tasks, *_TASK)


class Side:
    """One side of a block, by id: ids, vectors, their squared lengths, and unit vectors in single precision."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.squares = _inner(self.x, self.x)
        self.units = np.empty(x.shape, np.float32)
        for i in range(0, len(x), ROWS):
            self.units[i : i + ROWS] = _units(self.x[i : i + ROWS])


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[Side, Side, bool]:
    """Both sides of a block, and whether it is one of members with themselves, of which each pair is taken once."""
    some = [b for b in batches if b.num_rows]
    ids, side = (np.concatenate([b.column(name).to_numpy() for b in some]) for name in ("id", "side"))
    x = np.concatenate([_matrix(b) for b in some])
    left, right = (some[0].column(name)[0].as_py() for name in ("left", "right"))
    return Side(ids[side == 0], x[side == 0]), Side(ids[side > 0], x[side > 0]), left == right


def _slack(dims: int) -> float:
    """By how much a product of unit vectors in single precision is off at most: rounded components and sums, twice over."""
    return (dims + 8) * 2.0**-23


def _tiles(one: Side, two: Side, itself: bool, low: float, high: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row and column of the tiles of a block, their products, and which of these may lie in the band; buffers are used again."""
    slack = _slack(one.x.shape[1])
    products, marks = np.empty(TILE[0] * TILE[1], np.float32), np.empty(TILE[0] * TILE[1], bool)
    for i in range(0, len(one.ids), TILE[0]):
        a = one.units[i : i + TILE[0]]
        for j in range(0, len(two.ids), TILE[1]):
            b = two.units[j : j + TILE[1]]
            if itself and two.ids[j + len(b) - 1] <= one.ids[i]:
                continue
            shape, n = (len(a), len(b)), len(a) * len(b)
            near = np.matmul(a, b.T, out=products[:n].reshape(shape))
            may = np.greater_equal(near, np.float32(low - slack), out=marks[:n].reshape(shape))
            if high < 1 + slack:
                may &= near <= np.float32(high + slack)
            yield i, j, near, may


def _cosines(one: Side, two: Side, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of these rows as SQL computes them, some at a time."""
    told = [np.zeros(0)]
    for k in range(0, len(p), step := max(1, COMPONENTS // one.x.shape[1])):
        a, b = p[k : k + step], q[k : k + step]
        x, y, product = one.x[a], two.x[b], one.squares[a] * two.squares[b]
        odd = ~((product > 1e-290) & (product < np.inf))  # vectors so long or short that the product isn't a number of full precision
        cosine = _inner(x, y) / np.sqrt(np.where(odd, 1, product))
        cosine[odd] = _inner(_units(x[odd]), _units(y[odd]))
        told.append(np.clip(cosine, -1, 1))
    return np.concatenate(told)


class Later:
    """Of each row of a side: how many partners of greater id it has, the least and the greatest."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, np.zeros(len(ids), np.int64)
        self.first, self.last = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, others: np.ndarray) -> None:
        """Pairs one by one."""
        later = self.ids[at] < others
        at, others = at[later], others[later]
        np.add.at(self.n, at, 1)
        np.minimum.at(self.first, at, others)
        np.maximum.at(self.last, at, others)

    def add_tile(self, begin: int, fits: np.ndarray, others: np.ndarray) -> None:
        """Rows of a tile at once; ``others``, the ids of its columns, ascend as the rows' ids do."""
        rows = slice(begin, begin + len(fits))
        ids = self.ids[rows]
        if others[-1] <= ids[0]:
            return
        if ids[-1] >= others[0]:
            fits = fits & (ids[:, None] < others[None, :])
        self.n[rows] += (n := np.count_nonzero(fits, axis=1))
        some = np.flatnonzero(n)
        self.first[begin + some] = np.minimum(self.first[begin + some], others[fits.argmax(axis=1)[some]])
        self.last[begin + some] = np.maximum(self.last[begin + some], others[-1 - fits[:, ::-1].argmax(axis=1)[some]])


def _found(batches: Iterator[pa.RecordBatch], low: float, high: float) -> Iterator[pa.RecordBatch]:
    """a, b and similarity of the pairs of one block, a tile at a time."""
    one, two, itself = _sides(batches)
    for i, j, _, may in _tiles(one, two, itself, low, high):
        p, q = np.nonzero(may)
        a, b = one.ids[i + p], two.ids[j + q]
        once = a < b if itself else a != b
        p, q, a, b = p[once], q[once], a[once], b[once]
        cosine = _cosines(one, two, i + p, j + q)
        fits = (cosine >= low) & (cosine <= high)
        if fits.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[fits]), pa.array(np.maximum(a, b)[fits]), pa.array(cosine[fits])], ["a", "b", "similarity"])


def _counted(batches: Iterator[pa.RecordBatch], low: float) -> Iterator[pa.RecordBatch]:
    """anchor, n, first and last of the rows of one block."""
    one, two, itself = _sides(batches)
    lefts, rights = Later(one.ids), Later(two.ids)
    sure = np.float32(low + _slack(one.x.shape[1]))
    for i, j, near, may in _tiles(one, two, itself, low, 2.0):
        n, width = np.count_nonzero(may), may.shape[1]
        if not n:
            continue
        few = n < DENSE * may.size
        at = np.flatnonzero(may) if few else np.flatnonzero(may & (near < sure))
        asked = at[near.ravel()[at] < sure] if few else at
        p, q = np.divmod(asked, width)
        may.ravel()[asked[_cosines(one, two, i + p, j + q) < low]] = False
        if few:
            p, q = np.divmod(at[may.ravel()[at]], width)
            lefts.add(i + p, two.ids[j + q])
            if not itself:
                rights.add(j + q, one.ids[i + p])
        else:
            lefts.add_tile(i, may, two.ids[j : j + width])
            if not itself:
                rights.add_tile(j, np.ascontiguousarray(may.T), one.ids[i : i + len(may)])
    for told in (lefts, rights):
        some = told.n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (told.ids, told.n, told.first, told.last)], ["anchor", "n", "first", "last"])


def pairs(vectors: DataFrame, low: float, high: float, by: str | None = None, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """a, b (a < b) and similarity of all pairs, within a group ``by`` where that is given, whose cosine lies from ``low`` (above 0) to ``high``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, low, high)

    return blocks(vectors, low, by, pivots, block).groupBy(*_TASK).applyInArrow(work, "a long, b long, similarity double")


def groups(vectors: DataFrame, low: float, by: str | None = None, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """anchor, n, first and last: how many later vectors are at least so similar to an earlier one, the least and the greatest; blocks count, no pair leaves them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, low)

    told = blocks(vectors, low, by, pivots, block).groupBy(*_TASK).applyInArrow(work, "anchor long, n long, first long, last long")
    return told.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
