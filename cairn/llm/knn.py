"""Exact top-k search by inner product: a Voronoi join of queries and data.

Vectors belong to the cell of their nearest pivot.  Inner products become distances: with m the largest norm, data get
one more coordinate, sqrt(m^2 - |x|^2), queries a zero; then |q - x|^2 = |q|^2 + m^2 - 2 q.x, and the nearest are those of
the largest product.  Summaries of the cells (smallest and largest distance to the pivot, the k + 1 smallest) bound how far
a query's k-th neighbour can be; solving each query in its own cell first bounds it far better.  A row goes to a group of
queries only if, by its distance to its pivot, some query of the group may have it that near.  Groups are solved in blocks
of rows, and the blocks' best are merged.

Equal vectors are one entry that keeps its smallest k + 1 ids, which is all that a ranking with ties to smaller ids can
use; so no vector is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import written

#: Queries of a group and rows of a block at most (in the mean), and pivots at most.
GROUP, BLOCK, PIVOTS = 4096, 20_000, 2048
#: Bounds of groups and cells (a few numbers each) that are sent to all executors; more are joined.
MOST_RANGES = 500_000


def floored(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as an array of longs; null if the vector or a component is null or not finite."""
    whole = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole.isNotNull() & fine, F.transform(whole, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def packed(x: np.ndarray) -> pa.Array:
    """Vectors as bytes, of the smallest integers that hold them."""
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if len(x) == 0 or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
    return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())


def unpacked(raw: pa.Array, size: int) -> np.ndarray:
    out, values = np.zeros((len(raw), size), np.int64), raw.to_pylist()
    width = np.array([len(v) for v in values]) // size if values else np.zeros(0, int)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(values[i] for i in at), f"<i{w}").reshape(-1, size)
    return out


def pivots(data: DataFrame, most: int) -> np.ndarray:
    """At most `most` distinct vectors, drawn by a hash of the vector: a bounded sample, which bounds only what is pruned."""
    rows = data.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(most).collect()
    return np.array([r[0] for r in rows], np.float64)


class Cells:
    """Pivots and what cells of data are bounded by: near (each cell's k + 1 smallest distances) and far."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.top = top  # the largest squared norm
        self.lifted = np.c_[pivots, np.sqrt(np.maximum(top - (pivots * pivots).sum(axis=1), 0))]
        self.slack = 1e-6 * (1 + math.sqrt(top))  # distances are rounded

    def distances(self, x: np.ndarray, is_data: bool) -> np.ndarray:
        x = x.astype(np.float64)
        norm = (x * x).sum(axis=1)
        lift = np.sqrt(np.maximum(self.top - norm, 0)) if is_data else np.zeros(len(x))
        both = np.c_[x, lift]
        d2 = (both * both).sum(axis=1)[:, None] + (self.lifted * self.lifted).sum(axis=1)[None] - 2 * both @ self.lifted.T
        return np.sqrt(np.maximum(d2, 0))


def _summaries(data: DataFrame, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell of data: the k + 1 smallest distances (infinite where there are fewer), the largest, the number of rows.

    Partitions are cut down to that before anything moves; what the driver gets is bounded by pivots.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, count = np.full((n, k + 1), np.inf), np.zeros(n), np.zeros(n, np.int64)
        for b in batches:
            cell, dist = b["cell"].to_numpy(), b["dist"].to_numpy()
            np.maximum.at(far, cell, dist)
            count += np.bincount(cell, minlength=n)
            for c in np.unique(cell):
                near[c] = np.sort(np.concatenate([near[c], dist[cell == c]]))[: k + 1]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(near[some].tolist(), pa.list_(pa.float64())), pa.array(far[some]), pa.array(count[some])], names=["cell", "near", "far", "n"])

    parts = data.select("cell", "dist").mapInArrow(of, "cell bigint, near array<double>, far double, n bigint")
    merged = parts.groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"), F.max("far").alias("far"), F.sum("n").alias("n"))
    near, far, count = np.full((n, k + 1), np.inf), np.zeros(n), np.zeros(n, np.int64)
    for r in merged.collect():
        near[r.cell], far[r.cell], count[r.cell] = r.near, r.far, r.n
    return near, far, count


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; those beyond them are the largest or smallest one."""
    about = q.astype(np.float64) @ x.astype(np.float64)
    with np.errstate(over="ignore"):
        found = q @ x
    found[about >= 2.0**63] = np.iinfo(np.int64).max
    found[about <= -(2.0**63)] = np.iinfo(np.int64).min + 1
    return found


def _solved(data: DataFrame, asks: DataFrame, size: int, k: int) -> DataFrame:
    """The k + 1 best of data (grp, block, part, raw, ids) for each of asks (grp, block, part, entry, raw): entry, vec_id, score."""

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, have = t.filter(pc.is_valid(t["entry"])), t.filter(pc.is_null(t["entry"]))
        out = []
        if asks.num_rows and have.num_rows:
            q, x = unpacked(asks["raw"].combine_chunks(), size), unpacked(have["raw"].combine_chunks(), size)
            ids = have["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            exact = float(np.abs(q).max()) * float(np.abs(x).max()) * size < 2**53
            turned = x.T.astype(np.float64) if exact else x.T
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                s = (part.astype(np.float64) @ turned).astype(np.int64) if exact else _products(part, turned)
                n = min(k + 1, s.shape[1])
                worst = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                for i in range(len(part)):
                    at = np.flatnonzero(s[i] >= worst[i])
                    at = at[np.lexsort([first[at], -s[i][at]])][: k + 1]  # an entry's first id decides: k + 1 entries are enough
                    best = sorted(((-int(s[i][j]), v) for j in at for v in ids[j]))[: k + 1]
                    out += [(asks["entry"][a + i].as_py(), v, -w) for w, v in best]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"entry": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})

    have = data.select("grp", "block", "part", F.lit(None).cast("long").alias("entry"), "raw", "ids")
    wanted = asks.select("grp", "block", "part", "entry", "raw", F.lit(None).cast("array<bigint>").alias("ids"))
    return have.unionByName(wanted).groupBy("grp", "block", "part").applyInArrow(solve, "entry bigint, vec_id bigint, score bigint")


def _in_blocks(data: DataFrame, asks: DataFrame, blocks: DataFrame, size: int, k: int) -> DataFrame:
    """_solved, for data and asks with a grp: data cut as blocks (grp, n_blocks) says, asks in parts of GROUP.

    Each block meets each part of its group, so neither many rows nor many asks of a group make a large task.
    """
    parts = asks.groupBy("grp").agg(F.ceil(F.count("*") / GROUP).alias("n_parts"))
    both = written(blocks.join(parts, "grp"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cut = data.join(both, "grp").withColumn("block", F.pmod(F.xxhash64("raw"), F.col("n_blocks"))).withColumn("part", upto("n_parts"))
    sent = asks.join(both, "grp").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("n_parts"))).withColumn("block", upto("n_blocks"))
    return _solved(cut, sent, size, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each entry's k + 1 best of several blocks."""
    order = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)


class Join:
    """The steps of a join: vectors in cells, bounds of queries, ranges of cells that groups need, rows sent."""

    def __init__(self, data: DataFrame, queries: DataFrame, size: int, k: int, n_pivots: int | None):
        """data: vec, ids; queries: vec, entry."""
        self.size, self.k = size, k
        n = data.count()
        p = pivots(data, n_pivots or int(min(PIVOTS, max(16, math.sqrt(n)))))
        top = float(data.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0])
        self.cells = cells = Cells(p, top)

        def celled(is_data: bool, more: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
                    x = _matrix(b["vec"], size)
                    d = cells.distances(x, is_data)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([packed(x), b[more], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["raw", more, "cell", "dist"])

            return of

        self.data = written(data.mapInArrow(celled(True, "ids"), "raw binary, ids array<bigint>, cell int, dist double"))
        self.queries = written(queries.mapInArrow(celled(False, "entry"), "raw binary, entry bigint, cell int, dist double"))
        self.near, self.far, self.count = _summaries(self.data, k, len(p))
        self.bounded = self._bounded()
        self.group_of, self.parts = self._groups()
        self.ranges = self._ranges()

    def _blocks(self, counts: DataFrame) -> DataFrame:
        return counts.select("grp", F.ceil(F.col("n") / BLOCK).alias("n_blocks"))

    def _bounded(self) -> DataFrame:
        """queries with least: a score that the k + 1 best reach in the query's own cell; null if it has fewer entries."""
        spark = self.data.sparkSession
        counts = spark.createDataFrame([(int(c), int(self.count[c])) for c in np.flatnonzero(self.count)], "grp int, n long")
        own = _in_blocks(self.data.withColumnRenamed("cell", "grp"), self.queries.withColumnRenamed("cell", "grp"), self._blocks(counts), self.size, self.k)
        least = _best(own, self.k).where(F.col("i") == self.k + 1).select("entry", F.col("score").alias("least"))
        return written(self.queries.join(least, "entry", "left"))

    def _groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring cells of queries make groups: each cell's first group, and the groups that its queries are dealt to."""
        asked = {r.cell: r.n for r in self.queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # pivots at most
        lifted = self.cells.lifted
        first, parts, now, at = np.zeros(len(lifted), np.int64), np.ones(len(lifted), np.int64), -1, math.inf
        for c in sorted(asked, key=lambda c: (float(((lifted[c] - lifted[0]) ** 2).sum()), c)):
            if at + asked[c] > GROUP:
                now, at = now + 1, 0
            first[c], parts[c] = now, max(1, math.ceil(asked[c] / GROUP))
            now, at = now + parts[c] - 1, at + asked[c] / parts[c]
        return first, parts

    def _grouped(self) -> DataFrame:
        """bounded with grp."""
        table = self.data.sparkSession.createDataFrame([(c, int(self.group_of[c]), int(self.parts[c])) for c in range(len(self.parts))], "cell int, first long, parts long")
        return self.bounded.join(F.broadcast(table), "cell").select("entry", "raw", "least", (F.col("first") + F.pmod("entry", "parts")).cast("int").alias("grp"))

    def _ranges(self) -> DataFrame:
        """Of each group and cell, the distances to the pivot (low, high) between which rows may be among some query's best."""
        size, k, cells, near, far, count = self.size, self.k, self.cells, self.near, self.far, self.count
        between = np.sqrt(np.maximum(((cells.lifted[:, None] - cells.lifted[None]) ** 2).sum(axis=2), 1e-300))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
                q = unpacked(b["raw"], size)
                d = cells.distances(q, False)
                bound = np.array([np.partition((row[:, None] + near).ravel(), k)[k] for row in d])  # k + 1 entries are within
                norm = (q.astype(np.float64) ** 2).sum(axis=1)
                least = b["least"].to_numpy(zero_copy_only=False).astype(np.float64)
                exact = np.sqrt(np.maximum(norm + cells.top - 2 * least, 0))
                bound = np.fmin(bound, exact)[:, None] + cells.slack
                # beyond the plane half way between two pivots, no row of the farther one's cell is near enough
                own = d.argmin(axis=1)
                beyond = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * between[own]) > bound
                beyond[np.arange(len(d)), own] = False
                low, high = np.maximum(d - bound, near[:, 0] - cells.slack), np.minimum(d + bound, far + cells.slack)
                at, cell = np.nonzero((low <= high) & (count > 0) & ~beyond)
                key, where = np.unique(b["grp"].to_numpy()[at].astype(np.int64) * len(count) + cell, return_inverse=True)
                lo, hi = np.full(len(key), np.inf), np.full(len(key), -np.inf)
                np.minimum.at(lo, where, low[at, cell])
                np.maximum.at(hi, where, high[at, cell])
                yield pa.RecordBatch.from_arrays([pa.array((key // len(count)).astype(np.int32)), pa.array((key % len(count)).astype(np.int32)), pa.array(lo), pa.array(hi)], names=["grp", "cell", "low", "high"])

        found = self._grouped().select("raw", "least", "grp").mapInArrow(of, "grp int, cell int, low double, high double")
        return written(found.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")))

    def sent(self) -> DataFrame:
        """The rows of data that each group needs: grp and data's columns."""
        ranges = F.broadcast(self.ranges) if self.ranges.count() <= MOST_RANGES else self.ranges
        return self.data.join(ranges, "cell").where((F.col("dist") >= F.col("low")) & (F.col("dist") <= F.col("high"))).select("grp", "raw", "ids")

    def solved(self) -> DataFrame:
        """Each entry's k + 1 best."""
        rows = self.sent()
        blocks = written(self._blocks(rows.groupBy("grp").agg(F.count("*").alias("n"))))
        return _best(_in_blocks(rows, self._grouped(), blocks, self.size, self.k), self.k)


def prepared(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vec: str = "vec") -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """data (vec, ids), queries (vec, entry), asked (id, vec) and the vectors' length; None without vectors."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec"), is_query.alias("is_query")).where("id is not null and vec is not null")
    most = rows.where(F.size("vec") > 0).groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    rows = rows.where(F.size("vec") == most["size"])
    # equal vectors: one entry with the smallest k + 1 ids
    few = rows.dropDuplicates(["id", "vec"]).withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    data = written(few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = rows.where("is_query").select("id", "vec").dropDuplicates()
    return data, written(asked.select("vec").distinct().withColumn("entry", F.xxhash64("vec"))), asked, most["size"]


def top_k(vectors: DataFrame, is_query: Column, k: int, n_pivots: int | None = None, vec_id: str = "vec_id", vec: str = "vec") -> DataFrame:
    """For each row where is_query holds, its k best other rows: query_id, rank (from 1), vec_id, score.

    vec is an array of longs; score is the inner product, exact within 64 bits (beyond, the
    largest or smallest of these).  Ties go to smaller ids;
    rows that share an id with the query are not its candidates, repeated rows count once.  Null and empty vectors and
    null ids take no part, nor do vectors of another length than most have (of two such lengths, than the larger).
    Without vectors or queries the result is empty.  n_pivots: by default the root of the number of vectors, 16 at least
    and PIVOTS at most.  Columns but these two and those of is_query are left out, whatever their names.
    """
    ready = prepared(vectors, is_query, k, vec_id, vec)
    if ready is None or ready[1].isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data, queries, asked, size = ready
    best = Join(data, queries, size, k, n_pivots).solved()
    lists = best.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))
    ranked = asked.select("id", F.xxhash64("vec").alias("entry")).join(lists, "entry").select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)).alias("pos", "b"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
