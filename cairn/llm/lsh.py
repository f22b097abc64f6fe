"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash function projects a vector on a random normal direction and cuts the line into slots of one width; the difference of
two projections is normal, as wide as the vectors are apart (the normal distribution is 2-stable).  Slots of several
functions make a bucket of a table.  So for a query and a distance, the chance that a vector that far away lies in a given
bucket is a product of areas under normal curves.  Each query visits the buckets of every table in descending chance, its own
and perturbed ones, until the chances that it has visited make it likely enough that a neighbour was met in some table.
Candidates of all tables are merged, and ranked by their exact distances.

How far a query's k-th neighbour is follows from its distances to a sample, times a factor: for some rows of the sample, the
distance of their true k-th neighbour (of all rows) over that of the sample's k-th.  The sample is bounded, every row is
indexed.  A query that would visit too many buckets is compared with all rows, in blocks, instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import mixed, written
from cairn.llm.knn import prepared

SEED = 17
#: Tables, and the chance that a neighbour at the assumed distance is met in one of them.
TABLES, CHANCE = 4, 0.96
#: Functions of a table at most, buckets that a query visits of one at most (beyond, it is compared with all rows).
FUNCTIONS, PROBES = 32, 4096
#: Numbers of the sample (rows times their length), rows of it whose true neighbours are looked for, and which part of
#: the factors that they give is exceeded.
SAMPLE, TRIED, EXCEEDED = 1 << 18, 64, 0.1
#: Rows of a bucket that are solved at once, and queries with them; larger ones are cut.
ROWS, ASKS = 4096, 4096


def finite(vector: Column | str) -> Column:
    """A vector as an array of doubles; null if it or a component is null or not finite, or if all are zero."""
    whole = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(whole, lambda x: x != 0)
    return F.when(whole.isNotNull() & fine, F.transform(whole, lambda x: x.cast("double")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def packed(x: np.ndarray) -> pa.Array:
    """Vectors as bytes, of single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = (x.astype("<f4") == x).all(axis=1)
    return pa.array([(r.astype("<f4") if s else r).tobytes() for r, s in zip(x.astype("<f8"), short)], pa.binary())


def unpacked(raw: list[bytes], size: int) -> np.ndarray:
    short = np.fromiter((len(r) == 4 * size for r in raw), bool, len(raw))
    out = np.empty((len(raw), size))
    for kind, at in (("<f4", np.flatnonzero(short)), ("<f8", np.flatnonzero(~short))):
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, size)
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, rounded by the scale of the vectors' squares."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T
    return np.maximum(np.where(np.isnan(d), np.inf, d), 0)


def below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to seven digits (Abramowitz and Stegun, 7.1.26)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.where(z < 0, tail, 2 - tail) / 2


@dataclass
class Hashes:
    """Functions of all tables: directions (size x tables x functions), shifts, the width of slots; multipliers make keys."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float
    multipliers: np.ndarray

    @classmethod
    def new(cls, size: int, tables: int, functions: int, width: float) -> Hashes:
        draw = np.random.default_rng(SEED)
        directions, shifts = draw.normal(size=(size, tables, functions)), draw.uniform(0, 1, (tables, functions))
        return cls(directions, shifts, width, draw.integers(0, 1 << 63, (tables, functions), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where vectors lie on each function's line, in slots (n x tables x functions)."""
        at = np.tensordot(x, self.directions, 1) / self.width + self.shifts
        return np.clip(np.nan_to_num(at), -(2.0**40), 2.0**40)

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        """Of whole slots (n x functions), the buckets' keys: longs. Buckets that share one are one bucket."""
        h = (slots.astype(np.int64).view(np.uint64) * self.multipliers[table]).sum(axis=1, dtype=np.uint64)
        return mixed(h + np.uint64(table)).view(np.int64)


def probes(place: np.ndarray, radius: float, chance: float, most: int) -> np.ndarray | None:
    """Buckets (n x functions, whole slots) in descending chance that a vector `radius` slots from place is in them.

    As many as together have `chance`, which is less than 1; None if that takes more than `most`.
    """
    reach = int(math.ceil(min(6 * radius, 1e6))) + 1
    if reach > most:
        return None
    steps = np.arange(-reach, reach + 2)
    home = np.floor(place)
    share = np.diff(below((steps + (home - place)[:, None]) / radius), axis=1)  # functions x steps
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.take_along_axis(share, order, 1)
    rest = np.r_[np.cumprod(best[::-1, 0])[::-1][1:], 1.0]  # the most that functions to come leave of a chance
    least = float(best[:, 0].prod())
    while True:
        least /= 4
        p, slots = np.ones(1), np.zeros((1, 0), np.int64)
        for k in range(len(place)):
            enough = p[:, None] * best[k][None] * rest[k] >= least
            if enough.sum() > 16 * most:
                return None
            i, j = np.nonzero(enough)
            p, slots = p[i] * best[k][j], np.c_[slots[i], steps[order[k][j]] + int(home[k])]
        if p.sum() >= chance or len(p) > most:
            break
        if least < 1e-30:
            return None
    first = np.argsort(-p, kind="stable")
    n = int(np.searchsorted(np.cumsum(p[first]), chance)) + 1
    return None if n > most else slots[first[:n]]


class Best:
    """Of pairs of a query and a vector, each query's n nearest, held in bounded space."""

    def __init__(self, n: int, most: int = 200_000):
        self.n, self.most, self.parts, self.rows = n, most, [], 0

    def add(self, entry: np.ndarray, score: np.ndarray, ids: list[list[int]]) -> None:
        times = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((v for some in ids for v in some), np.int64, int(times.sum()))
        self.parts.append((np.repeat(entry, times), np.repeat(score, times), flat))
        self.rows += len(flat)
        if self.rows > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        entry, score, vec = (np.concatenate(c) for c in zip(*self.parts))
        at = np.lexsort([score, vec, entry])  # a pair that several tables met counts once
        at = at[np.r_[True, (np.diff(entry[at]) != 0) | (np.diff(vec[at]) != 0)]]
        at = at[np.lexsort([vec[at], score[at], entry[at]])]
        first = np.r_[0, np.flatnonzero(np.diff(entry[at])) + 1]
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        at = at[nth < self.n]
        found = entry[at], score[at], vec[at]
        self.parts, self.rows = [found], len(at)
        self.most = max(self.most, 2 * self.rows)
        return found


def near(q: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of q's n nearest of x, and those that rounding can't tell from the last: numbers of both, exact distances."""
    found = []
    scale = 1e-12 * (1e-300 + (q * q).sum(axis=1) + float((x * x).sum(axis=1).max()))
    d = distances(q, x)
    if d.shape[1] > n:
        last = np.partition(d, n - 1, axis=1)[:, n - 1]
        a, b = np.nonzero(d <= (last + scale)[:, None])
    else:
        a, b = (i.ravel() for i in np.indices(d.shape))
    for i in range(0, len(a), 1 << 14):
        with np.errstate(over="ignore"):
            found.append(np.sqrt(((q[a[i : i + (1 << 14)]] - x[b[i : i + (1 << 14)]]) ** 2).sum(axis=1)))
    return a, b, np.concatenate([np.zeros(0), *found])


def reach(q: np.ndarray, sample: np.ndarray, k: int, factor: float) -> np.ndarray:
    """A distance within which each of q likely has k neighbours besides itself."""
    k = min(k, len(sample) - 1)
    return np.concatenate([np.sqrt(np.partition(distances(q[i : i + 512], sample), k, axis=1)[:, k]) for i in range(0, len(q), 512)]) * factor


class Index:
    """Vectors in buckets of all tables, and the radius that each query is likely to need."""

    def __init__(self, data: DataFrame, size: int, k: int, tables: int, chance: float, bucket: int | None):
        """data: vec, ids (distinct vectors)."""
        self.data, self.size, self.k, self.tables, self.chance = data, size, k, tables, chance
        self.n = data.count()
        drawn = data.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(max(k + 2, SAMPLE // size)).collect()
        self.sample = np.array([r[0] for r in drawn], np.float64)
        self.factor = self._factor()
        radius = float(np.median(reach(self.sample, self.sample, k, self.factor)))
        width = radius if np.isfinite(radius) and radius > 0 else 1.0
        functions, wider = self._functions(width, bucket or max(16, 4 * math.isqrt(self.n)))
        self.hashes = Hashes.new(size, tables, functions, wider)

    def _functions(self, width: float, bucket: int) -> tuple[int, float]:
        """So many functions, with slots of `width` or somewhat wider, as make buckets of `bucket` rows.

        That is by the chance that two rows of the sample share a slot: at this width, functions are enough; for a whole
        number of them slots are then as wide as they may be.
        """
        lines = np.random.default_rng(SEED + 1).normal(size=(self.size, FUNCTIONS))
        at = self.sample @ lines
        wanted = math.log(min(1.0, bucket / self.n))

        def together(w: float) -> float:
            """The mean logarithm of that chance."""
            share = []
            for column in np.floor(np.clip(np.nan_to_num(at / w), -(2.0**40), 2.0**40)).T:
                n = np.unique(column, return_counts=True)[1]
                share.append((n * (n - 1)).sum() / max(1, len(column) * (len(column) - 1)))
            return float(np.mean(np.log(np.clip(share, 1e-6, 0.99))))

        functions = int(np.clip(math.ceil(wanted / together(width)), 1, FUNCTIONS))
        low, high = width, 8 * width
        for _ in range(20):
            middle = (low + high) / 2
            low, high = (middle, high) if functions * together(middle) < wanted else (low, middle)
        return functions, low

    def _factor(self) -> float:
        """How far the k-th of all rows is, over how far the k-th of the sample is: exceeded by few of the rows tried."""
        tried, k, size = self.sample[:TRIED], self.k, self.size
        if len(self.sample) >= self.n or len(self.sample) <= k:
            return 1.0

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = np.full((len(tried), k + 1), np.inf)
            for b in batches:
                x = _matrix(b["vec"], size)
                for i in range(0, len(x), 4096):
                    least = np.sort(np.c_[least, distances(tried, x[i : i + 4096])], axis=1)[:, : k + 1]
            for row, some in enumerate(least):
                yield pa.RecordBatch.from_arrays([pa.array([row] * (k + 1)), pa.array(np.sqrt(some))], names=["row", "d"])

        order = Window.partitionBy("row").orderBy("d")
        found = self.data.select("vec").mapInArrow(of, "row bigint, d double").withColumn("i", F.row_number().over(order)).where(F.col("i") == k + 1)
        far = {r.row: r.d for r in found.collect()}  # TRIED rows
        of_sample = np.sqrt(np.partition(distances(tried, self.sample), k, axis=1)[:, k])
        ratio = [far[i] / d for i, d in enumerate(of_sample) if d > 0 and np.isfinite(d)]
        return float(np.quantile(ratio, 1 - EXCEEDED)) if ratio else 1.0

    def rows(self) -> DataFrame:
        """Each row of data in a bucket of each table: key, raw, ids."""
        size, hashes, tables = self.size, self.hashes, self.tables

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
                x = _matrix(b["vec"], size)
                slots, raw = np.floor(hashes.places(x)), packed(x)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.keys(slots[:, t], t)), raw, b["ids"]], names=["key", "raw", "ids"])

        return self.data.mapInArrow(of, "key bigint, raw binary, ids array<bigint>")

    def visits(self, queries: DataFrame) -> DataFrame:
        """Each query (vec, entry) with the buckets that it visits: entry, key. A null key: it has to see all rows."""
        size, hashes, tables = self.size, self.hashes, self.tables
        sample, k, factor = self.sample, self.k, self.factor
        each = 1 - (1 - self.chance) ** (1 / tables)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
                x = _matrix(b["vec"], size)
                radius, places, entries = reach(x, sample, k, factor) / hashes.width, hashes.places(x), b["entry"].to_numpy()
                for i in range(len(x)):
                    # below a thousandth of a slot, chances are those of one place
                    found = [probes(places[i, t], max(float(radius[i]), 1e-3), each, PROBES) if np.isfinite(radius[i]) else None for t in range(tables)]
                    if any(f is None for f in found):
                        yield pa.RecordBatch.from_arrays([pa.array(entries[i : i + 1]), pa.array([None], pa.int64())], names=["entry", "key"])
                        continue
                    keys = np.unique(np.concatenate([hashes.keys(f, t) for t, f in enumerate(found)]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(entries[i], len(keys))), pa.array(keys)], names=["entry", "key"])

        return queries.select("vec", "entry").mapInArrow(of, "entry bigint, key bigint")


def _candidates(rows: DataFrame, asks: DataFrame, size: int, n: int) -> DataFrame:
    """Of parts (part; rows: raw, ids; asks: entry, raw), each entry's n nearest rows: entry, vec_id, score.

    Parts stream through tasks in order; a task keeps each entry's best over all parts that it has seen.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part, raw, ids, x = Best(n), None, [], [], None
        for b in batches:
            columns = [b[c].to_pylist() for c in ("part", "entry", "raw", "ids")]
            edges = [0, *(i for i in range(1, b.num_rows) if columns[0][i] != columns[0][i - 1] or (columns[1][i] is None) != (columns[1][i - 1] is None)), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if columns[0][i] != part:
                    part, raw, ids, x = columns[0][i], [], [], None
                if columns[1][i] is None:  # rows come before those who ask
                    raw += columns[2][i:j]
                    ids += columns[3][i:j]
                elif raw:
                    x = unpacked(raw, size) if x is None else x
                    entry = np.array(columns[1][i:j], np.int64)
                    for a in range(0, len(entry), 512):
                        q = unpacked(columns[2][i:j][a : a + 512], size)
                        ask, row, score = near(q, x, n)
                        best.add(entry[a : a + 512][ask], score, [ids[r] for r in row.tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.cut()], names=["entry", "score", "vec_id"])

    have = rows.select("part", F.lit(None).cast("long").alias("entry"), "raw", "ids")
    wanted = asks.select("part", "entry", "raw", F.lit(None).cast("array<bigint>").alias("ids"))
    both = have.unionByName(wanted).repartition("part").sortWithinPartitions("part", F.col("entry").isNotNull())
    return both.mapInArrow(solve, "entry bigint, score double, vec_id bigint")


def _parts(rows: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and asks by part: buckets (key), those of many rows or asks cut so that each pair meets in one part."""
    n_rows = rows.groupBy("key").agg(F.ceil(F.count("*") / ROWS).alias("r"))
    n_asks = asks.groupBy("key").agg(F.ceil(F.count("*") / ASKS).alias("a"))
    cut = written(n_rows.join(n_asks, "key"))  # buckets with both
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part = F.xxhash64("key", "i", "j").alias("part")
    dealt = rows.join(cut, "key").withColumn("i", F.pmod(F.xxhash64("raw"), F.col("r"))).withColumn("j", upto("a")).select(part, "raw", "ids")
    asked = asks.join(cut, "key").withColumn("j", F.pmod(F.xxhash64("entry"), F.col("a"))).withColumn("i", upto("r")).select(part, "entry", "raw")
    return dealt, asked


def nearest(vectors: DataFrame, is_query: Column, k: int, tables: int = TABLES, chance: float = CHANCE, bucket: int | None = None, vec_id: str = "vec_id", vec: str = "vec") -> DataFrame:
    """For each row where is_query holds, its k nearest other rows found: query_id, rank (from 1), vec_id, score.

    vec is an array of doubles (see finite); score is the Euclidean distance, computed from the differences of the vectors
    themselves.  Ties go to smaller ids; rows that share an id with the query are not its candidates, repeated rows count
    once, equal vectors are one entry of the index, with its k + 1 smallest ids.  Null and empty vectors and null ids take no
    part, nor do vectors of another length than most have.  Without vectors or queries the result is empty.  Squares that
    overflow make infinite distances.  Columns but these two and those of is_query are left out, whatever their names.

    chance is what a neighbour at the assumed distance is met with; nearer ones are met more often.  bucket: the rows of a
    bucket that the number of functions aims at, by default four times the root of all rows, since to visit a bucket
    costs as much as to compare some rows.  A query whose neighbours lie in too many buckets sees all rows.
    """
    ready = prepared(vectors, is_query, k, vec_id, vec)
    if ready is None or ready[1].isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data, queries, asked, size = ready
    index = Index(data, size, k, tables, chance, bucket)
    rows, visits = written(index.rows()), written(index.visits(queries))
    raw = written(_raw(queries, size))
    asks = visits.where("key is not null").join(raw, "entry")
    every = visits.where("key is null").select("entry").join(raw, "entry")
    n_parts = -(-index.n // ROWS)
    found = _candidates(*_parts(rows, asks), size, k + 1)
    if not every.isEmpty():
        all_rows = _raw(data, size, "ids").withColumn("key", F.pmod(F.xxhash64("raw"), F.lit(n_parts)))
        asks_all = every.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
        found = found.unionByName(_candidates(*_parts(all_rows, asks_all), size, k + 1))
    order = Window.partitionBy("entry").orderBy("score", "vec_id")
    best = found.groupBy("entry", "vec_id").agg(F.min("score").alias("score")).withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    lists = best.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    ranked = asked.select("id", F.xxhash64("vec").alias("entry")).join(lists, "entry").select("id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)).alias("pos", "b"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _raw(rows: DataFrame, size: int, more: str = "entry") -> DataFrame:
    """raw (vec as bytes) and one more column."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
            yield pa.RecordBatch.from_arrays([packed(_matrix(b["vec"], size)), b[more]], names=["raw", more])

    return rows.select("vec", more).mapInArrow(of, f"raw binary, {more} {'bigint' if more == 'entry' else 'array<bigint>'}")
