"""SimHash near-duplicates: fingerprints of word shingles, and a binary trie self-join that links close ones.

Two fingerprints within `budget` differing bits agree on at least one of `budget + 1` parts of their bits.  So rows are
dealt to buckets by (mask of a part, bits under the mask), and each bucket is a binary trie that is joined with itself:
pairs of nodes go down together, add up differing bits and are dropped when these exceed the budget.  A bucket of more
than `bucket_rows` fingerprints is dealt anew by one more part, which loses no link.

Where a similarity of texts is asked for, fingerprints only propose pairs: each link is checked by the shared part of the
texts' distinct shingles.  Pairs are compared within tasks, and only those that join something are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cairn.llm.common import fresh, mixed, written
from cairn.llm.graph import components

SEED = 42


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1))


def majority_bits(h: np.ndarray, block: int = 1 << 14) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        part = np.ascontiguousarray(h[i : i + block]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3, words: int = 1) -> Column:
    """An array of `words` 64-bit fingerprints (as signed longs) of whole texts.

    The first is that of XXH64; further ones use the same hashes mixed anew.  Null and empty texts get zeros.
    """
    salts = [np.uint64((0xA0761D6478BD642F * i) & (2**64 - 1)) for i in range(words)]

    @arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            found = np.zeros((len(texts), words), np.uint64)
            for i, text in enumerate(texts.cast(pa.large_binary())):
                h = shingle_hashes(text.as_py() or b"", shingle)
                found[i] = [majority_bits(mixed(h ^ s) if s else h) for s in salts]
            yield pa.ListArray.from_arrays(np.arange(0, found.size + 1, words, dtype=np.int32), found.view(np.int64).ravel())

    return of(text)


def shingles(text: Column, shingle: int) -> Column:
    """The hashes of a text's distinct shingles, sorted."""

    @arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            found = [np.unique(shingle_hashes(t.as_py() or b"", shingle)) for t in texts.cast(pa.large_binary())]
            yield pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    return of(text)


def set_fingerprint(text: Column, shingle: int, words: int) -> Column:
    """As fingerprint, but of distinct shingles, and with two more longs: a hash of the set of shingles, and its size."""
    salts = [np.uint64((0xA0761D6478BD642F * i) & (2**64 - 1)) for i in range(words)]

    @arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            found = np.zeros((len(texts), words + 2), np.uint64)
            for i, text in enumerate(texts.cast(pa.large_binary())):
                h = np.unique(shingle_hashes(text.as_py() or b"", shingle))
                found[i] = [*(majority_bits(mixed(h ^ s) if s else h) for s in salts), xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h)]
            yield pa.ListArray.from_arrays(np.arange(0, found.size + 1, words + 2, dtype=np.int32), found.view(np.int64).ravel())

    return of(text)


class Forest:
    """Tries over rows of `prints` (n x words); rows of one bucket make one trie.

    With `counted`, only so many words count for differing bits: the others tell rows of equal fingerprints apart.
    """

    def __init__(self, bucket: np.ndarray, prints: np.ndarray, counted: int | None = None):
        self.counted = prints.shape[1] if counted is None else counted
        self.order = np.lexsort([*prints.T[::-1], bucket])
        self.prints = prints[self.order]
        self.edges = np.flatnonzero(np.r_[True, np.diff(bucket[self.order]) != 0, True])
        self.label = np.arange(len(prints))

    def _near(self, a: np.ndarray, b: np.ndarray, budget: int) -> np.ndarray:
        return np.bitwise_count(self.prints[a, : self.counted] ^ self.prints[b, : self.counted]).sum(axis=1) <= budget

    def _close(self, a: np.ndarray, b: np.ndarray, budget: int) -> None:
        near = self._near(a, b, budget)
        a, b = a[near], b[near]
        while len(a):
            a, b = self.label[a], self.label[b]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            np.minimum.at(self.label, b, a)
            while (self.label != (up := self.label[self.label])).any():
                self.label = up

    def _leaves(self, budget: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that may be within the budget, without those of nodes whose rows all have one label by then."""
        lo, hi = self.edges[:-1], self.edges[1:]
        many = hi - lo > 1
        todo = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int16))]
        ones: dict[int, np.ndarray] = {}
        while todo:
            depth, al, ah, bl, bh, diff = todo.pop()
            leaves = (ah - al == 1) & (bh - bl == 1)
            yield al[leaves], bl[leaves]
            # a pair of nodes whose rows are all linked already has nothing to add
            turns = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])]
            linked = (turns[ah - 1] == turns[al]) & (turns[bh - 1] == turns[bl]) & (self.label[al] == self.label[bl])
            al, ah, bl, bh, diff = (x[~leaves & ~linked] for x in (al, ah, bl, bh, diff))
            if not len(al) or depth == 64 * self.prints.shape[1]:
                continue
            if len(al) > most:
                for i in range(0, len(al), most // 2):
                    todo.append((depth, *(x[i : i + most // 2] for x in (al, ah, bl, bh, diff))))
                continue
            if depth not in ones:
                bit = (self.prints[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
                if len(ones) > 8:  # depths come mostly in order
                    ones.clear()
                ones[depth] = np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32)
            count = ones[depth]
            am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
            own = al == bl
            one = int(depth < 64 * self.counted)
            parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + one), (am[~own], ah[~own], bl[~own], bm[~own], diff[~own] + one)]
            al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts))
            keep = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
            todo.append((depth + 1, *(x[keep] for x in (al, ah, bl, bh, diff))))

    def pairs(self, label: np.ndarray, budget: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of one bucket within the budget whose given labels differ."""
        self.label = np.unique(label[self.order], return_inverse=True)[1]
        for a, b in self._leaves(budget, most):
            keep = self._near(a, b, budget) & (self.label[a] != self.label[b])
            if keep.any():
                yield self.order[a[keep]], self.order[b[keep]]

    def join(self, budget: int, most: int = 1 << 16) -> np.ndarray:
        """For each row given, a row of the same bucket that it's linked to, directly or not: the same for a class."""
        lo, hi = self.edges[:-1], self.edges[1:]
        many = hi - lo > 1
        for pivot in (lo[many], (lo[many] + hi[many]) // 2, hi[many] - 1):  # joins most of a dense bucket at once
            size = (hi - lo)[many]
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo[many], size)
            self._close(np.repeat(pivot, size), member, budget)
        for a, b in self._leaves(budget, most):
            self._close(a, b, budget)
        found = np.empty(len(self.order), np.int64)
        found[self.order] = self.order[self.label]
        return found


def _parts(mask: int, bits: int, parts: int) -> list[int]:
    """Splits the bits outside of mask into parts: the masks with each part added."""
    free = [i for i in range(bits) if not mask >> i & 1]
    cut = [free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts)]
    return [mask | sum(1 << i for i in c) for c in cut if c]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(prints: DataFrame, budget: int, bucket_rows: int) -> DataFrame:
    """Buckets of 64-bit fingerprints: columns mask, fp, rep."""
    level = {m: _parts(m, 64, budget + 1) for m in [0]}
    rows = prints.withColumn("mask", F.lit(0).cast("long"))
    done = None
    while True:
        finer = F.create_map(*[x for m, to in level.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(t)).cast("long") for t in to]))])
        rows = rows.withColumn("mask", F.explode(finer[F.col("mask")]))
        key = [F.col("mask"), F.col("fp").bitwiseAND(F.col("mask")).alias("value")]
        masks = {t for to in level.values() for t in to}
        hot = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("mask", "value"))
        if all(m.bit_count() > 56 for m in masks) or hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        cold = rows.join(hot, ["mask", "value"], "left_anti").drop("value")
        done = cold if done is None else done.unionByName(cold)
        rows = rows.join(hot, ["mask", "value"], "left_semi").drop("value")
        level = {m: _parts(m, 64, budget + 1) for m in masks}


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str], rows_at_once: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by bucket, some whole buckets at a time."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({x: batch[x].to_numpy() for x in names})
        n += batch.num_rows
        if n < rows_at_once:
            continue
        all_of = {x: np.concatenate([h[x] for h in held]) for x in names}
        bucket = all_of["bucket"]
        cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
        if cut:
            yield {x: v[:cut] for x, v in all_of.items()}
        held, n = [{x: v[cut:] for x, v in all_of.items()}], len(bucket) - cut
    if n:
        yield {x: np.concatenate([h[x] for h in held]) for x in names}


def _prints(rows: dict[str, np.ndarray], names: list[str]) -> np.ndarray:
    return np.stack([rows[x] for x in names], axis=1).view(np.uint64)


def _joined(dealt: DataFrame, words: int, budget: int, rows_at_once: int = 50_000) -> DataFrame:
    """Trie self-joins of buckets (columns bucket, fp0.., rep): links a, b between representatives, fewer than rows."""
    names = [f"fp{i}" for i in range(words)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches, ["bucket", *names, "rep"], rows_at_once):
            root = Forest(rows["bucket"], _prints(rows, names)).join(budget)
            other = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(rows["rep"][other]), pa.array(rows["rep"][root[other]])], names=["a", "b"])

    return dealt.select("bucket", *names, "rep").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(solve, "a bigint, b bigint")


def near_links(prints: DataFrame, budget: int = 3, bucket_rows: int = 100_000) -> DataFrame:
    """Links a, b between the rep of distinct fingerprints fp (longs) with at most `budget` differing bits.

    A spanning set: its components are those of all such pairs, and it has fewer rows than a bucket has members.
    """
    dealt = _dealt(prints, budget, bucket_rows).select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), F.col("fp").alias("fp0"), "rep")
    return _joined(dealt, 1, budget)


def _banded(prints: DataFrame, words: int, bands: int, band_bits: int, *more: str) -> DataFrame:
    """Rows of wide fingerprints (fp, an array of longs) by bucket: columns bucket, fp0.. and those of `more`.

    Buckets are the values of `bands` seeded choices of `band_bits` bits, which finds a pair that differs in a share p
    of its bits with chance 1 - (1 - (1-p)^band_bits)^bands.
    """
    draw = np.random.default_rng(SEED)
    chosen = [np.bincount(draw.choice(64 * words, band_bits, replace=False), minlength=64 * words).reshape(words, 64) for _ in range(bands)]
    masks = [[_signed(int(np.packbits(w.astype(np.uint8)).view(">u8")[0])) for w in c] for c in chosen]
    keys = [F.xxhash64(F.lit(i), *[F.col("fp")[k].bitwiseAND(F.lit(m).cast("long")) for k, m in enumerate(c) if m]) for i, c in enumerate(masks)]
    return prints.select(F.explode(F.array(*keys)).alias("bucket"), *[F.col("fp")[k].alias(f"fp{k}") for k in range(words)], *more)


_PAIR = "a bigint, a_set bigint, b bigint, b_set bigint"


def _pair_batch(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[x][i]) for i in (a, b) for x in ("rep", "set")], names=["a", "a_set", "b", "b_set"])


def _stars(dealt: DataFrame, words: int, budget: int, rows_at_once: int = 50_000) -> DataFrame:
    """Of buckets (bucket, fp0.., set, rep), each row with one row of its class of close ones."""
    names = [*(f"fp{i}" for i in range(words)), "set"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches, ["bucket", *names, "rep"], rows_at_once):
            root = Forest(rows["bucket"], _prints(rows, names), words).join(budget)
            other = np.flatnonzero(root != np.arange(len(root)))
            yield _pair_batch(rows, other, root[other])

    return dealt.select("bucket", *names, "rep").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(solve, _PAIR).distinct()


class Sets:
    """Sets of shingles of some rows, to count what pairs of them share."""

    def __init__(self, shingles: pa.Array):
        self.size = shingles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        known, self.item = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
        self.mark = np.zeros(len(known), bool)

    def similar(self, a: int, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether row a shares that part of its set with each of rows b."""
        own = self.item[self.first[a] : self.first[a + 1]]
        self.mark[own] = True
        size = self.size[b]
        at = np.repeat(self.first[b] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.diff(np.r_[0, np.cumsum(self.mark[self.item[at]])][np.r_[0, np.cumsum(size)]])
        self.mark[own] = False
        either = len(own) + size - common
        return (common == either) | (common / np.maximum(either, 1) >= similarity)


def similar_pairs(prints: np.ndarray, label: np.ndarray, sets: Sets, words: int, budget: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of close fingerprints whose sets are similar, so many as join labels that they join: fewer than labels."""
    forest = Forest(np.zeros(len(label), np.int64), prints, words)
    now, found = np.unique(label, return_inverse=True)[1], []
    for a, b in forest.pairs(label, budget):
        less, more = np.minimum(sets.size[a], sets.size[b]), np.maximum(sets.size[a], sets.size[b])
        a, b = (x[less >= similarity * more - 1e-6] for x in (a, b))
        if not len(a):
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        edges = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)]
        for i, j in zip(edges[:-1], edges[1:]):
            one, others = int(a[i]), b[i:j]
            others = others[now[others] != now[one]]
            if not len(others):
                continue
            for other in others[sets.similar(one, others, similarity)].tolist():
                if now[other] != now[one]:
                    now[now == now[other]] = now[one]
                    found.append((one, other))
        forest.label = now[forest.order]
    return found


def _links_in_clusters(rows: DataFrame, words: int, budget: int, similarity: float) -> DataFrame:
    """Of clusters (bucket, fp, rep, label, shingles), links a, b that join labels; sets are compared where they are."""

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        prints = whole(t["fp"]).flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
        rep = t["rep"].to_numpy()
        pairs = similar_pairs(np.ascontiguousarray(prints), t["label"].to_numpy(), Sets(whole(t["shingles"])), words, budget, similarity)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})

    return rows.select("bucket", "fp", "rep", "label", "shingles").groupBy("bucket").applyInArrow(solve, "a bigint, b bigint")


def _with_shingles(links: DataFrame, sets: DataFrame, side: str, at_once: int = 1000) -> DataFrame:
    """links with the shingles of one side; a set of many links is joined in as many copies as `at_once` goes into them."""
    share = links.groupBy(f"{side}_set").agg(F.floor(F.count("*") / at_once).alias("more"))
    copies = sets.join(share, F.col("set") == F.col(f"{side}_set")).select(f"{side}_set", "more", F.explode(F.sequence(F.lit(0).cast("long"), "more")).alias("copy"), F.col("shingles").alias(f"{side}_shingles"))
    other = "b_set" if side == "a" else "a_set"
    dealt = links.join(share, f"{side}_set").withColumn("copy", F.pmod(F.xxhash64(other), F.col("more") + 1)).drop("more")
    return dealt.join(copies.drop("more"), [f"{side}_set", "copy"]).drop("copy")


def _verified(links: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of links, those whose texts share `similarity` of their distinct shingles: columns a, b.

    docs has set and _text for each end of a link.
    """
    sets = written(docs.select("set", shingles(F.col("_text"), shingle).alias("shingles")).groupBy("set").agg(F.first("shingles").alias("shingles")))
    both = _with_shingles(_with_shingles(links, sets, "a"), sets, "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    either = F.size("a_shingles") + F.size("b_shingles") - common
    return both.where((common == either) | (common / either >= similarity)).select("a", "b")


def _in_blocks(rows: DataFrame, hot: DataFrame, bucket_rows: int) -> DataFrame:
    """Buckets of hot (bucket, n) cut into blocks that don't meet, other ones in other buckets."""
    blocks = F.ceil(2 * F.col("n_hot") / bucket_rows)
    block = F.pmod(F.xxhash64("bucket", "set"), blocks)
    found = rows.join(hot.withColumnRenamed("n", "n_hot"), "bucket", "left")
    return found.withColumn("bucket", F.when(F.col("n_hot").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", block))).drop("n_hot")


def _meeting(rows: DataFrame, hot: DataFrame, bucket_rows: int) -> DataFrame:
    """Buckets of hot cut so that rows of different labels still meet: the largest label's rows meet all others only.

    Both the largest label and the rest are cut into blocks of half of bucket_rows; a row goes to each meeting of its block
    (rows of the largest label to those with the rest's, others also to those of the rest's blocks with each other).
    """
    each = rows.join(hot.select("bucket"), "bucket", "left_semi").groupBy("bucket", "label").agg(F.count("*").alias("n"))
    most = each.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"))
    most = written(most.select("bucket", F.col("m.label").alias("main"), F.ceil(2 * F.col("m.n") / bucket_rows).alias("mains"), F.ceil(2 * (F.col("n") - F.col("m.n")) / bucket_rows).alias("rests")))
    found = rows.join(most, "bucket", "left")
    is_main = F.col("label") == F.col("main")
    block = F.pmod(F.xxhash64("bucket", "set"), F.when(is_main, F.col("mains")).otherwise(F.col("rests")))
    found = found.withColumn("block", F.when(F.col("main").isNotNull(), block))
    span = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda i: i < F.col(n))
    with_main = lambda i, j: F.xxhash64("bucket", F.lit("main"), i, j)
    with_rest = F.transform(span("rests"), lambda j: F.xxhash64("bucket", F.lit("rest"), F.least("block", j), F.greatest("block", j)))
    of_main = F.transform(span("rests"), lambda j: with_main(F.col("block"), j))
    of_rest = F.concat(F.transform(span("mains"), lambda i: with_main(i, F.col("block"))), with_rest)
    to = F.when(F.col("main").isNull(), F.array("bucket")).when(is_main, of_main).otherwise(of_rest)
    return found.withColumn("bucket", F.explode(to)).drop("main", "mains", "rests", "block")


#: Sets of at most so many shingles (texts of up to 13 words of five-word ones) are met exactly: two of them that share 0.8
#: of their shingles differ by one that one of them has beyond the other, or by one each.
SMALL, SMALL_SIMILARITY = 9, 0.8


def small_links(sets: DataFrame, similarity: float = SMALL_SIMILARITY) -> DataFrame:
    """Links a, b between reps of sets (rep, shingles: distinct, sorted, at most SMALL) that share `similarity` of their shingles.

    A spanning set of all such pairs, for a similarity of 0.8 or more.  Each set meets others under itself and under itself
    without each one of its shingles.  What meets under a key differs from it by at most one shingle, so where the key has
    k of them, all that meet share k of k + 2 or more: where that is enough they are linked to the smallest rep, else to
    those that are the key itself.  So links are fewer than ten times the sets.  Sets that are equal are linked, too.
    """
    if similarity < SMALL_SIMILARITY:
        raise ValueError("small_links: sets below a similarity of 0.8 may differ by more than a shingle")
    without = F.transform("shingles", lambda x, i: F.struct(F.array_remove("shingles", x).alias("key"), F.lit(1).alias("out")))
    keys = F.concat(F.array(F.struct(F.col("shingles").alias("key"), F.lit(0).alias("out"))), without)
    met = sets.where(F.size("shingles").between(1, SMALL)).select("rep", F.explode(keys).alias("k")).select("rep", "k.key", "k.out")
    k = F.size("key")
    met = met.where((F.col("out") == 0) | (k >= similarity * (k + 1)))
    hub = F.when(k >= similarity * (k + 2), F.min("rep")).otherwise(F.min(F.when(F.col("out") == 0, F.col("rep"))))
    hubs = met.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1").drop("n")
    return met.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, words: int, budget: int, bands: int, band_bits: int, bucket_rows: int = 50_000, cluster_rows: int = 1000) -> DataFrame:
    """Links a, b between nodes (fp, set, n, rep, id, text_hash) that share `similarity` of their distinct shingles.

    Their components are those of all such pairs that fingerprints propose, and of all pairs of at most SMALL shingles (with
    a similarity of 0.8 or more), which small_links finds: fingerprints of so few shingles vary too much.  First each node is checked against one of its
    class in every bucket, which joins most of what belongs together.  What fingerprints propose makes clusters; in those
    whose nodes these links leave apart, the nodes' sets of shingles are compared where they are, and only links that join
    something leave the task: no pairs are written.  Buckets of over bucket_rows nodes are cut into blocks, and count as
    one cluster; clusters of over cluster_rows are cut so that all nodes left apart still meet.  docs has _id, _hash, _text,
    and rep numbers the nodes.
    """

    def texts_of(sets: DataFrame) -> DataFrame:
        at = nodes.join(sets, "set", "left_semi").select("set", "id", "text_hash")
        return docs.join(at, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))).select("set", "_text")

    rows = _banded(nodes, words, bands, band_bits, "set", "rep")
    hot = written(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where(F.col("n") > bucket_rows))
    none = hot.isEmpty()
    stars = written(_stars(rows if none else _in_blocks(rows, hot.drop("first"), bucket_rows), words, budget))
    ends = stars.select(F.col("a_set").alias("set")).union(stars.select("b_set")).distinct()
    good = _verified(stars, texts_of(ends), shingle, similarity)
    few = nodes.where(F.col("n").between(1, SMALL))
    if similarity >= SMALL_SIMILARITY and not few.isEmpty():
        short = texts_of(few.select("set")).select("set", shingles(F.col("_text"), shingle).alias("shingles"))
        short = short.groupBy("set").agg(F.first("shingles").alias("shingles"))
        good = good.unionByName(small_links(few.select("set", "rep").join(short, "set")))
    good = written(good)
    label = components(good)
    proposed = stars.select("a", "b")
    if not none:
        proposed = proposed.unionByName(rows.join(hot, "bucket").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct())
    cluster = components(proposed).select(F.col("node").alias("rep"), F.col("component").alias("bucket"))
    labelled = nodes.join(cluster, "rep").join(label, F.col("rep") == F.col("node"), "left").select("rep", "fp", "set", "bucket", F.coalesce("component", "rep").alias("label"))
    labelled = written(labelled)
    apart = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("bucket", "n")
    apart = written(apart)
    left = written(labelled.join(apart, "bucket", "left_semi"))
    sets = texts_of(left.select("set").distinct()).select("set", shingles(F.col("_text"), shingle).alias("shingles"))
    sets = written(sets.groupBy("set").agg(F.first("shingles").alias("shingles")))
    large = apart.where(F.col("n") > cluster_rows)
    cut = left if large.isEmpty() else _meeting(left, large, cluster_rows)
    return good.unionByName(_links_in_clusters(cut.join(sets, "set"), words, budget, similarity))


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 3, words: int = 1, bands: int = 0, band_bits: int = 0, similarity: float | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of docs: doc_id, text_hash (xxhash64 of the text), fp (array of longs), component_id.

    component_id is the smallest doc_id reachable over links between fingerprints within the budget, itself included.
    Every such link is found.  Rows whose id is null get the component of their
    fingerprint (null if no row of it has an id) and make no links of their own.  Texts without words share fingerprint
    zero and so one component.  With a similarity and bands (and only then words may be more than one), links are those of close fingerprints of distinct shingles
    whose texts share that part of these, and fp ends with a hash of the set of shingles and its size.
    """
    if similarity is not None:
        return _similar_components(docs, shingle, budget, words, bands, band_bits, similarity, text, doc_id).drop("component_hash")
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprint(F.coalesce(F.col(text), F.lit("")), shingle, words).alias("fp")))
    kinds = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    ends = kinds.where("rep is not null")
    links = near_links(ends.select(F.col("fp")[0].alias("fp"), "rep"), budget)
    found = components(links)
    named = kinds.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("kind"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("kind")).select("doc_id", "text_hash", "fp", "component_id")


def _similar_components(docs: DataFrame, shingle: int, budget: int, words: int, bands: int, band_bits: int, similarity: float, text: str, doc_id: str) -> DataFrame:
    """As simhash_components, with component_hash: the text_hash of the row that component_id names.

    A row is named by its id and text, so rows that share an id are apart; null ids come last.
    """
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), set_fingerprint(F.coalesce(F.col(text), F.lit("")), shingle, words).alias("fp")))
    named = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kinds = prints.groupBy("fp").agg(F.min(named).alias("k"))
    kinds = written(kinds.withColumn("rep", F.monotonically_increasing_id()))
    nodes = kinds.select("fp", F.col("fp")[words].alias("set"), F.col("fp")[words + 1].alias("n"), "rep", F.col("k.doc_id").alias("id"), "k.text_hash")
    texts = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = components(similar_links(texts, nodes, shingle, similarity, words, budget, bands, band_bits))
    classed = written(kinds.join(found, F.col("rep") == F.col("node"), "left").select("fp", "k", F.coalesce("component", "rep").alias("class")))
    least = classed.groupBy("class").agg(F.min("k").alias("least"))
    of = classed.join(least, "class").select(F.col("fp").alias("kind"), F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("component_hash"))
    return prints.join(of, F.col("fp") == F.col("kind")).drop("kind")


#: For texts that share 0.8 or more of their five-word shingles: 256 bits, of which such texts differ in 39 (the angle of
#: their sets of shingles, arccos(2J / (1 + J)) / pi) with a deviation of 6; unrelated texts differ in 128.  A budget of 58
#: is three deviations more, and a pair of 39 differing bits is met with a chance of 0.99 in one of 64 choices of 16 bits.
NEAR = {"shingle": 5, "words": 4, "budget": 58, "bands": 64, "band_bits": 16, "similarity": 0.8}


def _one_each(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows that agree in some columns, the one that comes first when written as JSON."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(c).alias(f"{c}_") for c in by]).agg(F.min_by(whole, F.to_json(whole)).alias("row_")).select("row_.*")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id, once if it's repeated.

    how: parameters of simhash_components other than NEAR's.  Of rows that share an id, each counts by its own text, and
    of the smallest id's the one of the smallest text hash stays (of rows alike in both, the first when written as JSON).  Rows without an id take part, after all others.  Null
    and empty texts are one group; an empty table gives none.  All columns pass through.
    """
    found = _similar_components(docs, **(NEAR | how), text=text, doc_id=doc_id)
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash")))
    own, hashed, times = (fresh(docs, n) for n in ("id_of", "hash_of", "times_of"))
    keys = written(found.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).agg(F.count("*").alias(times)))
    kept = docs.join(keys, F.col(doc_id).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(hashed)))
    once = kept.where(F.col(times) == 1)
    if not keys.where(F.col(times) > 1).isEmpty():
        once = once.unionByName(_one_each(kept.where(F.col(times) > 1), own, hashed))
    return once.drop(own, hashed, times)
