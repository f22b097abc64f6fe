"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of `tile` words are joined on these seeds.  For each pair, the longest
common runs of words that don't overlap earlier ones are marked again and again, found by running Karp-Rabin hashes
with shrinking windows.  The share of the item's words under tiles tells how much of it the document gives away, in
whatever order its parts come.

Words are runs of ASCII letters, digits and non-ASCII characters of lower-cased texts, and equal if their 64-bit hashes
are.  An item of fewer than `tile` words needs a run of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import fresh, mixed, powers, spans, text_bytes, word_hashes, written

#: The window that tiling starts with.
SEARCH = 20
_BITS_A_SEED, _MOST_BITS = 1024, 1 << 28


def prefix_sums(words: np.ndarray) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum(words * powers(len(words))[0], dtype=np.uint64)]


def run_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `length` words."""
    n = len(sums) - length
    return (sums[length:] - sums[:n]) * powers(max(n, 1))[1][:n] if n > 0 else np.zeros(0, np.uint64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles as (first word in doc, first word in item, length), longest first.

    Always the longest run of free words is marked next; of equally long ones the first in doc, then in item.
    """
    least = max(1, min(least, len(item)))
    free_d, free_i, found = np.ones(len(doc), bool), np.ones(len(item), bool), []
    sums_d, sums_i = prefix_sums(doc), prefix_sums(item)

    def matches(length: int) -> list[tuple[int, int, int]]:
        hd, hi = run_hashes(sums_d, length), run_hashes(sums_i, length)
        full_d, full_i = (np.flatnonzero(np.convolve(~f, np.ones(length, int))[length - 1 : len(f)] == 0) if len(f) >= length else [] for f in (free_d, free_i))
        where: dict[int, list[int]] = {}
        for j in full_i:
            where.setdefault(int(hi[j]), []).append(int(j))
        if not where:
            return []
        hits = full_d[np.isin(hd[full_d], np.fromiter(where, np.uint64, len(where)))] if len(full_d) else []
        out = []
        for i in map(int, hits):
            for j in where[int(hd[i])]:
                if i and j and free_d[i - 1] and free_i[j - 1] and doc[i - 1] == item[j - 1]:
                    continue  # part of a longer match
                most = min(len(doc) - i, len(item) - j)
                ends = np.flatnonzero((doc[i : i + most] != item[j : j + most]) | ~free_d[i : i + most] | ~free_i[j : j + most])
                n = int(ends[0]) if len(ends) else most
                if n >= length:
                    out.append((i, j, n))
        return sorted(out, key=lambda m: (-m[2], m[0], m[1]))

    length = max(least, min(SEARCH, len(item)))
    while len(doc) >= least and free_i.any():
        now = matches(length)
        if now and now[0][2] > 2 * length:
            length = now[0][2]
            continue
        heap = [(-n, i, j) for i, j, n in now]
        heapify(heap)
        while heap:
            n, i, j = heappop(heap)
            free = free_d[i : i - n] & free_i[j : j - n]
            if free.all():
                free_d[i : i - n] = free_i[j : j - n] = False
                found.append((i, j, -n))
                continue
            # what an earlier tile leaves of it waits for its turn among the others
            edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= length:
                    heappush(heap, (a - b, i + a, j + a))
        if not now:
            if length == least:
                break
            length = max(least, length // 2)
    return sorted(found, key=lambda m: (-m[2], m[0], m[1]))


def seeds(data: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of each length within a text, and their texts; and each text's number of words."""
    words, owner, _ = word_hashes(data, offsets)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    sums, hashes, texts = prefix_sums(words), [], []
    for n in lengths:
        h = run_hashes(sums, n)
        own = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
        hashes.append(mixed(h[own] + np.uint64(n)))
        texts.append(owner[: len(h)][own])
    return np.concatenate(hashes), np.concatenate(texts), count


def benchmark_seeds(items: DataFrame, tile: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows item_id, seed, times (in the item), n_words, length (of the run)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            _, _, count = seeds(data, offsets, [tile])
            rows = []
            for length in sorted({min(tile, int(n)) for n in count if n}):
                h, owner, _ = seeds(data, offsets, [length])
                keep = np.minimum(count, tile)[owner] == length
                rows.append((owner[keep], h[keep], np.full(keep.sum(), length)))
            owner, h, length = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(count[owner].astype(np.int64)), pa.array(length.astype(np.int64))], names=["item_id", "seed", "n_words", "length"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")
    found = rows.mapInArrow(of, f"item_id {rows.schema['item_id'].dataType.simpleString()}, seed bigint, n_words bigint, length bigint")
    return found.groupBy("item_id", "seed", "n_words", "length").agg(F.count("*").alias("times"))


def seed_filter(found: DataFrame) -> np.ndarray:
    """A Bloom filter over the seeds: 1024 bits a seed, 32 MB at most; with more seeds it lets more through, never less."""
    n = found.count()
    bits = min(_MOST_BITS, 1 << max(16, (n * _BITS_A_SEED).bit_length()))
    place = lambda shift: F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(bits - 1))
    at = found.select(F.explode(F.array(place(0), place(32))).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for rows in words.toLocalIterator():
        out[rows["word"]] = rows["bits"]
    return out.view(np.uint64)


def passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bloom) * 64 - 1)
    ok = np.ones(len(h), bool)
    for shift in (0, 32):
        bit = (h >> np.uint64(shift)) & mask
        ok &= ((bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def candidates(docs: DataFrame, bloom, lengths: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that have a seed of the filter: doc_id, text_hash, text (lower-cased), seeds (each once)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for a, b in spans(offsets, 1 << 18):
                h, owner, _ = seeds(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lengths)
                hit = passes(known, h)
                if not hit.any():
                    continue
                pairs = np.unique(np.rec.fromarrays([owner[hit], h[hit]], names="o,h"))
                rows, first = np.unique(pairs.o, return_index=True)
                found = pa.ListArray.from_arrays(np.r_[first, len(pairs)].astype(np.int32), np.ascontiguousarray(pairs.h).view(np.int64))
                at = pa.array(rows + a)
                yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in kept), found], names=[*kept, "seeds"])

    kept = ["doc_id", "text_hash", "text"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.lower(text).alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, text string, seeds array<bigint>")


def tiled(pairs: DataFrame, tile: int) -> DataFrame:
    """Tiles of the pairs' text and item_text: all columns but these, with n_words, covered and tiles."""
    kept = [f for f in pairs.schema if f.name not in ("text", "item_text")]

    def words(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return word_hashes(data, np.array([0, len(data)]))[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            found, n = [], []
            for text, item in zip(batch["text"], batch["item_text"]):
                item = words(item.as_py())
                n.append(len(item))
                found.append([dict(zip(("doc_start", "item_start", "length"), t)) for t in tiles(words(text.as_py()), item, tile)])
            covered = [sum(t["length"] for t in f) for f in found]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(found, kind)], names=[*(f.name for f in kept), "n_words", "covered", "tiles"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_words bigint, covered bigint, tiles array<struct<doc_start:bigint,item_start:bigint,length:bigint>>"
    return pairs.mapInArrow(of, schema)


def seeded(some: DataFrame, known: DataFrame, enough: Column) -> DataFrame:
    """Pairs row, item that share `enough` runs or more, counted as often as the item has them.

    An item is joined on its rarer runs only: its commonest, of fewer than `enough` occurrences in all, are left out, as a
    pair that shares enough has one of the others too.  So a run that many documents and items have in common brings pairs
    together only where nothing rarer can.  All runs of these pairs then count.
    """
    seen = some.select("row", F.explode("seeds").alias("seed"))
    often = seen.groupBy("seed").agg(F.count("*").alias("often"))
    order = Window.partitionBy("item").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    met = written(known.join(often, "seed").withColumn("enough", enough).withColumn("so_far", F.sum("times").over(order)))
    pairs = seen.join(met.where("so_far >= enough").select("item", "seed"), "seed").select("row", "item").distinct()
    runs = met.groupBy("item").agg(F.first("enough").alias("enough"), F.collect_list(F.struct("seed", "times")).alias("runs"))
    both = pairs.join(some.select("row", "seeds"), "row").join(runs, "item")
    shared = F.aggregate(F.filter("runs", lambda r: F.array_contains("seeds", r["seed"])), F.lit(0).cast("long"), lambda n, r: n + r["times"])
    return both.where(shared >= F.col("enough")).select("row", "item")


def contamination(docs: DataFrame, items: DataFrame, tile: int = 5, coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of documents and items of which at least `coverage` of the item's words are tiled.

    Columns doc_id, text_hash (xxhash64 of the text, which with doc_id names the row), item_id, coverage, n_words,
    covered and tiles.  Ids are of any type that a join compares.  Null and empty texts and items with null ids match nothing, an
    empty table on either side gives none; repeated rows of docs each give
    their rows, repeated items count once, and texts that share an item's id count each for itself.
    """
    items = items.select(F.col(item_id).alias("item_id"), F.lower(item_text).alias("text")).dropna().distinct().withColumn("item", F.xxhash64("item_id", "text"))
    known = written(benchmark_seeds(items, tile, "item").withColumnRenamed("item_id", "item"))
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # tile values at most
    bloom = docs.sparkSession.sparkContext.broadcast(seed_filter(known))
    some = written(candidates(docs, bloom, lengths or [tile], doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    enough = F.ceil(F.lit(coverage) * F.col("n_words") / F.col("length"))  # every tiled word lies in a shared run
    pairs = seeded(some, known, enough)
    both = pairs.join(some.select("row", "doc_id", "text_hash", "text"), "row").join(items.withColumnRenamed("text", "item_text"), "item")
    found = tiled(both.select("doc_id", "text_hash", "item_id", "text", "item_text"), tile)
    return found.withColumn("coverage", F.col("covered") / F.col("n_words")).where(F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, items: DataFrame, tile: int = 5, coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that contamination() names; all their columns pass through, repeated rows stay repeated."""
    own, hashed = (fresh(docs, n) for n in ("id_of", "hash_of"))
    bad = contamination(docs, items, tile, coverage, doc_id, text).select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct()
    return docs.join(written(bad), F.col(doc_id).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(hashed)), "left_anti")
