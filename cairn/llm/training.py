"""Fits networks over words to all labelled rows of a table, however many: blocks of coded texts that tasks learn from.

Whole texts are coded once, into blocks of about BLOCK_BYTES: a block holds its distinct words and, text by text, which of
them follow each other.  In a round, the network learns from each block by itself; then what the blocks changed is averaged,
weighted by their rows, and an embedding's change over those blocks only that have it, so that rare words are learned as
frequent ones are.  Work is in proportion to the rows; a task holds one block at a time and one network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.cnn import TextCNN
from cairn.llm.common import spans, text_bytes, word_hashes, written

#: Blocks have about so many bytes of text and so many rows.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 8192
#: Embeddings that are averaged together.
CHUNK = 1024
BLOCK = "learn boolean, n int, y binary, lang array<string>, sizes binary, words binary, places binary"


def labelled_rows(docs: DataFrame, labelled: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, y (0 or 1), lang, pick and bytes of all labelled rows with a text, written.

    labelled has columns id, label (1: class 1) and lang.  Rows with a null label, text or id take no part; an id counts
    once, with its smallest label and language.  pick, from 0 to 1, is a hash of the id to split the rows by.
    """
    rows = labelled.select("id", F.col("label").cast("int").alias("label"), F.coalesce("lang", F.lit("")).alias("lang")).where("id is not null and label is not null")
    one = rows.groupBy("id").agg(F.min(F.struct("label", "lang")).alias("of"))
    sizes = docs.select(F.col(doc_id).alias("id"), F.octet_length(text).alias("bytes")).where("bytes is not null").groupBy("id").agg(F.max("bytes").cast("long").alias("bytes"))
    pick = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 40)) / (1 << 40)
    return written(one.join(sizes, "id").select("id", (F.col("of.label") > 0).cast("int").alias("y"), "of.lang", pick.alias("pick"), "bytes"))


def _coded(texts: list[str], y: list[int], langs: list[str], learn: bool, prefixes: tuple[int, ...], buckets: int) -> tuple:
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    each = [word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], prefixes)[:2] for a, b in spans(offsets, 1 << 18)]
    hashes = np.concatenate([h for h, _ in each])
    sizes = np.concatenate([np.bincount(o, minlength=b - a) for (_, o), (a, b) in zip(each, spans(offsets, 1 << 18))]).astype(np.int32)
    _, first, place, n = np.unique(hashes[:, 0], return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # frequent words have small numbers, which pack well
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = rank[place].astype(np.uint16 if len(order) <= 1 << 16 else np.uint32)
    words = (hashes[first[order]] % np.uint64(buckets)).astype(np.int32)
    pack = zstandard.ZstdCompressor(level=3).compress
    return learn, len(texts), np.array(y, np.int8).tobytes(), langs, sizes.tobytes(), pack(words.tobytes()), pack(places.tobytes())


def pieces(total: int, n: int) -> int:
    """How many blocks rows of so many bytes are cut into."""
    return max(1, -(-total // BLOCK_BYTES), -(-n // BLOCK_ROWS))


def blocks(docs: DataFrame, rows: DataFrame, share: float, total: int, n: int, prefixes: tuple[int, ...], buckets: int, text: str, doc_id: str) -> DataFrame:
    """All rows, their whole lower-cased texts coded; written.  learn: whether their pick is less than `share`.

    total and n: bytes and number of rows.  They set how many blocks there are, so blocks depend on the data alone.
    """
    parts = pieces(total, n)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").repartition(parts, "id")
    both = texts.join(rows.select("id", "y", "lang", (F.col("pick") < share).alias("learn")).repartition(parts, "id"), "id")
    one = both.groupBy("id", "y", "lang", "learn").agg(F.min_by("t", F.xxhash64("t")).alias("t")).sortWithinPartitions("id")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("learn", pa.bool_()), ("n", pa.int32()), ("y", pa.binary()), ("lang", pa.list_(pa.string())), ("sizes", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])
        made = lambda part, learn: pa.RecordBatch.from_pylist([dict(zip(schema.names, _coded(*part, learn, prefixes, buckets)))], schema)
        open_, size = {True: ([], [], []), False: ([], [], [])}, {True: 0, False: 0}
        for batch in batches:
            for learn, t, y, lang in zip(*(batch.column(c).to_pylist() for c in ("learn", "t", "y", "lang"))):
                for whole, x in zip(open_[learn], (t, y, lang)):
                    whole.append(x)
                size[learn] += len(t)
                if size[learn] > 4 * BLOCK_BYTES:  # far more than its share: hashes of ids don't deal so, long texts may
                    yield made(open_[learn], learn)
                    open_[learn], size[learn] = ([], [], []), 0
        for learn, part in open_.items():
            if part[0]:
                yield made(part, learn)

    return written(one.select("learn", F.lower("t").alias("t"), "y", "lang").mapInArrow(code, BLOCK))


class Block:
    """A coded block: distinct words (their buckets and those of their prefixes) and each text's words, by number."""

    def __init__(self, row: dict, width: int):
        plain = lambda x, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(x) if x else b"", kind)
        self.y, self.lang = np.frombuffer(row["y"], np.int8).astype(np.int64), row["lang"]
        self.words = plain(row["words"], np.int32).reshape(-1, width)
        self.places = plain(row["places"], np.uint16 if len(self.words) <= 1 << 16 else np.uint32)
        self.ends = np.r_[0, np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)]

    def texts(self) -> list[np.ndarray]:
        return [self.places[a:b] for a, b in zip(self.ends[:-1], self.ends[1:])]


def read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0], width)


def bucket_counts(coded: DataFrame, width: int, buckets: int, least: int) -> pd.DataFrame:
    """Of each bucket that `least` texts or more have: the texts of class 1 and 0 (bad, good), and whether a whole word is in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, whole = np.zeros((2, buckets), np.int64), np.zeros(buckets, bool)
        for block in read(batches, width):
            whole[block.words[:, 0]] = True
            for y, p in zip(block.y, block.texts()):
                found[y, np.unique(block.words[np.unique(p)])] += 1
        some = np.flatnonzero(found.any(axis=0))
        for i in range(0, len(some), 1 << 16):
            at = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[1, at]), pa.array(found[0, at]), pa.array(whole[at])], names=["bucket", "bad", "good", "whole"])

    each = coded.mapInArrow(count, "bucket long, bad long, good long, whole boolean")
    summed = each.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("whole").alias("whole"))
    return summed.where(F.col("bad") + F.col("good") >= least).toArrow().to_pandas().sort_values("bucket", ignore_index=True)


def numbered(known: np.ndarray, buckets: int) -> np.ndarray:
    """Each bucket's symbol: its place among those known, from 1 on; 0 for others."""
    found = np.zeros(buckets, np.int32)
    found[known] = np.arange(1, len(known) + 1)
    return found


def _copy(net: TextCNN, mine: np.ndarray) -> TextCNN:
    return TextCNN(net.emb[mine], {w: (f.copy(), b.copy()) for w, (f, b) in net.filters.items()}, net.out.copy(), net.bias.copy(), net.classes)


def _rest(net: TextCNN) -> np.ndarray:
    """All parameters but the embeddings, in a row."""
    return np.concatenate([p.ravel() for p in net.params()[1:]]).astype(np.float64)


def trained(coded: DataFrame, width: int, net: TextCNN, known: np.ndarray, buckets: int, weights: np.ndarray, rounds: int, epochs: int, batch: int = 32, rate: float = 0.003, decay: float = 1e-5) -> TextCNN:
    """net, fitted to all blocks in so many rounds, in each of which a block's rows are gone through `epochs` times.

    known: the buckets of the network's symbols, from 1 on; weights: those of both classes.  Blocks are dealt to tasks as
    Spark likes; the result is the same, but for the rounding of sums.
    """
    for k in range(rounds):
        rates = [rate * (1 - 0.9 * (k * epochs + i) / (rounds * epochs)) for i in range(epochs)]
        net = _round(coded, width, net, known, buckets, weights, batch, rates, decay, 11 + k * epochs)
    return net


def _round(coded: DataFrame, width: int, net: TextCNN, known: np.ndarray, buckets: int, weights: np.ndarray, batch: int, rates: list[float], decay: float, seed: int) -> TextCNN:
    pad, (n, size), others = max(net.filters) - 1, net.emb.shape, len(_rest(net))
    sent = coded.sparkSession.sparkContext.broadcast((net, known.astype(np.int32)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, known = sent.value
        symbol = numbered(known, buckets)
        total, rest, rows = np.zeros((n, size + 1), np.float32), np.zeros(others + 1), 0
        for block in read(batches, width):
            names = symbol[block.words]
            mine = np.unique(np.r_[0, names.ravel()])
            table = np.searchsorted(mine, names).astype(np.int32)
            own, m = _copy(net, mine), len(block.y)
            seqs = [np.pad(table[p], ((pad, pad), (0, 0))) for p in block.texts()]
            for i, now in enumerate(rates):
                own.fit(seqs, block.y, weights[block.y], epochs=1, batch=batch, rate=now, decay=decay, seed=seed + i, lazy=True)
            total[mine, :-1] += m * (own.emb - net.emb[mine])
            total[mine, -1] += m
            rest += m * np.r_[_rest(own) - _rest(net), 1]
            rows += m
        if rows:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([-1], pa.int32()), "part": pa.array([rest.tobytes()], pa.binary())})
            for i in range(0, n, CHUNK):
                if total[i : i + CHUNK, -1].any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // CHUNK], pa.int32()), "part": pa.array([total[i : i + CHUNK].tobytes()], pa.binary())})

    def summed(of_one: pa.Table) -> pa.Table:
        chunk = of_one["chunk"][0].as_py()
        kind = np.float64 if chunk < 0 else np.float32
        part = sum(np.frombuffer(x.as_py(), kind).astype(np.float64) for x in of_one["part"])
        if chunk >= 0:  # rows of sums and their weight
            part = part.reshape(-1, size + 1)
            part = (part[:, :-1] / np.maximum(part[:, -1:], 1)).astype(np.float32)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    schema = "chunk int, part binary"
    parts = coded.mapInArrow(learn, schema).repartition(min(8, 1 + n // CHUNK), "chunk").groupBy("chunk").applyInArrow(summed, schema)
    found = {r.chunk: r.part for r in parts.collect()}
    sent.destroy()
    new = _copy(net, np.arange(n))
    change = np.frombuffer(found.pop(-1))
    first, change = 0, change[:-1] / change[-1]
    for p in new.params()[1:]:
        p += change[first : first + p.size].reshape(p.shape).astype(np.float32)
        first += p.size
    for chunk, part in found.items():
        part = np.frombuffer(part, np.float32).reshape(-1, size)
        new.emb[chunk * CHUNK : chunk * CHUNK + len(part)] += part
    new.emb[0] = 0
    return new
