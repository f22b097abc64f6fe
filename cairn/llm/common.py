"""What several operators share: tables, column names, Arrow text and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.scratch import written  # noqa: F401  operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name for use within an operator that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, which so is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n+1 offsets, without making Python strings; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int):
    """Cuts documents into runs of about `most` bytes: pairs of document numbers."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of the hash's base and of its inverse."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 19, 1 << int(n).bit_length())
        have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        _powers[0] = have
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over all their bits (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased.

    Returns each word's 64-bit hash (a polynomial in its bytes, from prefix sums), its document and its start byte.
    With prefixes, lengths in bytes, hashes get a second axis: the word's and each prefix's, which shorter words share.
    """
    if not len(data):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate([[False], _WORD[data], [False]])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    starts[inner] |= inside[1:-1][inner]
    ends[inner - 1] |= inside[1:-1][inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    h = mixed((total[e] - total[s]) * down[s])
    if prefixes:
        h = np.stack([h, *(mixed((total[np.minimum(s + k, e)] - total[s]) * down[s] + np.uint64(k)) for k in prefixes)], axis=1)
    return h, np.searchsorted(offsets, s, "right") - 1, s
