"""Fill-in-middle: texts cut at two of their boundaries and put together anew, with the middle last.

The boundaries of a text, the byte offsets at which its units end, are a set of integers in containers, as of a Roaring
bitmap: offsets with the same high 16 bits share one, which is a sorted array, a bitmap or a list of runs, whichever is
smallest.  Cumulative cardinalities lead from an ordinal to its container, and a select within that one to the offset; so
both cuts are found without a list of units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cairn.llm.common import fresh

#: An array of more 16-bit values than this is larger than a bitmap of 2^16 bits.
ARRAY_MOST = 4096
#: The marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """2^16 bits as words of 64, with the number of bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[i])
        for _ in range(k - int(self.before[i])):
            word &= word - 1
        return 64 * i + (word & -word).bit_length() - 1


class RunContainer:
    """Runs of successive values: the first of each, and the number of values before it."""

    def __init__(self, low: np.ndarray):
        at = run_starts(low)
        self.first, self.before = low[at].astype(np.uint16), at

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[i]) + k - int(self.before[i])


def run_starts(low: np.ndarray) -> np.ndarray:
    """Where in sorted values a run of successive ones begins."""
    return np.flatnonzero(np.r_[True, low[1:] != low[:-1] + 1])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three for some sorted 16-bit values."""
    runs = len(run_starts(low))
    if 4 * runs < min(2 * len(low), 8192):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A set of offsets from sorted ones without repeats."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cut = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(offsets, cut) if len(offsets) else []
        self.high = [int(p[0]) >> 16 for p in parts]
        self.containers = [container(p & 0xFFFF) for p in parts]
        self.before = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset of ordinal k, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return (self.high[i] << 16) + self.containers[i].select(k - int(self.before[i]))


def _ends_of_lines(data: np.ndarray) -> np.ndarray:
    return data == 10


def _ends_of_words(data: np.ndarray) -> np.ndarray:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return space & ~np.r_[space[1:], False]


def _ends_of_characters(data: np.ndarray) -> np.ndarray:
    return np.r_[(data[1:] & 0xC0) != 0x80, True][: len(data)]


#: Units by name: of UTF-8 bytes, whether each is the last of a unit (the last byte of a text always is).
#: A line ends with its line feed, a word with the ASCII white space after it, a character with its code point.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": _ends_of_lines, "word": _ends_of_words, "character": _ends_of_characters}


def boundaries(text: bytes, unit: str) -> BoundarySet:
    """The offsets after each unit of a text."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(UNITS[unit](data)) + 1
    return BoundarySet(ends if not len(data) or len(ends) and ends[-1] == len(data) else np.r_[ends, len(data)])


def _chars(part: bytes) -> int:
    return int(((np.frombuffer(part, np.uint8) & 0xC0) != 0x80).sum())


def cut(text: bytes, h: tuple[int, int, int, int], unit: str, percent: int, spm_percent: int, marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, code points of prefix and middle (None if plain), and the text in its form.

    h are four random integers: two for the cuts, one for whether, one for which form.
    """
    ends = boundaries(text, unit)
    n = len(ends)
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    i, j = (ends.select(k - 1) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = marks
    spm = h[3] % 100 < spm_percent
    made = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", _chars(prefix), _chars(middle), made


def _checked(sentinels: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """Sentinels as bytes, if none of them can be met but where it was put."""
    p, s, m = (x.encode() for x in sentinels)
    within = any(a in b for a, b in permutations((p, s, m), 2))
    if within or any(a[-k:] == b[:k] for a, b in product((p, s, m), repeat=2) for k in range(1, min(len(a), len(b)))):
        raise ValueError(f"sentinels {sentinels} overlap")
    return p, s, m


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n_units, form (psm, spm or plain), prefix_chars, middle_chars (code points; null if plain) and fim, the text in its form.

    psm is prefix, suffix, middle, each behind its sentinel; spm is suffix, prefix, middle.  Cuts and forms follow from the
    SHA-256 of seed and id, so that re-runs and retries agree: `percent` of texts are cut, `spm_percent` of these as spm.
    Texts that are empty or hold a sentinel stay plain, so every other output reads back (`restored`).  A null text is an
    empty one; a null id counts as an empty one, rows that share an id share what is drawn for them, so repeated rows are
    alike; an empty table gives none.  Columns named as results are replaced, all others pass through.  Each row is
    done by itself, without any exchange; a text of any length is held once with its output.
    """
    marks = _checked(sentinels)
    if unit not in UNITS:
        raise ValueError(f"unit {unit}: one of {', '.join(UNITS)}")

    @arrow_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, fim binary")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *h in batches:
            for at in range(0, len(texts), 200):
                numbers = zip(*(x.slice(at, 200).to_pylist() for x in h))
                rows = [cut(t.as_py(), four, unit, percent, spm_percent, marks) for t, four in zip(texts.slice(at, 200), numbers)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()]
                yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["n", "form", "prefix_chars", "middle_chars", "fim"])

    drawn, made = fresh(docs, "drawn_of"), fresh(docs, "made_of")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    groups = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.withColumn(drawn, digest).withColumn(made, of(F.coalesce(F.col(text), F.lit("")).cast("binary"), *groups))
    found = {"n_units": F.col(made)["n"], "form": F.col(made)["form"], "prefix_chars": F.col(made)["prefix_chars"], "middle_chars": F.col(made)["middle_chars"], "fim": F.col(made)["fim"].cast("string")}
    return rows.withColumns(found).drop(drawn, made)


def restored(form: Column, fim: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that fill_in_middle put into a form."""
    _checked(sentinels)
    p, s, m = sentinels

    def between(a: str, b: str | None) -> Column:
        start = F.instr(fim, a) + len(a)
        return F.substr(fim, start, F.instr(fim, b) - start) if b else F.substr(fim, start)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(fim)
