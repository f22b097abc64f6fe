"""Text quality by compression: texts that good examples help to compress are good.

Two zstandard dictionaries are trained, on good and on bad labelled texts.  A text is compressed with each, piece by
piece, so that long texts profit from the dictionary throughout; the difference of the two sizes, over the text's
own, is the evidence.  A logistic fit on labelled rows that the dictionaries haven't seen turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cairn.llm.calibration import logistic
from cairn.llm.common import text_bytes
from cairn.llm.sample import labelled_sample

PIECE = 2048
LEVEL = 3


@dataclass
class Quality:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    prior: float  # the score of texts without bytes


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary of at most `size` bytes.

    Texts too few to train on are the dictionary themselves; where they take more than `size`, pieces from all over them.
    """
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        step = max(1, -(-sum(map(len, pieces)) // size))
        return b"".join(pieces[::step])[:size]


class Sizer:
    """Compressed sizes of texts with a dictionary."""

    def __init__(self, data: bytes):
        known = zstandard.ZstdCompressionDict(data)
        if data:
            known.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known if data else None, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def __call__(self, text: memoryview) -> int:
        return sum(len(self.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


def evidence(model_good: bytes, model_bad: bytes, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(bad - good) / size, of compressed sizes and the text's own; 0 for empty texts."""
    good, bad, view = Sizer(model_good), Sizer(model_bad), memoryview(np.ascontiguousarray(data))
    found = np.zeros(len(offsets) - 1)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            found[i] = (bad(view[a:b]) - good(view[a:b])) / (b - a)
    return found


def fit(docs: DataFrame, labelled: DataFrame, max_rows: int = 3000, size: int = 64 << 10, text: str = "text", doc_id: str = "doc_id") -> Quality:
    """Learns from the whole texts of at most max_rows rows: half for the dictionaries, half to calibrate.

    labelled has columns id and label (1: good).  max_rows bounds the rows of the sample in all (see labelled_sample).
    Null labels, texts and ids take no part.  Without rows of both labels every score is the smoothed share of good rows,
    (good + 1) / (rows + 2), which is 0.5 without rows.
    """
    sample = labelled_sample(docs, labelled.select("id", F.col("label").cast("int").alias("label")), max_rows, text, doc_id)
    y = (sample.label.to_numpy() > 0).astype(int)
    texts = [t.encode() for t in sample.text]
    prior = (y.sum() + 1) / (len(y) + 2)
    train = sample["pick"].to_numpy() < 0.5
    if len(set(y[train])) < 2 or len(set(y[~train])) < 2:
        train[:] = True
    if len(set(y)) < 2:
        return Quality(b"", b"", 0.0, float(np.log(prior / (1 - prior))), float(prior))
    good, bad = (dictionary([t for t, k, u in zip(texts, y, train) if u and k == want], size) for want in (1, 0))
    held = ~train if not train.all() else train
    data = [t for t, u in zip(texts, held) if u]
    x = evidence(good, bad, np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(t) for t in data])].astype(np.int64))
    unit = x.std() or 1.0
    slope, shift = logistic(x / unit, y[held], prior=0.1)
    return Quality(good, bad, slope / unit, shift, float(prior))


def quality(text: Column, model: Quality) -> Column:
    """The probability, from 0 to 1, that whole texts are good; that of the labelled rows for null and empty texts."""

    @arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = text_bytes(texts)
            z = model.slope * evidence(model.good, model.bad, data, offsets) + model.shift
            yield pa.array(np.where(np.diff(offsets) > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), model.prior))

    return of(text)


def with_quality(docs: DataFrame, model: Quality, text: str = "text") -> DataFrame:
    """docs with score.

    Each row has its own result, so ties and repeated rows are kept; an empty table gives none.  A column score is
    replaced where docs has one, all others pass through.
    """
    return docs.withColumn("score", quality(F.col(text), model))
