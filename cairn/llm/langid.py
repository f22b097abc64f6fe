"""Language identification by a convolutional network over bytes.

The network reads windows of a fixed number of bytes: byte embeddings, filters of several widths, max pooling and
softmax.  A text's windows cover it whole; its prediction is the class of the largest summed log-probability, each
window weighted by the bytes of text in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cairn.llm.cnn import TextCNN, softmax
from cairn.llm.common import fresh, spans, text_bytes
from cairn.llm.sample import labelled_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Windows at a time: what they look up stays in the processor's cache.
BLOCK = 32
UNDETERMINED = "und"
#: A byte's symbol. Texts are lower-cased before.
SYMBOL = np.arange(1, 257, dtype=np.int32)


def windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of window symbols (0 past a text's end), each row's text and its number of bytes."""
    size = np.diff(offsets)
    n = -(-size // window)
    owner = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[owner] + nth * window
    used = np.minimum(size[owner] - nth * window, window)
    rows = np.zeros((len(owner), window), np.int32)
    at = np.arange(window)
    inside = at < used[:, None]
    rows[inside] = SYMBOL[data[(start[:, None] + at)[inside]]]
    return rows, owner, used


def fit(docs: DataFrame, allowed: Column, max_rows: int = 1000, epochs: int = 4, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> TextCNN | None:
    """Learns from all windows of the whole texts of at most max_rows rows where `allowed` holds; None if there are none.

    Short texts are learned from, too: each window is there whole, and once more with only its first 1 to WINDOW - 1 bytes.
    epochs: how often all of these are gone through.  max_rows bounds the rows of the sample in all, over all languages (see
    labelled_sample).  Null languages, texts and
    ids take no part.  Where the texts hold no bytes, the network knows nothing but how frequent the languages are.
    """
    sample = labelled_sample(docs, docs.where(allowed).select(F.col(doc_id).alias("id"), F.col(lang).alias("label")), max_rows, text, doc_id)
    if sample.empty:
        return None
    classes = sorted(sample.label.unique().tolist())
    data = [t.lower().encode() for t in sample.text]
    y = np.searchsorted(classes, sample.label.to_numpy())
    model = TextCNN.new(257, classes, 8, WIDTHS, FILTERS)
    each = [windows(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].astype(np.uint16) for x in data]
    rows = np.concatenate(each)
    if not len(rows):
        model.out[:], model.bias[:] = 0, np.log(np.bincount(y) / len(y))
        return model
    short = rows.copy()
    short[np.arange(WINDOW) >= np.random.default_rng(3).integers(1, WINDOW, len(rows))[:, None]] = 0
    y = np.repeat(y, [len(x) for x in each])
    weights = 1 / np.bincount(y, minlength=len(classes)).clip(1)[y]
    return model.fit(np.concatenate([rows, short]), np.r_[y, y], np.r_[weights, weights], epochs=epochs, rate=0.01, decay=1e-5)


class Scorer:
    """Applies the network by tables: a filter's response to a pair of bytes is looked up instead of computed."""

    def __init__(self, model: TextCNN):
        self.model = model
        one = {w: [model.emb @ f[j] for j in range(w)] for w, (f, _) in model.filters.items()}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, a.shape[1])
        self.tables = {w: [(j, pair(t[j], t[j + 1]) if j + 1 < w else t[j]) for j in range(0, w, 2)] for w, t in one.items()}

    def features(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1] * 257 + rows[:, 1:]
        found = []
        for w, tables in self.tables.items():
            n, y = rows.shape[1] - w + 1, None
            for j, t in tables:
                part = np.take(t, (pairs if len(t) > 257 else rows)[:, j : j + n], axis=0, mode="clip")
                y = part if y is None else np.add(y, part, out=y)
            while n > 4:  # halves at a time: long runs in memory
                half = -(-n // 2)
                y = np.maximum(y[:, :half], y[:, n - half : n])
                n = half
            found.append(y.max(axis=1) + self.model.filters[w][1])
        return np.maximum(np.concatenate(found, axis=1), 0)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class number and its probability, for each text."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.model.classes)))
        for a, b in spans(offsets, 1 << 17):
            rows, owner, used = windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(0, len(rows), BLOCK):
                logp = np.log(softmax(self.model.logits(self.features(rows[i : i + BLOCK])).astype(np.float64)) + 1e-9)
                np.add.at(total, owner[i : i + BLOCK] + a, logp * used[i : i + BLOCK, None])
        mean = softmax(total / np.maximum(np.diff(offsets), 1)[:, None])
        return total.argmax(axis=1), mean.max(axis=1)


def identify(text: Column, model: TextCNN | None) -> Column:
    """A struct of lang_pred and score (0 to 1, the probability of lang_pred) for whole texts.

    lang_pred is one of the learned values, or `und` with score 0 where the text is null or has no letter (or nothing
    was learned).
    """

    @arrow_udf("lang_pred string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Scorer(model)
        names = np.array(model.classes, object)
        for texts in batches:
            best, p = score(*text_bytes(texts))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(p)], names=["lang_pred", "score"])

    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return none
    return F.when(F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)), of(F.lower(text))).otherwise(none)


def with_language(docs: DataFrame, model: TextCNN | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    Each row has its own result: repeated rows are kept, of equally likely languages the first by name counts, an empty
    table gives none.  Columns lang_pred and score are replaced where docs has them, all others pass through.
    """
    lang = fresh(docs, "lang_of")
    return docs.withColumn(lang, identify(F.col(text), model)).withColumns({"lang_pred": F.col(lang)["lang_pred"], "score": F.col(lang)["score"]}).drop(lang)
