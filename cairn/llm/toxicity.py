"""Toxicity by a convolutional network over words: hashed embeddings, filters of several widths, max pooling.

A word's embedding is the sum of those of the word and of its beginnings, so that inflected and compound forms are known.

Pooling runs over all words of a text, so one phrase anywhere in a long text counts in full.  Scores are calibrated
(a logistic fit on rows that the network wasn't fitted on); thresholds are calibrated for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cairn import scratch
from cairn.llm import training
from cairn.llm.calibration import best_thresholds, logistic_of
from cairn.llm.cnn import TextCNN
from cairn.llm.common import spans, text_bytes, word_hashes, written
from cairn.llm.sample import MOST_LABELS

#: Words are hashed into so many buckets, which bounds the network; unknown ones share a zero embedding.
BUCKETS = 1 << 19
#: Bytes of the beginnings of words that have embeddings of their own.
PREFIXES = (5, 7)
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 12
#: Symbols of a word.
WIDTH = 1 + len(PREFIXES)
#: The share of rows to learn from; the others calibrate.
LEARN = 0.8
#: Texts that make a bucket known.
LEAST = 3
#: A block's rows are gone through until they are about so many, but so often at least and at most; a few times a round.
ROWS, PASSES, ROUNDS = 20_000, (4, 12), 4


@dataclass
class Toxicity:
    net: TextCNN | None  # None: only one class was there to learn from
    known: np.ndarray  # the buckets that have an embedding, from symbol 1 on
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # by language


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def symbols(known: np.ndarray) -> np.ndarray:
    """Each bucket's symbol."""
    return training.numbered(known, BUCKETS)


def responses(net: TextCNN, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Features of n texts: every filter's largest response to any run of a text's words (padded at both ends).

    words: the embedding of each word; owner: its text, ascending.
    """
    pad = max(net.filters) - 1
    x = np.zeros((len(owner) + pad * (n + 1), net.emb.shape[1]), np.float32)
    x[np.arange(len(owner)) + pad * (owner + 1)] = words
    first = np.searchsorted(owner, np.arange(n)) + pad * np.arange(n)
    found = []
    for w, (f, b) in net.filters.items():
        m = len(x) - w + 1
        y = sum(x[j : j + m] @ f[j] for j in range(w))
        found.append(np.maximum.reduceat(y, first, axis=0) + b if n else np.zeros((0, len(b))))
    return np.maximum(np.concatenate(found, axis=1), 0)


def pooled(net: TextCNN, symbol: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of whole texts."""
    hashes, owner, _ = word_hashes(data, offsets, PREFIXES)
    return responses(net, sum(net.emb[symbol[buckets(hashes[:, k])]] for k in range(hashes.shape[1])), owner, len(offsets) - 1)


def margin(net: TextCNN, symbol: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The log-odds of class 1."""
    z = [net.logits(pooled(net, symbol, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in spans(offsets, 1 << 18)]
    z = np.concatenate(z) if z else np.zeros((0, 2))
    return (z[:, 1] - z[:, 0]).astype(np.float64)


def started(counts: pd.DataFrame, bad: int, good: int) -> tuple[TextCNN, np.ndarray]:
    """A network to begin with, and the buckets that it knows: those that counts has, in how many bad and good texts.

    The first number of an embedding is a share of its smoothed log-odds towards class 1, of all bad and good texts.
    """
    known = counts.bucket.to_numpy(np.int64)
    net = TextCNN.new(len(known) + 1, [0, 1], SIZE, WIDTHS, FILTERS, spread=0.02)
    share, weak = bad / (bad + good), 4.0
    odds = np.log((counts.bad.to_numpy() + weak * share) / (counts.good.to_numpy() + weak * (1 - share)) * (1 - share) / share)
    net.emb[1:, 0] += np.where(counts.whole.to_numpy(bool), 0.5, 0.1) * np.maximum(odds, 0)
    for f, _ in net.filters.values():
        f[:, 0] += 0.5
    # clean words say nothing against a toxic one elsewhere in the text
    net.out[:] = np.abs(net.out) * [-1, 1]
    return net, known


def margins(coded: DataFrame, net: TextCNN, known: np.ndarray) -> DataFrame:
    """lang, y and x, the log-odds of class 1, of each text of coded blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = symbols(known)
        for block in training.read(batches, WIDTH):
            emb = sum(net.emb[symbol[block.words[:, k]]] for k in range(WIDTH))
            for a, b in spans(block.ends, 1 << 16):
                part = block.places[block.ends[a] : block.ends[b]]
                z = net.logits(responses(net, emb[part], np.repeat(np.arange(b - a), np.diff(block.ends[a : b + 1])), b - a))
                yield pa.RecordBatch.from_arrays([pa.array(block.lang[a:b], pa.string()), pa.array(block.y[a:b]), pa.array((z[:, 1] - z[:, 0]).astype(np.float64))], names=["lang", "y", "x"])

    return coded.mapInArrow(of, "lang string, y long, x double")


def fit(docs: DataFrame, labelled: DataFrame, least: int = 5, text: str = "text", doc_id: str = "doc_id") -> Toxicity | None:
    """Learns from the whole texts of all labelled rows, a fifth of which calibrates; None without rows.

    labelled has columns id, label (1: toxic) and lang, which sets the thresholds only and is no input of a score.  A
    language's threshold is the best one for its rows among those that calibrate, where it has `least` or more of both
    classes there; that of all of them for other languages.
    Null labels, texts and ids take no part (see labelled_rows).  With rows of one class only, every score is the smoothed
    share of toxic rows, (toxic + 1) / (rows + 2).
    Words are counted, the network is fitted and calibrated, and thresholds are found by tasks, over blocks of rows (see
    training); the driver holds the network.  Buckets of fewer than LEAST texts stay unknown: no single text can teach that
    they matter.
    """
    with scratch.tables() as made:
        model = _fitted(docs, labelled, least, text, doc_id)
    scratch.remove(docs.sparkSession, made)
    return model


def _fitted(docs: DataFrame, labelled: DataFrame, least: int, text: str, doc_id: str) -> Toxicity | None:
    rows = training.labelled_rows(docs, labelled, text, doc_id)
    groups = rows.groupBy("lang", "y", (F.col("pick") < LEARN).alias("learn")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).limit(4 * MOST_LABELS + 1).collect()
    if not groups:
        return None
    if len(groups) > 4 * MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    count = lambda y, parts: sum(g.n for g in groups if g.y == y and g.learn in parts)
    bad, good = (count(y, (True, False)) for y in (1, 0))
    if not bad or not good:
        share = (bad + 1) / (bad + good + 2)
        return Toxicity(None, np.zeros(0, np.int64), 0.0, float(np.log(share / (1 - share))))
    split = bool(count(1, (True,)) and count(0, (True,)))
    held = split and bool(count(1, (False,)) and count(0, (False,)))
    total, n = sum(g.bytes for g in groups), bad + good
    coded = training.blocks(docs, rows, LEARN if split else 2.0, total, n, PREFIXES, BUCKETS, text, doc_id)
    learn = coded.where("learn")
    if split:
        bad, good = (count(y, (True,)) for y in (1, 0))
    net, known = started(training.bucket_counts(learn, WIDTH, BUCKETS, LEAST), bad, good)
    weights = (bad + good) / 2 / np.array([good, bad])
    passes = np.clip(ROWS * training.pieces(total, n) / (bad + good), *PASSES)
    net = training.trained(learn, WIDTH, net, known, BUCKETS, weights, ROUNDS, int(np.ceil(passes / ROUNDS)))
    z = written(margins(coded.where("not learn") if held else learn, net, known))
    model = Toxicity(net, known, *logistic_of(z))
    each = z.withColumn("score", 1 / (1 + F.exp(-(F.col("x") * model.slope + model.shift))))
    own = each.groupBy("lang").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).where((F.col("bad") >= least) & (F.col("n") - F.col("bad") >= least)).select("lang")
    common = best_thresholds(each.withColumn("lang", F.lit("")), "lang").first().threshold
    model.thresholds = {g.lang: common for g in groups} | {r.lang: r.threshold for r in best_thresholds(each.join(own, "lang"), "lang").collect()}
    return model


def toxicity(text: Column, model: Toxicity | None) -> Column:
    """The probability, from 0 to 1, that whole texts are toxic; null and empty texts count as texts without words."""
    if model is None:
        return F.lit(0.0)
    if model.net is None:
        return F.lit(1 / (1 + float(np.exp(-model.shift))))

    @arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        symbol = symbols(model.known)
        for texts in batches:
            z = model.slope * margin(model.net, symbol, *text_bytes(texts)) + model.shift
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return of(F.lower(text))


def with_toxicity(docs: DataFrame, model: Toxicity | None, lang: str = "lang", text: str = "text") -> DataFrame:
    """docs with score, and toxic: whether score reaches the threshold of the row's language (0.5 for others).

    Each row has its own result, so ties and repeated rows are kept; an empty table gives none; without a language column
    0.5 holds for all.  Columns score and toxic are replaced where docs has them, all others pass through.
    """
    limits = {k: v for k, v in (model.thresholds if model else {}).items() if k and lang in docs.columns}
    limit = F.lit(0.5)
    for k, v in limits.items():
        limit = F.when(F.col(lang) == k, v).otherwise(limit)
    return docs.withColumn("score", toxicity(F.col(text), model)).withColumn("toxic", F.col("score") >= limit)
