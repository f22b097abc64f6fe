"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels are classes of a model; a column with more values than this is none.
MOST_LABELS = 10_000


def labelled_sample(docs: DataFrame, labelled: DataFrame, max_rows: int, text: str = "text", doc_id: str = "doc_id") -> pd.DataFrame:
    """At most max_rows rows (label, text, pick) on the driver, with whole texts, as even over labels as the rows allow.

    labelled has columns id and label.  Rows are drawn by a hash of the id, before any text is read: a row's place is its
    hash times the number of rows of its label, so the first places hold as many of each label, and all of a rare one.
    Rows whose place is clearly too late are left out where they are, so no label's rows come together anywhere.  pick,
    from 0 to 1, is another hash of the id to split the sample by.  Rows with a null label, text or id take no part; an
    id counts once, with its smallest label, and of texts that share it with the one of the smallest hash.
    """
    rows = labelled.select("id", "label").where("id is not null and label is not null")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    known = counts.limit(MOST_LABELS + 1).collect()
    if len(known) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    late = _late([r.n for r in known], max_rows)
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40)) / (1 << 40)
    placed = rows.join(F.broadcast(counts), "label").withColumn("place", share(0) * F.col("n")).where(F.col("place") < late)
    each = placed.groupBy("id").agg(F.min("label").alias("label"), F.min("place").alias("place"))
    drawn = each.orderBy("place", "id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(drawn), "id")
    one = texts.groupBy("id", "label").agg(F.min_by("t", F.xxhash64("t")).alias("text"))
    return one.select("id", "label", "text", share(2).alias("pick")).orderBy("label", "id").drop("id").toPandas()


def _late(counts: list[int], max_rows: int) -> float:
    """A place before which there are max_rows rows all but certainly, and not many times as many."""
    wanted = max_rows + 8 * math.sqrt(max_rows) + 50
    late = 1.0
    while sum(min(n, late) for n in counts) < min(wanted, sum(counts)):
        late *= 1.5
    return late + 1
