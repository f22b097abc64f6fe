"""The pipeline on a small corpus with planted cases."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzé", k=6)) for _ in range(2000)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    clean = [text(200) for _ in range(30)]
    passage = text(40)
    rows = list(enumerate(clean)) + [(100, clean[3]), (101, clean[4].replace(clean[4].split()[50], "other", 1)), (102, text(80) + " " + passage + " " + text(80)), (103, "1234 !!"), (104, None), (105, text(50) + " bob.1@mail.example.com " + text(50))]
    docs = [(i, t, "xx", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [*range(30), 105]
    assert all(r.lossless and r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in rows.values())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert rows[105].n_chars == len(docs[-1][1])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, id_of string"


def test_odd_rows(spark, tmp_path):
    """Null ids and columns, shared ids, repeated rows, very long and empty texts, extra columns, no benchmark."""
    draw = random.Random(6)
    text = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))
    a, b, long = text(60), text(60), text(60_000)
    rows = [(1, a, "xx"), (1, b, None), (1, a, "xx"), (None, text(50), None), (2, long, "yy"), (3, "", "xx"), (4, None, None), (5, "é", "yy")]
    docs = [(i, t, lang, None, None, "l", "o") for i, t, lang in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted([(0, 299), (1, len(a)), (1, len(b)), (2, len(long)), (5, 1)])
    assert all(r.lossless for r in got)


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
        assert out.count() == 0 and (name == "tokens" or out.columns == corpus_pipeline.COLUMNS)
