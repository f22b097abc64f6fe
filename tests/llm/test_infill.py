"""Fill-in-middle: boundary sets against lists, cuts against plain Python, and reading back."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import infill

PATTERN = {"line": rb"[^\n]*\n|[^\n]+", "word": rb"[^\x09-\x0d ]*[\x09-\x0d ]+|[^\x09-\x0d ]+", "character": rb"[\x00-\x7f\xc0-\xff][\x80-\xbf]*"}


def plain(doc_id, text, percent=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not t or any(s in t for s in infill.SENTINELS) or h[2] % 100 >= percent:
        return n, "plain", None, None, t
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("step, kind", [(1, infill.RunContainer), (100, infill.ArrayContainer), (3, infill.BitmapContainer)])
def test_containers(step, kind):
    values = np.arange(5, 200_000, step)
    found = infill.BoundarySet(values)
    assert {type(c) for c in found.containers[:-1]} == {kind}
    assert len(found) == len(values) and found.high == [0, 1, 2, 3]
    for k in {0, 1, len(values) // 3, len(values) // 2, len(values) - 1, int(np.searchsorted(values, 65536)), int(np.searchsorted(values, 65536)) - 1}:
        assert found.select(k) == values[k]
    with pytest.raises(IndexError):
        found.select(len(values))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=300), st.integers(0, 250_000), st.integers(0, 9000))
def test_any_set(some, first, run):
    values = np.array(sorted(some | set(range(first, first + run))), np.int64)
    found = infill.BoundarySet(values)
    assert len(found) == len(values)
    for k in range(0, len(values), max(1, len(values) // 50)):
        assert found.select(k) == values[k]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("a é\n\t😀"), max_size=60), st.sampled_from(sorted(PATTERN)))
def test_units(text, unit):
    data = text.encode()
    ends = np.cumsum([len(u) for u in re.findall(PATTERN[unit], data)], dtype=np.int64)
    found = infill.boundaries(data, unit)
    assert [found.select(k) for k in range(len(found))] == ends.tolist()


ROWS = [(1, "a\nb\nc\n"), (2, "é\n\n\n😀"), (3, None), (4, ""), (5, "one line"), (6, "x <P> y\nz"), (7, "\n" * 5), (1, "a\nb\nc\n"), (None, "p\nq"), (9, "x <S\n> <\nM>"), (10, "<M>"), (11, "é😀x\n" * 40_000), (12, "y\r\nz\r\n")] + [(i, "l1\nl2 é\nl3\n\nl5") for i in range(20, 60)]


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_against_plain(spark, percent, spm):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"form": F.lit("old"), "drawn_of": F.lit("kept"), "N_units": F.lit(9)})
    made = infill.fill_in_middle(df, percent=percent, spm_percent=spm)
    assert sorted(made.columns) == sorted(["doc_id", "text", "form", "drawn_of", "n_units", "prefix_chars", "middle_chars", "fim"])
    got = made.select("doc_id", "text", "N_units", "form", "prefix_chars", "middle_chars", "fim", infill.restored(F.col("form"), F.col("fim")).alias("back"), "drawn_of").collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r)[2:7] == plain(r.doc_id, r.text, percent, spm)
        assert r.back == (r.text or "") and r.drawn_of == "kept"
    if percent == 100:
        assert {r.form for r in got} == ({"plain", "spm", "psm"} if spm == 50 else {"plain", "spm"})
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_marks_and_units(spark):
    df = spark.createDataFrame([(i, f"some words é {i} are here") for i in range(30)], "doc_id string, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    for unit in infill.UNITS:
        made = infill.fill_in_middle(df, unit=unit, sentinels=marks).select("text", "form", infill.restored(F.col("form"), F.col("fim"), marks).alias("back")).collect()
        assert all(r.text == r.back and r.form != "plain" for r in made)
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<a", "a>", "<M>"), ("<M", "<S>", "x<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(df, sentinels=bad)
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, unit="page")
