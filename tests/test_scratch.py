"""Scratch tables are listed by block and can be removed."""

from pathlib import Path

from cairn import scratch


def test_tables_of_blocks(spark):
    kept = scratch.written(spark.range(3))
    with scratch.tables() as outer:
        first = scratch.written(spark.range(4))
        with scratch.tables() as inner:
            scratch.written(first.where("id > 1"))
            last = scratch.written(spark.range(5))
    scratch.written(spark.range(6))
    assert len(outer) == 3 and inner == outer[1:] and all(Path(p).is_dir() for p in outer)
    scratch.remove(spark, [*outer[:-1], f"{outer[0]}-none"])
    assert [Path(p).exists() for p in outer] == [False, False, True]
    assert last.count() == 5 and kept.count() == 3


def test_lists_end_with_their_blocks(spark):
    try:
        with scratch.tables() as made:
            raise ValueError
    except ValueError:
        pass
    scratch.written(spark.range(1))
    assert made == []
