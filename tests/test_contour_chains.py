"""Segments of many tiles and levels are chained together, batch by batch."""

import random

import pyarrow as pa

from cairn.operators import contours

NAMES = ["w", "k", "tx", "ty", "e1", "x1", "y1", "e2", "x2", "y2"]


def _segments(draw, group):
    """Open lines and rings with edges of their own, of any length, in any order and direction."""
    out, n = [], 0
    for _ in range(draw.randrange(1, 5)):
        size, ring = draw.choice([1, 2, 3, 7, 60]), draw.random() < 0.4
        edges = [(f"h:{n + i}:{draw.randrange(9)}", float(n + i), draw.random()) for i in range(size + 1)]
        n += size + 1
        if ring and size > 2:
            edges[-1] = edges[0]
        for a, b in zip(edges, edges[1:]):
            out.append((*group, *(a + b if draw.random() < 0.5 else b + a)))
    draw.shuffle(out)
    return out


def _turned(chain):
    """A chain however it is turned, and a ring wherever it begins."""
    if chain[0][0] == chain[-1][0]:
        ring = chain[:-1]
        turns = [r[i:] + r[:i] for r in (ring, ring[::-1]) for i in range(len(ring))]
        return min(turns)
    return min(chain, chain[::-1])


def test_groups_are_chained_together_in_batches():
    draw = random.Random(4)
    groups = [(w, k, t, t % 2) for w in (1, None) for k in range(6) for t in range(8)]
    rows = [r for g in groups for r in _segments(draw, g)]
    table = pa.table({c: pa.array([r[i] for r in rows]) for i, c in enumerate(NAMES)})
    want = []
    for g in groups:
        some = [(r[4], r[4:7], r[7], r[7:10]) for r in rows if r[:4] == g]
        want += [(*g[:2], c[0][0] == c[-1][0], _turned([p for _, p in c])) for c in contours.chains(some)]
    for size in (1, 50, len(rows)):
        found = list(contours.linked(iter(table.to_batches(max_chunksize=size)), ["w"]))
        got = [(r["w"], r["k"], r["closed"], _turned([(p["e"], p["x"], p["y"]) for p in r["c"]])) for b in found for r in b.to_pylist()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert size < len(rows) or len(found) <= 2  # all groups but the one that a batch leaves open at once, not one by one


def test_levels_of_a_cell_are_not_grouped(spark, sf_dir):
    """The query's rows come one by one from its cells, however many levels cross one: no aggregation lies above them."""
    from cairn.plans import more_queries

    plan = more_queries.contour_segments(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
