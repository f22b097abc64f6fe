"""The prefix trie against a plain one, over chunks and blocks of any size."""

import hashlib
import random
import zlib

import pytest

from cairn.llm import prefixes
from cairn.llm.queries import _rebuilt


def plain(conversations):
    """Rows of nodes for {conv_id: [(role, text), ...]}."""
    members, ends, children = {}, {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                children.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
        ends.setdefault(tuple(turns), []).append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, ())), leaves[n], saved[n], digest(ends.get(n, []))) for n, m in members.items())


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def turns_of(spark, conversations):
    rows = [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    df = prefixes.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    itself = [(c, None, None, 0) for c in conversations]
    return df.unionByName(spark.createDataFrame(itself, "conv_id long, turn long, digest binary, chars long"))


def made(kind, draw):
    say = lambda k: (draw.choice(["user", "assistant"]), "é" * k + str(draw.randint(0, 1)))
    if kind == "bushy":
        return {draw.randint(-50, 10**6): [say(d) for d in range(draw.randint(0, 6))] for _ in range(150)}
    if kind == "copies":  # a third are one conversation, others begin like it
        long = [say(d) for d in range(9)]
        return {c: long if c % 3 == 0 else long[: draw.randint(0, 9)] + [say(1)] for c in range(90)}
    if kind == "chain":  # each is the beginning of the next, across blocks
        long = [say(d % 3) for d in range(23)]
        return {100 - d: long[:d] for d in range(24)} | {200: long[:7] + [("x", "y")], 201: long[:8] + [("x", "y")] * 9, 202: long[:9] + [("x", "y")], 203: long[:17]}
    return {5: [], 3: []} if kind == "turnless" else {7: [("user", "")]}


@pytest.mark.parametrize("kind, rows, block", [("bushy", 20_000, 64), ("bushy", 7, 4), ("copies", 20, 64), ("copies", 7, 4), ("chain", 20, 64), ("chain", 3, 4), ("chain", 7, 1), ("turnless", 1, 4), ("one", 20_000, 64)])
def test_trie(spark, kind, rows, block):
    conversations = made(kind, random.Random(kind))
    assert got(prefixes.prefix_trie(turns_of(spark, conversations), rows=rows, block=block)) == plain(conversations)


def rebuilt(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = conversations.get(c - c % 100, [])
        out[c] = base[:h] + own[h:]
    return out


def test_rebuilt_and_odd_rows(spark):
    draw = random.Random(2)
    conversations = {c: [(draw.choice("ua"), f"t{draw.randint(0, 3)}") for _ in range(draw.randint(1, 8))] for c in [*range(100, 160), *range(200, 300, 3), 300, 307, *range(401, 420)]}
    rows = [(c, None if i == 0 else i, None if role == "u" else role, text, "extra") for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame([*rows, (None, 1, "u", "lost", "extra")], "conv_id long, turn long, role string, text string, depth string")
    want = {c: [("" if r == "u" else r, t) for r, t in turns] for c, turns in conversations.items()}
    assert got(prefixes.prefix_trie(_rebuilt(prefixes.digests(df)), rows=30)) == plain(rebuilt(want))
    assert got(prefixes.prefix_trie(_rebuilt(prefixes.digests(df.limit(0))))) == []


def test_repeats_and_long(spark):
    long = [("user", "x" * (i % 5)) for i in range(300)]
    conversations = {1: long, 2: long, 3: long[:296], 4: long[:200] + [("a", "b")], 5: [("a", "b"), ("a", "b")]}
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rows = [(c, 0 if c == 5 else i, r, t) for c, i, r, t in rows]  # a repeated row is a repeated turn
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefixes.prefix_trie(prefixes.digests(df), rows=10, block=8)) == plain(conversations)


def test_common_turns():
    a, b = bytes(range(48)), bytes(range(48))
    assert prefixes.common_turns(a, b) == 3 and prefixes.common_turns(a, a[:16]) == 1 and prefixes.common_turns(a, b"") == 0
    assert prefixes.common_turns(a, a[:20] + b"x" * 28) == 1
