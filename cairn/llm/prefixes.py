"""The trie of conversations' shared prefixes, by union-find over neighbours in sorted order.

Conversations are sorted by the digests of their turns.  The longest common prefixes of neighbours are edges, and taken
in descending depth they build the trie from its leaves: each union of components makes, or adds to, a branching node at
the edge's depth, and between two such nodes every depth has one and the same set of members.

A conversation is cut into rows of BLOCK turns, and a row belongs to the tree of what precedes it, so no row grows with
its conversation.  Sorted rows are solved in chunks.  A component that touches neither end of its chunk is complete.  Of
the others, which are prefixes of the chunk's first or last row, one row each is left that carries their counts; these
rows are far fewer, are sorted again, and so on until one chunk holds them all.

Sums over a subtree need no second walk: where a member joins one with a smaller id, at depth t, its first t turns are
saved.  So a first pass finds for each conversation that depth and whom it joins, and a second pass adds up, for every
component, numbers of its members that are known by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import written

#: Turns of a row (it holds one more, to see what follows), and rows of a chunk.
BLOCK, ROWS = 64, 20_000
#: Nodes open at ends of chunks that are sent to all executors to name who joins whom; more are joined.
MOST_OPEN = 500_000
_WIDE = 16

_ITEM = "tree binary, base bigint, key binary, chars binary, conv bigint, joined bigint, parent bigint, own bigint, n bigint, saved bigint, leaves bigint, children bigint, opened boolean"
_FOUND = "kind string, id bigint, depth bigint, other bigint, at bigint, node binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
_NAMES, _FOUND_NAMES = ([c.split()[0] for c in s.split(", ")] for s in (_ITEM, _FOUND))
_ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_KINDS = {c.split()[0]: _ARROW[c.split()[1]] for c in f"{_FOUND}, {_ITEM}".split(", ")}


def digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, digest (of role and text) and chars (code points of the text): what the trie needs of a turn.

    Null roles and texts are empty.  Rows with a null conversation take no part.
    """
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary")))
    rows = turns.where(F.col(conv_id).isNotNull())
    return rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(t).cast("long").alias("chars"))


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _KINDS[c]) for c in names], names=names)


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Rows of `block` turns and one more: conv, tree (of the turns before), base (their number), key, chars (sums from 0 on)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, base, tree, held, sums, done = None, hashlib.blake2b(digest_size=_WIDE), 0, b"", [], [0], []

        def row() -> dict:
            return {"conv": conv, "tree": tree, "base": base, "key": b"".join(held), "chars": np.array(sums, "<i8").tobytes()}

        for b in batches:
            for c, digest, chars in zip(*(b[x].to_pylist() for x in ("conv_id", "digest", "chars"))):
                if c != conv:
                    if conv is not None:
                        done.append(row())
                    conv, seen, base, tree, held, sums = c, hashlib.blake2b(digest_size=_WIDE), 0, b"", [], [0]
                if digest is None:
                    continue
                held.append(digest)
                sums.append(sums[-1] + chars)
                if len(held) > block:
                    done.append(row())
                    seen.update(b"".join(held[:block]))
                    base, tree, held, sums = base + block, seen.digest(), held[block:], sums[block:]
            if len(done) > 1000:
                yield _batch(done, names)
                done = []
        if conv is not None:
            yield _batch([*done, row()], names)

    names = ["conv", "tree", "base", "key", "chars"]
    rows = turns.select("conv_id", "turn", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    return rows.mapInArrow(of, "conv bigint, tree binary, base bigint, key binary, chars binary")


def common_turns(a: bytes, b: bytes) -> int:
    """The number of digests that two rows of them begin with alike."""
    n = min(len(a), len(b)) // _WIDE
    if a[: n * _WIDE] == b[: n * _WIDE]:
        return n
    x, y = (np.frombuffer(k, np.uint8, n * _WIDE) for k in (a, b))
    return int((x != y).argmax()) // _WIDE


@dataclass
class Component:
    """Rows lo to hi of a chunk as far as they are joined: a node at `depth` with what hangs there.

    conv is the smallest member; joined and parent are where and whom that one joins further up, own is what is saved there.
    """

    lo: int
    hi: int
    depth: int
    base: int
    conv: int | None
    joined: int
    parent: int | None
    own: int
    n: int
    saved: int
    leaves: int
    children: int
    opened: bool
    met: list[int] = field(default_factory=list)  # members that join another one at this very node

    def emptied(self, depth: int) -> None:
        self.depth, self.conv, self.n, self.saved, self.leaves, self.children, self.opened, self.met = depth, None, 0, 0, 0, 0, False, []


class Chunk:
    """Solves sorted rows (dicts of _ITEM). whole: nothing lies beyond its ends. sums: nodes are wanted, else who joins whom."""

    def __init__(self, items: list[dict], whole: bool, sums: bool, block: int):
        self.items, self.whole, self.sums, self.block = items, whole, sums, block
        self.found: list[dict] = []
        n = len(items)
        self.up = list(range(n))
        self.of = [Component(i, i, len(x["key"]) // _WIDE, **{k: x[k] for k in ("base", "conv", "joined", "parent", "own", "n", "saved", "leaves", "children", "opened")}) for i, x in enumerate(items)]
        lcp = np.array([common_turns(a["key"], b["key"]) if a["tree"] == b["tree"] and a["base"] == b["base"] else -1 for a, b in zip(items, items[1:])], np.int64)
        for i in np.argsort(-lcp, kind="stable").tolist():
            if lcp[i] >= 0:
                self._join(self._find(i), self._find(i + 1), int(lcp[i]))
        for i in range(n):
            if self.up[i] == i:
                self._end(self.of[i])

    def _find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _open(self, c: Component) -> bool:
        return not self.whole and (c.lo == 0 or c.hi == len(self.items) - 1)

    def _chars(self, c: Component) -> np.ndarray:
        return np.frombuffer(self.items[c.lo]["chars"], "<i8")

    def _name(self, c: Component) -> bytes:
        item = self.items[c.lo]
        return hashlib.blake2b(item["tree"] + item["key"][: c.depth * _WIDE], digest_size=_WIDE).digest()

    def _join(self, i: int, j: int, depth: int) -> None:
        a, b = self.of[i], self.of[j]
        for c in (a, b):
            if c.depth > depth:
                self._close(c, depth)
        first, second = (a, b) if b.conv is None or a.conv is not None and a.conv <= b.conv else (b, a)
        met = first.met if len(first.met) >= len(second.met) else second.met
        met += second.met if met is first.met else first.met
        if second.conv is not None and (depth > 0 or a.base == 0):
            met.append(second.conv)
        first.lo, first.hi, first.met = min(a.lo, b.lo), max(a.hi, b.hi), met
        first.n, first.saved, first.leaves, first.children, first.opened = a.n + b.n, a.saved + b.saved, a.leaves + b.leaves, a.children + b.children, a.opened or b.opened
        i, j = (i, j) if first is a else (j, i)
        self.up[j] = i
        self.of[j] = None

    def _close(self, c: Component, depth: int) -> None:
        """The node of c hangs on one at a smaller depth: it's done, or left open as a row that carries its counts."""
        if self._open(c):
            self._leave(c)
            c.emptied(depth)
            return
        self._settle(c)
        chars = self._chars(c)
        if self.sums:
            for d in range(depth + 1, min(c.depth, self.block) + 1):
                self._node(c, d, c.children if d == c.depth else 1, c.saved - c.own - (c.n - 1) * int(chars[d - 1]))
        elif c.children == 0 and c.depth <= self.block:
            self.found.append({"kind": "leaf", "id": c.conv})
        c.depth, c.children, c.opened, c.met = depth, 1, False, []

    def _node(self, c: Component, d: int, children: int, saved: int) -> None:
        at = c.base + d
        parent = None if at == 0 else c.conv if at - 1 > c.joined else c.parent
        self.found.append({"kind": "node", "id": c.conv, "depth": at, "other": parent, "n_convs": c.n, "n_children": children, "n_leaves": c.leaves, "saved_tokens": saved})

    def _settle(self, c: Component) -> None:
        """Those who join another one at c's node join its smallest member."""
        if not self.sums:
            at = int(self._chars(c)[c.depth])
            self.found += [{"kind": "join", "id": m, "depth": c.base + c.depth, "other": c.conv, "at": at} for m in c.met]
            if c.opened:
                self.found.append({"kind": "name", "node": self._name(c), "other": c.conv})

    def _leave(self, c: Component) -> None:
        if not c.n:
            return
        item = self.items[c.lo]
        left = {k: getattr(c, k) for k in ("base", "conv", "joined", "parent", "own", "n", "saved", "leaves", "children")}
        self.found.append({"kind": "item", "tree": item["tree"], "key": item["key"][: c.depth * _WIDE], "chars": item["chars"][: 8 * (c.depth + 1)], "opened": True} | left)
        if not self.sums and c.met:
            at, node = int(self._chars(c)[c.depth]), self._name(c)
            self.found += [{"kind": "wait", "id": m, "depth": c.base + c.depth, "at": at, "node": node} for m in c.met]

    def _end(self, c: Component) -> None:
        """The root of a tree; that of turns after the first BLOCK is a node of the tree before, where it is seen whole."""
        if self._open(c):
            self._leave(c)
            return
        if c.depth > 0:
            self._close(c, 0)
        if c.base == 0:
            self._settle(c)
            if self.sums:
                self._node(c, 0, c.children, c.saved - c.own)
            elif c.children == 0:
                self.found.append({"kind": "leaf", "id": c.conv})


def _solved(items: DataFrame, sums: bool, rows: int, block: int) -> list[DataFrame]:
    """What all rounds over items (_ITEM) found: tables of _FOUND. Open rows of a round are the items of the next one."""

    def of(whole: bool, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []

            def solved() -> Iterator[pa.RecordBatch]:
                found = Chunk(held, whole, sums, block).found
                for i in range(0, len(found), 10_000):
                    yield _batch(found[i : i + 10_000], _FOUND_NAMES + _NAMES)

            for b in batches:
                held += b.to_pylist()
                while not whole and len(held) > most:
                    rest, held = held[most:], held[:most]
                    yield from solved()
                    held = rest
            if held:
                yield from solved()

        return run

    done = []
    while True:
        n = items.count()
        whole = n <= rows
        order = ["tree", "base", "key", "conv"]
        dealt = items.coalesce(1) if whole else items.repartitionByRange(-(-n // rows), *order)
        out = written(dealt.sortWithinPartitions(*order).mapInArrow(of(whole, rows), f"{_FOUND}, {_ITEM}"))
        done.append(out)
        if whole:
            return done
        items = out.where("kind = 'item'").select(*_NAMES)
        if items.count() > n // 2:
            rows *= 2


def _found(tables: list[DataFrame], kind: str, *columns: Column | str) -> DataFrame:
    parts = [t.where(F.col("kind") == kind).select(*columns) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _items(blocks: DataFrame, **known: Column) -> DataFrame:
    """blocks as rows of _ITEM; known: what is known of a conversation, by column."""
    start = {"joined": F.lit(-1), "parent": F.lit(None), "own": F.lit(0), "leaves": F.lit(0)} | known
    start |= {"n": F.lit(1), "saved": start["own"], "children": F.lit(0)}
    return blocks.withColumns({k: v.cast("long") for k, v in start.items()} | {"opened": F.lit(False)}).select(*_NAMES)


def _joins(tables: list[DataFrame]) -> DataFrame:
    """conv, joined (a depth), parent (the smaller member that it joins there) and own (code points of its turns to there)."""
    known = _found(tables, "join", "id", "depth", "other", "at")
    waiting = _found(tables, "wait", "id", "depth", "at", "node")
    names = written(_found(tables, "name", "node", "other"))
    named = waiting.join(F.broadcast(names) if names.count() <= MOST_OPEN else names, "node").select("id", "depth", "other", "at")
    last = known.unionByName(named).groupBy("id").agg(F.max(F.struct("depth", "other", "at")).alias("j"))  # deeper trees know better
    return last.select(F.col("id").alias("conv"), F.col("j.depth").alias("joined"), F.col("j.other").alias("parent"), F.col("j.at").alias("own"))


_NO_ENDS = hashlib.sha256().hexdigest()


def _ends(members: DataFrame) -> DataFrame:
    """Of members (conv_id, depth, member), a digest of each node's members in order: ends_sha256. Long lists stream through a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, done = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])

        for b in batches:
            for conv, depth, member in zip(*(b[x].to_pylist() for x in ("conv_id", "depth", "member"))):
                if (conv, depth) != now:
                    if now:
                        done.append((*now, h.hexdigest()))
                    now, h = (conv, depth), hashlib.sha256(str(member).encode())
                else:
                    h.update(f",{member}".encode())
            if len(done) > 5000:
                yield batch()
                done.clear()
        if now:
            done.append((*now, h.hexdigest()))
            yield batch()

    rows = members.select("conv_id", "depth", "member").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return rows.mapInArrow(of, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of conversations: each distinct sequence of first turns, from the empty one (depth 0).

    turns is as digests() makes it; a row with a null digest is no turn, but makes its conversation count.  Turns go by turn
    (null first), of the same turn by digest; repeated rows are repeated turns.  Of a node: conv_id, its smallest member;
    depth; parent_conv_id, its parent's conv_id (null for the root); n_convs, members; n_children; n_leaves, childless nodes
    in its subtree; saved_tokens, over its subtree the sum of (n_convs - 1) times the code points of a node's last text;
    ends_sha256, of the decimal ids of the members that end there, in order, joined by commas.  A node is known by conv_id
    and depth.  Without conversations there are no nodes.

    rows: of a chunk; block: turns of a row.  A conversation's turns stream through one task; nothing holds more of it
    than a row does.
    """
    blocks = written(_blocks(turns, block))
    first = _solved(_items(blocks), False, rows, block)
    leaves = _found(first, "leaf", F.col("id").alias("conv"), F.lit(1).alias("is_leaf"))
    joins = written(_joins(first).join(leaves, "conv", "full"))
    known = {"joined": F.coalesce("joined", F.lit(-1)), "parent": F.col("parent"), "own": F.coalesce("own", F.lit(0)), "leaves": F.coalesce("is_leaf", F.lit(0))}
    second = _solved(_items(blocks.join(joins, "conv", "left"), **known), True, rows, block)
    lengths = blocks.groupBy("conv").agg(F.max(F.col("base") + (F.octet_length("key") / _WIDE).cast("long")).alias("length"))
    at = lengths.join(joins, "conv", "left")
    ends = _ends(at.select(F.when(F.col("joined") == F.col("length"), F.col("parent")).otherwise(F.col("conv")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv").alias("member")))
    nodes = _found(second, "node", F.col("id").alias("conv_id"), "depth", F.col("other").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
