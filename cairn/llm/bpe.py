"""Byte-pair encoding and decoding by a tokenization automaton.

`Gadgets` is the automaton over tokens.  Its states are the tokens: a state knows which tokens may follow the one that was
emitted last, so that its paths are exactly the token sequences that the merges produce, one for each byte string.  It
starts with single bytes, where every byte may follow every byte, and gets one gadget for each merge a + b -> c, in order:

* state a loses its arc b;
* every state that then has an arc a gets an arc c;
* state c begins as a copy of the state of b from before the merge.

Whole states are never copied: a state remembers what it began as and when, an arc where it was attached and when, and
a lost arc when it was lost, so compiling takes one step a merge.

`Automaton` reads bytes and is deterministic: by subset construction, one of its states is the set of arcs that may be
under way after the bytes read, and names the one token that ends there.  Its moves are an array of states by bytes.
Encoding is one look-up a byte, then the tokens are read off from the end, each as long as its label.  Decoding emits the
arcs' labels.

Texts are cut into words by arrays of character classes, and only the distinct words of a block of texts are encoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cairn.llm.common import fresh, spans, text_bytes

#: What byte-level BPE of this kind takes for one word after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: States of a table at most (1 KB each), before it's begun anew, and bytes of words between looks at their number.
STATES, CHUNK = 1 << 16, 1 << 15
#: Bytes of texts that are encoded at once.
BLOCK = 2 << 20
#: What the fields of a tokenizer file must hold (where they are there) for this way of encoding to be the right one.
EXPECTED = {
    "normalizer": [None],
    "pre_tokenizer": [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}],
    "model": [{"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}],
    "added_tokens": [{"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}],
}


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Gadgets:
    """Compiled from a vocabulary (label to id) and merges in order (pairs of labels); labels are byte strings."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocab.values(), default=-1) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.lost: dict[tuple[int, int], int] = {}
        made, live = set(), {i for text, i in vocab.items() if len(text) == 1}
        for when, (a, b) in enumerate(merges, 1):
            if a + b in made:
                raise ValueError(f"two merges make {a + b!r}")
            made.add(a + b)
            self._gadget(vocab[a], vocab[b], vocab[a + b], when, live)
        self.labels = {i: text for text, i in vocab.items() if i in live}
        self.by_state: dict[int, dict[int, list[tuple[int, int]]]] = {}  # lost arcs of a state by their labels' first bytes
        for (a, b), when in self.lost.items():
            self.by_state.setdefault(a, {}).setdefault(self.labels[b][0], []).append((b, when))

    def _gadget(self, a: int, b: int, c: int, when: int, live: set[int]) -> None:
        """Where a is never followed by b any more, c never comes about and the automaton stays as it is."""
        if not (a in live and b in live and self.has_arc(a, b, when - 1)):
            return
        live.add(c)
        self.lost[a, b] = when
        self.left[c], self.right[c], self.born[c] = a, b, when

    def has_arc(self, x: int, y: int, now: float = float("inf")) -> bool:
        """Whether state x has arc y once gadget number `now` is in; by default, once all are."""
        while True:
            if (gone := self.lost.get((x, y))) is not None and gone <= now:
                return False
            bx, by = self.born[x], self.born[y]
            if not bx and not by:
                return True
            if by >= bx:  # arc y came to x with its gadget, if x had the arc of y's left part then
                now, y = by, self.left[y]
            else:  # x had y as it began, from the state of its right part
                now, x = bx - 1, self.right[x]

    def missing(self, x: int, byte: int) -> tuple[tuple[int, int], ...]:
        """All that keeps arcs of labels with this first byte from state x: (arc, gadget that took it).

        A taken arc is missing itself, and so is every arc that would have come with it later.  x lacks what it lost and
        what the states that it began as had lost by then.
        """
        found: dict[int, int] = {}
        until = float("inf")
        while True:
            for arc, when in self.by_state.get(x, {}).get(byte, ()):
                if when < until and when < found.get(arc, until):
                    found[arc] = when
            if not self.born[x]:
                return tuple(sorted(found.items()))
            until, x = self.born[x], self.right[x]


class Automaton:
    """The deterministic automaton over bytes.

    A thread is an arc under way: a place in the trie of labels, and what is missing there of the state that it left.  A
    state is the threads that the bytes read leave open, and the token that ends with the last one, which names the
    state where the next thread begins.  State 0 is the start.  `moves[state, byte]` is the next state (0: not compiled
    yet, as no move leads to the start), `token[state]` the token that ends there.  A move is compiled when it's first
    asked for; as states are sets, which move it is doesn't depend on when.  Beyond `most` states the table is begun
    anew, which bounds memory and changes no result.
    """

    def __init__(self, gadgets: Gadgets, most: int = STATES, chunk: int = CHUNK):
        self.gadgets, self.most, self.chunk = gadgets, most, chunk
        self.length = np.zeros(max(gadgets.labels, default=0) + 1, np.int64)
        for i, text in gadgets.labels.items():
            self.length[i] = len(text)
        # labels in order, so that those which begin alike are a range
        ordered = sorted((text, i) for i, text in gadgets.labels.items())
        self.under = [i for _, i in ordered]
        self.child: dict[int, int] = {}  # trie of labels: node << 8 | byte to node
        self.arc, self.first, self.last, self.depth = [-1], [0], [len(ordered)], [0]
        for at, (text, i) in enumerate(ordered):
            node = 0
            for n, byte in enumerate(text, 1):
                key = node << 8 | byte
                if (node := self.child.get(key, len(self.arc))) == len(self.arc):
                    self.child[key] = node
                    self.arc.append(-1)
                    self.first.append(at)
                    self.last.append(at)
                    self.depth.append(n)
                self.last[node] = at + 1
            self.arc[node] = i
        self.begin()

    def begin(self, keep: int = 0) -> int:
        """An empty table but for the start and a state to keep, whose new number is returned."""
        kept = [self.threads[t] for t in self.sets[keep][0]] if keep else []
        self.moves = np.zeros((self.most + self.chunk + 1, 256), np.int32)
        self.token = np.zeros(len(self.moves), np.int32)
        self.threads: list[tuple[int, tuple]] = []
        self.thread_number: dict[tuple[int, tuple], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}  # thread << 8 | byte to next thread and token, -1 for none
        self.starts: dict[tuple[int, int], tuple[int, int]] = {}  # of a token's state, by byte
        start = ((), -1)
        old = self.sets[keep] if keep else start
        self.sets, self.number = [start], {start: 0}
        if not keep:
            return 0
        self.threads = kept
        self.thread_number = {thread: i for i, thread in enumerate(kept)}
        self.sets.append((tuple(range(len(kept))), old[1]))
        self.number[self.sets[1]] = 1
        self.token[1] = old[1]
        return 1

    def _blocked(self, y: int, missing: dict[int, int]) -> bool:
        until = float("inf")
        while True:
            when = missing.get(y)
            if when is not None and when <= until:
                return True
            if not self.gadgets.born[y]:
                return False
            until, y = self.gadgets.born[y], self.gadgets.left[y]

    def _enter(self, node: int | None, missing: tuple[tuple[int, int], ...]) -> tuple[int, int]:
        """A thread that comes to a node: its number there, if any longer label is left to it, and the token that ends."""
        if node is None:
            return -1, -1
        if missing:  # those that still bear on labels from here on
            text, label = self.gadgets.labels[self.under[self.first[node]]][: self.depth[node]], self.gadgets.labels
            missing = tuple(m for m in missing if label[m[0]].startswith(text) or text.startswith(label[m[0]]))
        key = (node, missing)
        known, own = dict(missing), self.arc[node]
        token = -1 if own < 0 or (known and self._blocked(own, known)) else own
        number = self.thread_number.get(key)
        if number is None:
            further = self.under[self.first[node] : self.last[node]]
            opens = any(y != own and not (known and self._blocked(y, known)) for y in further)
            number = self.thread_number[key] = len(self.threads) if opens else -1
            if opens:
                self.threads.append(key)
        return number, token

    def _compile(self, state: int, byte: int) -> int:
        """The move from a state: each thread reads the byte; one of them ends a token, and the next one begins after it."""
        threads, last = self.sets[state]
        key = (last, byte)
        found = self.starts.get(key)
        if found is None:
            found = self.starts[key] = self._enter(self.child.get(byte), self.gadgets.missing(last, byte) if last >= 0 else ())
        number, ended = found
        opened = [number] if number >= 0 else []
        on = []
        for t in threads:
            key = t << 8 | byte
            found = self.steps.get(key)
            if found is None:
                node, missing = self.threads[t]
                found = self.steps[key] = self._enter(self.child.get(node << 8 | byte), missing)
            number, token = found
            if number >= 0:
                on.append(number)
            if token >= 0:
                ended = token
        if ended < 0:
            raise ValueError(f"no token ends with byte {byte}")
        to = (tuple(on + opened), ended)
        found = self.number.get(to)
        if found is None:
            found = self.number[to] = len(self.sets)
            self.sets.append(to)
            self.token[found] = ended
        self.moves[state, byte] = found
        return found

    def _tokens_at(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each byte of words (sizes falling), the token that ends there: all words move on together."""
        found = np.zeros(len(data), np.int32)
        state = np.zeros(len(start), np.int32)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))
            byte = data[start[:n] + i]
            to = self.moves[state[:n], byte]
            if (missing := np.flatnonzero(to == 0)).size:
                for pair in np.unique(state[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                    self._compile(pair >> 8, pair & 255)
                to = self.moves[state[:n], byte]
            state[:n] = to
            found[start[:n] + i] = self.token[to]
        return found

    def _tokens_along(self, word: bytes) -> np.ndarray:
        """As _tokens_at, of one word of any length."""
        found, state = np.zeros(len(word), np.int32), 0
        for i, byte in enumerate(word):
            if len(self.sets) > self.most:
                state = self.begin(state)
            state = int(self.moves[state, byte]) or self._compile(state, byte)
            found[i] = self.token[state]
        return found

    def run(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words (a binary array): all of them, and offsets of each word's."""
        data, offsets = text_bytes(words)
        size = np.diff(offsets)
        ends = np.zeros(len(data), np.int32)
        order = np.argsort(-size, kind="stable")
        for at in order[: int((size > self.chunk).sum())]:
            ends[offsets[at] : offsets[at + 1]] = self._tokens_along(data[offsets[at] : offsets[at + 1]].tobytes())
        order = order[int((size > self.chunk).sum()) :]
        for a, b in spans(np.r_[0, np.cumsum(size[order])], self.chunk):
            if len(self.sets) > self.most:
                self.begin()
            some = order[a:b]
            inside = np.repeat(offsets[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            ends[inside] = self._tokens_at(data[inside], np.cumsum(size[some]) - size[some], size[some])
        # from the end: a token, then the one that ends where it begins
        used = np.zeros(len(data), bool)
        at = (offsets[1:] - 1)[size > 0]
        begin = offsets[:-1][size > 0]
        while len(at):
            used[at] = True
            at = at - self.length[ends[at]]
            more = at >= begin
            at, begin = at[more], begin[more]
        return ends[used], np.r_[0, np.cumsum(used)][offsets]


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Each code point's class: 1 letter, 2 number, 3 white space, 0 other."""
    if not _kinds:
        found = np.zeros(0x110000, np.uint8)
        for first in range(0, 0x110000, 0x800):
            if first == 0xD800:  # surrogates, which texts don't hold
                continue
            text = "".join(map(chr, range(first, first + 0x800)))
            for k, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
                for m in regex.finditer(pattern, text):
                    found[first + m.start() : first + m.end()] = k
        _kinds.append(found)
    return _kinds[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which words begin, in texts one after the other; words cover the texts whole.

    A word is a run of letters, of numbers or of other characters, with a space before it if there is one; or what
    CONTRACTIONS lists after an apostrophe that nothing of these precedes; or white space, of which the last character
    before others stands alone (or, a space, goes to them).
    """
    if not len(data):
        return np.zeros(0, np.int64)
    if data.max() < 128:
        code, place = data, None
    else:
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
    kind = kinds()[code]
    fresh = np.zeros(len(code) + 1, bool)  # where texts begin, and the end
    fresh[np.searchsorted(place, offsets) if place is not None else offsets] = True
    start = np.r_[True, kind[1:] != kind[:-1], True] | fresh
    white = kind == 3
    before_other = np.flatnonzero(white & start[1:] & ~fresh[1:])  # ends a run of white space within a text
    joins = before_other[code[before_other] == 32]
    mark = np.flatnonzero(code == 39)
    mark = mark[start[mark] & start[mark + 1] & ~fresh[mark + 1]]
    mark = mark[fresh[mark] | (code[mark - 1] != 32)]
    start[before_other] = True
    start[joins + 1] = False
    for tail in CONTRACTIONS:
        at = mark[mark + len(tail) < len(code)]
        for i, c in enumerate(tail, 1):
            at = at[(code[at + i] == ord(c)) & ~fresh[at + i]]
        start[at + 1] = False
        start[at + 1 + len(tail)] = True
    found = np.flatnonzero(start[:-1])
    return found if place is None else place[found]


class Tokenizer:
    """Texts to ids, from the JSON of a byte-level BPE tokenizer; raises where its fields ask for another way."""

    def __init__(self, spec: bytes):
        read = json.loads(spec)
        for field, (wanted,) in EXPECTED.items():
            for part in read[field] if isinstance(read.get(field), list) else [read.get(field)]:
                if any((part or {}).get(k, v) != v for k, v in (wanted or {}).items()) or (wanted is None) != (part is None):
                    raise ValueError(f"not this kind of tokenizer: {field} is {part if field != 'model' else 'another one'}")
        byte = printable_bytes()
        raw = lambda s: bytes(byte[c] for c in s)
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in read["model"]["merges"]]
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.automaton = Automaton(Gadgets({raw(k): v for k, v in read["model"]["vocab"].items() if k not in special}, merges))
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and offsets of each text's."""
        start = word_starts(data, offsets)
        edges = np.r_[start, len(data)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids, at = self.automaton.run(words.dictionary)
        each = words.indices.to_numpy()
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64) * 4), pa.py_buffer(ids.astype("<u4"))])
        taken = packed.take(pa.array(each))
        flat = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        until = np.r_[0, np.cumsum(np.diff(at)[each])]
        return flat[: until[-1]], until[np.searchsorted(edges, offsets)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (little-endian unsigned 32-bit integers), and offsets of each text's; null is empty."""
        data, offsets = text_bytes(texts)
        marked = [i for s in self.special for i in np.flatnonzero(pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False))]
        if not marked:
            return self._encode(data, offsets)
        parts, owner, named = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            for part in self.cut.split(text or ""):
                parts.append("" if part in self.special else part)
                named.append(self.special.get(part, -1))
                owner.append(i)
        ids, at = self._encode(*text_bytes(pa.array(parts, pa.large_string())))
        named, owner, size = np.array(named), np.array(owner), np.diff(at)
        size = size + (named >= 0)
        until = np.r_[0, np.cumsum(size)]
        out = np.zeros(until[-1], "<u4")
        out[until[:-1][named >= 0]] = named[named >= 0]
        plain = np.ones(len(out), bool)
        plain[until[:-1][named >= 0]] = False
        out[plain] = ids
        return out, until[np.searchsorted(owner, np.arange(len(texts) + 1))]


class Decoder:
    """Emits the labels of the automaton's arcs; needs nothing else of it."""

    def __init__(self, spec: bytes):
        read = json.loads(spec)
        byte = printable_bytes()
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        labels = {v: bytes(byte[c] for c in k) for k, v in read["model"]["vocab"].items() if k not in special} | {v: k.encode() for k, v in special.items()}
        self.size = max(labels, default=-1) + 1
        self.labels = pa.array([labels.get(i, b"") for i in range(self.size + 1)], pa.large_binary())
        self.length = np.array([len(x.as_py()) for x in self.labels])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """A text for each range of ids.  Bytes that aren't UTF-8 become U+FFFD; ids out of the vocabulary emit nothing."""
        known = np.minimum(ids, self.size).astype(np.int64)
        data = self.labels.take(pa.array(known)).buffers()[2] or pa.py_buffer(b"")
        until = np.r_[0, np.cumsum(self.length[known])][offsets]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(until.astype(np.int64)), data])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())


_made: dict[tuple, object] = {}


def made(kind: type, spec: bytes):
    """Compiled once in each worker."""
    key = (kind, hash(spec))
    if key not in _made:
        if len(_made) > 3:
            _made.clear()
        _made[key] = kind(spec)
    return _made[key]


def read_spec(spark: SparkSession, path: str, most: int = 64 << 20):
    """The tokenizer file, broadcast; its size is checked, as every worker compiles it whole."""
    with open(path, "rb") as f:
        spec = f.read(most + 1)
    if len(spec) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return spark.sparkContext.broadcast(spec)


def packed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * 4), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())


def blocks(batches: Iterator[pa.Array], most: int = BLOCK) -> Iterator[pa.Array]:
    """Runs of rows of about `most` bytes, so that what is made of one is small too."""
    for batch in batches:
        size = pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in spans(np.r_[0, np.cumsum(size)], most):
            yield batch.slice(a, b - a)


def encode(text: Column, spec) -> Column:
    """The ids of whole texts, packed as little-endian unsigned 32-bit integers; null and empty texts have none."""

    @arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = made(Tokenizer, spec.value)
        for texts in blocks(batches):
            yield packed(*coder.encode(texts))

    return of(text)


def decode(ids: Column, spec) -> Column:
    """The text of packed ids; of null, the empty text."""

    @arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = made(Decoder, spec.value)
        for some in blocks(batches):
            data, offsets = text_bytes(some)
            yield coder.decode(np.frombuffer(data.tobytes(), "<u4"), offsets // 4).cast(pa.string())

    return of(ids)


def both_ways(text: Column, spec) -> Column:
    """encode and decode of its ids in one worker: a struct of ids and decoded."""

    @arrow_udf("ids binary, decoded string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, decoder = made(Tokenizer, spec.value), made(Decoder, spec.value)
        for texts in blocks(batches):
            ids, offsets = coder.encode(texts)
            yield pa.StructArray.from_arrays([packed(ids, offsets), decoder.decode(ids, offsets).cast(pa.string())], names=["ids", "decoded"])

    return of(text)


def with_tokens(docs: DataFrame, spec, text: str = "text") -> DataFrame:
    """docs with ids (packed), n_tokens and decoded.

    A null text counts as empty: no ids, and decoded is empty.  Each row has its own result, so ties and repeated rows
    are kept; an empty table gives none.  Columns ids, n_tokens and decoded are replaced where docs has them, all others
    pass through.
    """
    coded = fresh(docs, "coded")
    found = docs.withColumn(coded, both_ways(F.col(text), spec))
    return found.withColumns({"ids": F.col(coded)["ids"], "n_tokens": (F.length(F.col(coded)["ids"]) / 4).cast("long"), "decoded": F.col(coded)["decoded"]}).drop(coded)
