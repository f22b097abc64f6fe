"""Encoding, chat formatting, tiling and surrogates against plain versions and round trips."""

import hashlib
import json
import random
import re
import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, pii, tiling
from cairn.llm.common import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "é" * 3000, "x" * 70000, "word " * 20000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't\n\n  stop 123 ١٢٣ 你好 👍🏽", "\u0000\u0085\u2028"]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        spec = f.read()
    return bpe.Tokenizer(spec), bpe.Decoder(spec)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding(reference, own, text):
    ids, at = own[0].encode(pa.array([text, None, text + "<|endoftext|>"]))
    want = reference.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 + [50256] and at.tolist() == [0, len(want), len(want), len(ids)]
    assert own[1].decode(ids, at).to_pylist() == [text, "", text + "<|endoftext|>"]


def merged(word, merges):
    """Byte-pair encoding by its definition: the earliest merge first, left to right."""
    parts = list(word)
    while True:
        ranks = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranks:
            return parts
        a, b = next(p for p, r in merges.items() if r == min(ranks)[0])
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def random_merges(draw):
    tokens, merges = [bytes([c]) for c in b"abc"], {}
    while len(merges) < 14:
        a, b = draw.choice(tokens), draw.choice(tokens)
        if a + b not in tokens:
            merges[a, b] = len(merges)
            tokens.append(a + b)
    return tokens, merges


def automaton_of(tokens, merges, **how):
    return bpe.Automaton(bpe.Gadgets({t: i for i, t in enumerate(tokens)}, list(merges)), **how)


@pytest.mark.parametrize("how", [{}, {"most": 2, "chunk": 5}])
def test_automata_of_random_merges(how):
    """Against the definition; also with tables that are begun anew all the time, and words longer than a chunk."""
    draw = random.Random(9)
    for _ in range(60):
        tokens, merges = random_merges(draw)
        automaton = automaton_of(tokens, merges, **how)
        words = [bytes(draw.choices(b"abc", k=draw.randint(0, 14))) for _ in range(60)]
        ids, at = automaton.run(pa.array(words, pa.binary()))
        for i, word in enumerate(words):
            assert [tokens[t] for t in ids[at[i] : at[i + 1]]] == merged([bytes([c]) for c in word], merges)
    with pytest.raises(ValueError):
        automaton.run(pa.array([b"z"], pa.binary()))


def test_automaton_is_deterministic():
    """Each state has one move a byte, whatever the order in which words ask for them; threads hold what gadgets lost."""
    draw = random.Random(11)
    for _ in range(20):
        tokens, merges = random_merges(draw)
        words = [bytes(draw.choices(b"abc", k=9)) for _ in range(80)]
        seen = []
        for order in (words, words[::-1]):
            automaton = automaton_of(tokens, merges)
            for word in order:
                automaton.run(pa.array([word], pa.binary()))
            name = [(frozenset(automaton.threads[t] for t in threads), last) for threads, last in automaton.sets]
            assert len(set(name)) == len(name)
            seen.append({(name[s], b): name[automaton.moves[s, b]] for s in range(len(name)) for b in b"abc" if automaton.moves[s, b]})
        assert seen[0] == seen[1]
        gadgets = automaton.gadgets
        for x in gadgets.labels:
            for y in gadgets.labels:
                missing = dict(gadgets.missing(x, gadgets.labels[y][0]))
                assert gadgets.has_arc(x, y) != automaton._blocked(y, missing)


def test_words(own):
    """Cut by arrays as the pattern cuts them, texts one after the other."""
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    draw = random.Random(12)
    texts = ["".join(draw.choices("'strevmld aB1 \n\t \u00e9\u06619!?x\u2003\U0001f44d", k=draw.randint(0, 14))) for _ in range(5000)]
    data, offsets = text_bytes(pa.array(texts))
    starts = bpe.word_starts(data, offsets)
    cut = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)])]
    assert cut == [w for t in texts for w in pattern.findall(t)]


def test_every_character(reference, own):
    texts = [f"a{c}1 {c}!{c}" for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff"]
    ids, at = own[0].encode(pa.array(texts))
    for i, found in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert found.ids == ids[at[i] : at[i + 1]].tolist()


def test_other_tokenizers_are_refused():
    with open(PATH, "rb") as f:
        read = json.loads(f.read())
    for field, value in [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("model", read["model"] | {"ignore_merges": True}), ("pre_tokenizer", None)]:
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(read | {field: value}).encode())


def test_tokens_of_tables(spark, reference):
    spec = bpe.read_spec(spark, PATH)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)] + [(1, "", 6)], "doc_id long, text string, n_tokens int")
    for r in bpe.with_tokens(docs, spec).collect():
        want = reference.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == (r.text or "")
    assert bpe.with_tokens(docs.limit(0), spec).count() == 0
    raw = spark.createDataFrame([(bytearray(np.array([50256, 99999999, 0, 187], "<u4").tobytes()),), (None,)], "ids binary").select(bpe.decode(F.col("ids"), spec)).collect()
    assert raw[0][0] == "<|endoftext|>!�" or raw[0][0].startswith("<|endoftext|>!")
    assert raw[1][0] == ""
    with pytest.raises(ValueError):
        bpe.read_spec(spark, PATH, most=10)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#</turn>| :aé\n", max_size=30))
def test_escapes(text):
    t = chat.Template()
    out = text.replace(t.escape, t.escape * 2)
    for c in t.control():
        out = out.replace(c, t.escape + c)
    assert chat.unescaped(out, t) == text
    whole = t.begin + out + t.middle + out + t.end
    assert chat.parsed(whole, t) == (text, text)


def test_chat(spark):
    hard = [None, "", "\\### Assistant: </turn> ok", "#", "##", "<|image|>", " </turn>\n### user: x", "\\", "é👍" * 5000]
    rows = [(c, t, role, draw) for c in (1, 2, None) for t, (role, draw) in enumerate([(r, h) for h in hard for r in ("user", "assistant", None, "a:b#")])]
    rows += [(1, 0, "user", None), (3, 5, "assistant", "b"), (3, 5, "assistant", "a")]  # repeats and ties
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df.withColumn("parts", chat.text_parts(F.col("text"))).drop("text"))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c in (1, 2, None):
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: r[1])
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine)
        loss = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        assert got[c].n_turns == len(mine)
        if c != 1:  # conversation 1 has a tie whose order the formatted text decides
            assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert chat.read_back(out.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [("text", "a#", None, None, None, None, None), ("text", "##b", None, None, None, None, None), ("image", None, "i.png", 29, 14, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r, empty = chat.formatted(df).orderBy("turn").collect()
    assert r.formatted == "### user: a\\#\\#\\#b<|image|><|audio|><|document|><|unknown|> </turn>\n"
    assert [(a.ref, a.tokens) for a in r.attachments] == [("i.png", 3), ("a.wav", 38), ("d.pdf", 768), ("v", 0)]
    assert r.expanded_tokens == 3 + 38 + 768 and r.loss_length == 0
    assert empty.formatted == "### user:  </turn>\n" and empty.attachments == []


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def plain_tiles(doc, item, least):
    """Greedy string tiling by its definition: always the longest common run of free words."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = 0, 0, 0
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        n, i, j = best
        if n < least:
            return covered
        for k in range(n):
            free_d[i + k] = free_i[j + k] = False
        covered += n


def test_ids_of_any_type_and_sizes_of_any_sign(spark):
    items = spark.createDataFrame([("i1", "one two three four five six seven eight")], "item_id string, text string")
    docs = spark.createDataFrame([("a", "x one two three four five six seven eight y"), ("b", "nothing"), (None, None)], "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in tiling.contamination(docs, items).collect()] == [("a", "i1")]
    assert {r.doc_id for r in tiling.decontaminated(docs, items).collect()} == {"b", None}
    assert tiling.contamination(docs, items.limit(0)).count() == tiling.contamination(docs.limit(0), items).count() == 0
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [("c", 0, "user", [("audio", None, "u", None, None, -3.0, None), ("document", None, "u", None, None, None, -2)])]
    made = chat.formatted(spark.createDataFrame(rows, f"conv_id string, turn int, role string, parts array<{part}>"))
    assert made.first().expanded_tokens == 0 and chat.read_back(made).first().conv_id == "c"


def test_tiles():
    draw = random.Random(4)
    for trial in range(150):
        vocabulary = [f"w{i}" for i in range(draw.choice([2, 6, 200]))]
        item = draw.choices(vocabulary, k=draw.randint(1, 40))
        doc = draw.choices(vocabulary, k=draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):  # parts of the item, reordered
            a = draw.randint(0, len(item))
            at = draw.randint(0, len(doc))
            doc[at:at] = item[a : a + draw.randint(1, 25)]
        least = draw.choice([1, 3, 5])
        code = {w: np.uint64(i + 1) for i, w in enumerate(vocabulary)}
        got = tiling.tiles(np.array([code[w] for w in doc], np.uint64), np.array([code[w] for w in item], np.uint64), least)
        used_d, used_i = set(), set()
        for i, j, n in got:
            assert doc[i : i + n] == item[j : j + n] and n >= min(least, len(item))
            assert not used_d & set(range(i, i + n)) and not used_i & set(range(j, j + n))
            used_d |= set(range(i, i + n))
            used_i |= set(range(j, j + n))
        want = plain_tiles(doc, item, min(least, len(item)))
        assert sum(n for *_, n in got) == want


def test_contamination(spark):
    draw = random.Random(7)
    vocabulary = ["".join(draw.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, text(30)) for i in range(20)] + [(20, "Short one"), (None, text(30)), (21, None), (0, None)]
    items[0] = (0, "ÉTÉ " + items[0][1])
    w = items[3][1].split()
    docs = [
        (0, text(50) + " " + items[0][1].upper() + ". " + text(50)), (1, text(300)), (2, text(9) + " " + " ".join(w[20:] + ["x"] + w[10:20] + ["y"] + w[:10])),  # reordered
        (3, " ".join(w[:9])), (4, None), (5, ""), (6, "!! short, ONE !!"), (7, text(20000) + " " + items[5][1]), (None, items[6][1]), (0, text(40)), (1, items[7][1] + " " + items[8][1]),
    ]
    docs = docs + [docs[2]] + [(100 + i, items[9][1] + " " + text(3)) for i in range(40)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    found = tiling.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in found.collect())
    want = sorted([(0, 0), (2, 3), (2, 3), (6, 20), (7, 5), (-1, 6), (1, 7), (1, 8)] + [(100 + i, 9) for i in range(40)])
    assert got == want
    for i, (d, t) in enumerate(docs):  # against the plain version
        for j, s in items[:20]:
            full = plain_tiles(words_of(t or "")[-400:], words_of(s), 5) >= 0.5 * len(words_of(s)) if i < 12 else None
            if full is not None:
                assert full == ((-1 if d is None else d, j) in got and (d, t) not in [(0, docs[9][1]), (1, docs[1][1])])
    kept = tiling.decontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert tiling.contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert tiling.contamination(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_common_runs_lose_no_pair(spark):
    """Against all pairs of runs: items that share most of their words, a document with all of them, and rare ones."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices(string.ascii_lowercase, k=5))
    common = " ".join(word() for _ in range(20))
    items = [(i, f"{common} {' '.join(word() for _ in range(draw.randint(0, 30)))}") for i in range(25)]
    docs = [(i, draw.choice([common, items[i % 25][1], f"{common} {items[i % 25][1]}", items[i % 25][1][:90], " ".join(word() for _ in range(40))])) for i in range(80)]
    got = tiling.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((d, i) for d, t in docs for i, s in items if plain_tiles(words_of(t), words_of(s), 5) >= 0.5 * len(words_of(s)))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want and len(want) > 100


def test_names_of_columns_never_clash(spark):
    extra = {c: F.lit("kept") for c in ("id_of", "hash_of", "_id", "_hash", "coded", "row", "seeds", "pieces_of", "_pieces", "seed", "item")}
    docs = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string").withColumns(extra)
    items = spark.createDataFrame([(1, "some words of a text")], "item_id long, text string")
    assert [(r.doc_id, r.id_of, r.seeds) for r in tiling.decontaminated(docs, items).collect()] == [(2, "kept", "kept")]
    assert {(r.coded, r.id_of) for r in bpe.with_tokens(docs, bpe.read_spec(spark, PATH)).collect()} == {("kept", "kept")}
    turns = docs.withColumns({"conv_id": F.lit(1), "turn": F.col("doc_id"), "role": F.lit("user"), "parts": chat.text_parts(F.col("text"))})
    assert {(r.pieces_of, r._pieces) for r in chat.formatted(turns).collect()} == {("kept", "kept")}


CLEAN = "Version 2.0 of 1999, at 3.14 (17) or 12:30. All rights 555 reserved_1 x@y"


def test_surrogates(spark):
    one = "Write to Ann.Lee7@Mail.example.com or +1 (017) 555-7713 from 10.20.30.140, card 4111 1111 1111 1111, id 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\", Mrs. Anna Berg and Mr Иван Петров."
    two = "ann.lee7@mail.example.com again; 4111-1111-1111-1111; MRS. x"
    docs = spark.createDataFrame([(1, one, "q"), (2, two, None), (3, None, None), (4, "", None), (5, CLEAN, None), (2, two, None), (6, "w " * 50000 + one, None)], "doc_id long, text string, name string")
    rows = pii.replaced(docs, "key").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and got[3].text is None and got[3].n_entities == 0 and got[4].text == "" and got[5].text == CLEAN and got[1].name == "q"
    new = got[1].text
    assert len(new) == len(one) and got[1].n_entities == 10
    for secret in ("Ann.Lee7", "(017)", "10.20.30.140", "4111 1111 1111 1111", "123-45-6789", "04dbebab", "Anna Berg", "Иван", "Петров"):
        assert secret not in new
    assert got[6].text == "w " * 50000 + new  # coreference across texts
    mail = re.search(r"[\w.]+@[\w.]+", new)[0]
    assert got[2].text.split()[0] == mail.lower()
    card = re.search(r"card ([\d ]{19})", new)[1]
    digits = [int(c) for c in card if c.isdigit()]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0  # still a valid check digit
    assert card.replace(" ", "-") in got[2].text
    assert re.search(r"Mrs\. [A-Z][a-z]{2}a [A-Z][a-z]{3} and Mr [А-Я][а-я]{3} [А-Я][а-я]{5}\.", new)
    assert re.search(r'"[0-9a-f]{40}"', new) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} from \d\d\.\d\d\.\d\d\.\d{3},", new)
    assert pii.replaced(docs, "other").where("doc_id = 1").first().text != new
    assert pii.replaced(docs.limit(0), "key").count() == 0


def test_surrogates_stay_distinct(spark):
    """Addresses with few replacements: all two-digit octets but one would collide without checks."""
    rows = [(i, f"from 1.1.1.{i % 9 + 1} and 2.2.2.{i % 5 + 1}, 10.{i}.7.8") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {}
    for r in pii.replaced(docs, "k").collect():
        old, new = (re.findall(r"\d+\.\d+\.\d+\.\d+", t) for t in (dict(rows)[r.doc_id], r.text))
        for a, b in zip(old, new):
            assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
