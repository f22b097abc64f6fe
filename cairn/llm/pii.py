"""Personal data replaced by surrogates, with DataFrame and SQL functions only.

Entities are found by one pattern with an alternative for each kind.  An entity's canonical form (lower-case, or digits
only) names it wherever and however it's written; a keyed hash of kind and canonical form gives each of its letters and
digits a replacement of the same class and script, so layout, length, case and check digits stay.  Over the distinct
entities of all texts, surrogates that coincide with each other or with an entity that occurs are drawn anew until none
does: different entities stay different, equal ones equal, across all texts.

Names are found after titles and, if asked for, where words that the corpus has after titles stand beside each other
without one.  Each word of a name is an entity of its own, so a person's surrogate is the same under any
title and in any order; and a text's name words are replaced wherever in the text they stand, with a title or without.
Whether a given name's surrogate ends as a woman's or a man's is settled once for all texts, by the titles before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh, written

_GAP = r"[^\p{L}\p{N}]{1,6}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles before names, by gender: f, m, or x for either.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κύριος"],
    "x": ["Dr", "Prof"],
}
_TITLE = "|".join(t for group in TITLES.values() for t in sorted(group, key=len, reverse=True))
#: Patterns by kind; where two fit at a place, the first does.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)*?\.\p{L}{2,}",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:\+\d{{1,3}}{_GAP})?\(\d{{2,4}}\){_GAP}\d{{3,4}}[^\p{{L}}\p{{N}}]\d{{3,4}}(?!\d)|\+\d{{1,3}}(?:[ .\-/]?\d{{2,4}}){{2,5}}(?!\d)|(?<![\d\-])\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}(?![\d\-])|0(?<![\p{{L}}\p{{N}}.,/\-]0)(?=(?:[ \-/.]?\d){{8,11}}(?![ \-/.]?\d))\d{{1,4}}(?:[ \-/.]\d{{2,8}}){{1,4}}(?![\p{{L}}\p{{N}}])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?\d{4}){2} ?\d{3})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\d])\d(?:[ \-]?\d){12,18}(?!\d)",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?=[A-Za-z]*+\d)(?=\d*+[A-Za-z])[A-Za-z0-9]{24,}+)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Words within names that are no names.
PARTICLES = ["van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "af", "av", "bin", "ibn", "al", "el", "y"]
_NAME = r"(?:\p{Lu}['\u2019])?\p{Lu}\p{L}+"
#: A title and the name after it: words of any number, with initials, particles and apostrophes.
_NEXT = rf"(?:[ \-](?:\p{{Lu}}\. ?)*+(?:(?:{'|'.join(PARTICLES)})[ \-])*+{_NAME})"
TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\b\.? (?:\p{{Lu}}\. ?)*+(?:(?:{'|'.join(PARTICLES)}) )*+{_NAME}{_NEXT}*+"
#: Words that could be a name, whatever is before them: two or more, with initials, particles and apostrophes.
RUN = rf"(?<![\p{{L}}\p{{N}}]){_NAME}{_NEXT}++"
#: What a text with any entity but names has, and one with names.
_SIGN = r"[@]|\d[^\p{L}]*\d[^\p{L}]*\d|\d[a-zA-Z]|[A-Za-z0-9]{20}"
_TITLE_SIGN = rf"(?:{_TITLE})\b"
#: Letters by script: lower-case consonants and vowels, and all.
_SCRIPTS = {
    "Cyrillic": ("бвгдзклмнпрст", "аеиоу", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    "Greek": ("βγδζθκλμνπρστ", "αειου", "αβγδεζηθικλμνξοπρστυφχψω"),
    "Latin": ("bdfgklmnprstv", "aeiou", "abcdefghijklmnopqrstuvwxyz"),
}
_BYTES = 128


def _titled(text: Column) -> Column:
    """Of each titled name of a text, the words."""
    found = F.regexp_extract_all(text, F.lit(TITLED), F.lit(0))
    return F.transform(found, lambda t: F.regexp_extract_all(F.substring(t, F.length(_title(t)) + 1, F.length(t)), F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))


def name_words(text: Column) -> Column:
    """The words of names in a text, each once, also in capitals; of null, none."""
    words = F.flatten(_titled(text))
    words = F.array_distinct(F.concat(words, F.transform(words, F.upper)))
    return F.when(text.rlike(_TITLE_SIGN), words).otherwise(F.array().cast("array<string>"))


def known_names(docs: DataFrame, least: int, text: str = "text") -> DataFrame:
    """Words in lower case that stand in titled names of `least` or more different texts: column word."""
    words = F.transform(name_words(F.col(text)), F.lower)
    each = docs.select(F.xxhash64(text).alias("h"), F.explode(words).alias("word")).distinct()
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def untitled(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Of texts in which two known words follow each other as a name's would: h (a hash of the text) and these words.

    They are given as the text writes them, in capitals, and with a capital first.  known: column word, each once.  It is
    joined with the pairs of each text, so known words may be of any number.
    """
    runs = F.transform(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)), lambda r: F.regexp_extract_all(r, F.lit(r"\p{Lu}\p{L}+"), F.lit(0)))
    pairs = F.flatten(F.transform(runs, lambda w: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda second, i: F.struct(w[i].alias("first"), second.alias("second")))))
    each = docs.select(F.xxhash64(text).alias("h"), F.explode(F.array_distinct(pairs)).alias("p")).select("h", "p.first", "p.second")
    for side in ("first", "second"):
        each = each.join(known, F.lower(side) == F.col("word"), "left_semi")
    words = each.select("h", F.explode(F.array("first", "second")).alias("word"))
    capital = F.concat(F.substring("word", 1, 1), F.lower(F.substring(F.col("word"), F.lit(2), F.length("word"))))
    return words.select("h", F.explode(F.array("word", F.upper("word"), capital)).alias("word")).groupBy("h").agg(F.sort_array(F.collect_set("word")).alias("words"))


def _with_names(docs: DataFrame, names: str, hashed: str, more: DataFrame | None, text: str) -> DataFrame:
    """docs with a column of each text's name words; with more (columns h and words), also of its hash."""
    found = docs.withColumn(names, name_words(F.col(text)))
    if more is None:
        return found
    words = fresh(found, "words_of")
    found = found.withColumn(hashed, F.xxhash64(text)).join(more.toDF(hashed, words), hashed, "left")
    return found.withColumn(names, F.array_distinct(F.concat(names, F.coalesce(words, F.array().cast("array<string>"))))).drop(words)


def pattern_with(names: Column) -> Column:
    """PATTERN with an alternative for the given words, which are letters only."""
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def entities(text: Column, names: Column | None = None) -> Column:
    """All entities of a text in order, as it writes them; of null, none.  names: its name_words."""
    names = name_words(text) if names is None else names
    found = F.when(F.size(names) > 0, F.regexp_extract_all(text, pattern_with(names), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return F.when((F.size(names) > 0) | text.rlike(_SIGN), found).otherwise(F.array().cast("array<string>"))


def kind(raw: Column) -> Column:
    """The kind of an entity; `number` for one that only looks like a card, as its check digit is wrong."""
    found = F.lit("name")
    for k in reversed(KINDS):
        what = F.when(_valid_card(raw), "card").otherwise("number") if k == "card" else F.lit(k)
        found = F.when(raw.rlike(f"^(?:{KINDS[k]})$"), what).otherwise(found)
    return found


def _title(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^(?:(?:{_TITLE})\b\.? )?", 0)


def canonical(raw: Column, kind: Column) -> Column:
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind == "secret", raw).otherwise(F.lower(raw))


def female(canonical: Column) -> Column:
    """What a name's own ending says, where titles don't."""
    return canonical.rlike("[a\u03b1\u03b7\u0430\u044f]$")


def _pick(letters: str, v: Column) -> Column:
    return F.substring(F.lit(letters), (v % len(letters)).cast("int") + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits that ends before the check digit."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: (c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn(digits) % 10) % 10).cast("string")


def _valid_card(raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.right(digits, F.lit(1)) == _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def described(raws: Column) -> Column:
    """Of an array of entities, structs of raw, kind and canonical."""
    kinds = F.transform(raws, lambda r: F.struct(r.alias("raw"), kind(r).alias("kind")))
    return F.transform(kinds, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"), canonical(e["raw"], e["kind"]).alias("canonical")))


def _mod97(whole: Column) -> Column:
    """The remainder by 97 of an account number's digits and letters (a letter counts as 10 to 35), its first four put last."""
    turned = F.concat(F.substring(whole, F.lit(5), F.length(whole)), F.substring(whole, F.lit(1), F.lit(4)))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda n, v: (n * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _with_check_digits(iban: Column, compact: Column) -> Column:
    """An account number, spaces and all, with the two check digits that make it valid."""
    zeros = F.concat(F.substring(compact, F.lit(1), F.lit(2)), F.lit("00"), F.substring(compact, F.lit(5), F.length(compact)))
    return F.concat(F.substring(iban, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(zeros)).cast("string"), 2, "0"), F.substring(iban, F.lit(5), F.length(iban)))


#: Country calling codes: those of one digit and of two; all others have three.
_CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _byte(stream: Column, n: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(n - 1, F.lit(_BYTES)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _replacement(e: Column, c: Column) -> Column:
    """Of a character c (struct of c, low, n and v) of entity e: n counts letters and digits, v is the n-th byte."""
    low, n, v = c["low"], c["n"], c["v"]

    def of(script: str) -> Column:
        consonants, vowels, letters = _SCRIPTS[script]
        named = F.when((n == e["letters"]) & e["female"], vowels[0]).when((n == e["letters"]) | (n % 2 == 1), _pick(consonants, v)).otherwise(_pick(vowels, v))
        return F.when(e["kind"] == "name", named).otherwise(_pick(letters, v))

    new = F.when(low.rlike(r"\p{IsCyrillic}"), of("Cyrillic")).when(low.rlike(r"\p{IsGreek}"), of("Greek")).when(e["is_hex"], _pick("abcdef", v)).otherwise(of("Latin"))
    new = F.when(c["c"] != low, F.upper(new)).otherwise(new)
    kept = n <= e["kept"]
    return F.when(kept | ~low.rlike(r"[\p{L}\p{N}]"), c["c"]).when(low.rlike(r"\p{N}"), (v % 10).cast("string")).otherwise(new)


def _with(e: Column, names: list[str], **more: Column) -> Column:
    return F.struct(*[e[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


#: Draws that keep a layout of few surrogates (names, addresses), and one of many; later ones widen it, so that none run out.
KEPT, KEPT_LONG = 8, 16


def surrogates(found: Column, key: str) -> Column:
    """Of an array of structs (raw, kind, canonical, attempt, female), the replacements, laid out as raw is.

    A phone number's first digit or country calling code stays, a card's first digit and an account number's country; check
    digits of cards and account numbers are made right.  After KEPT attempts, names and the first parts of addresses grow by
    a letter an attempt, and numbers of IP addresses may have other lengths; after KEPT_LONG, numbers and secrets grow by a
    digit an attempt.  Each step names what the next ones use more than once.
    """
    grown = lambda c, e, after: F.repeat(F.lit(c), F.greatest(e["attempt"] - (after - 1), F.lit(0)))
    more = lambda e: F.when(e["kind"].isin("name", "email"), grown("a", e, KEPT)).when(e["kind"] == "ip", "").otherwise(grown("0", e, KEPT_LONG))
    kept = lambda e: F.when(e["kind"] == "phone", F.greatest(F.length(F.regexp_extract(e["raw"], _CALLING, 0)) - 1, F.lit(1))).when(e["kind"] == "card", 1).when(e["kind"] == "iban", 2).otherwise(0)
    seed = F.transform(found, lambda e: _with(e, ["raw", "kind", "attempt", "female"], seed=F.concat_ws("|", F.lit(key), e["kind"], e["canonical"], e["attempt"].cast("string")), more=more(e), tail=F.when(e["kind"] == "email", F.regexp_extract(e["raw"], r"\.\p{L}+$", 0)).otherwise("")))
    own = lambda e: F.substring(e["raw"], F.lit(1), F.length(e["raw"]) - F.length(e["tail"]))
    body = F.transform(seed, lambda e: _with(e, ["raw", "kind", "attempt", "female", "tail"], stream=F.concat(F.sha2(e["seed"], 512), F.sha2(F.concat(e["seed"], F.lit("|+")), 512)), body=F.when(e["kind"] == "email", F.concat(e["more"], own(e))).otherwise(F.concat(own(e), e["more"]))))
    marked = F.transform(body, lambda e: _with(e, ["raw", "kind", "attempt", "female", "tail", "stream", "body"], is_hex=(e["kind"] == "secret") & e["raw"].rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), letters=F.length(e["body"]), kept=kept(e)))

    def spelled(e: Column) -> Column:
        chars = F.transform(F.filter(F.split(e["body"], ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), F.lower(c).alias("low"), F.length(F.regexp_replace(F.substring(e["body"], F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")).alias("n")))
        valued = F.transform(chars, lambda c: _with(c, ["c", "low", "n"], v=_byte(e["stream"], c["n"])))
        return F.array_join(F.transform(valued, lambda c: _replacement(e, c)), "")

    def octets(e: Column) -> Column:
        parts = F.transform(F.split(e["raw"], r"\."), lambda o, i: F.struct(F.length(o).alias("n"), _byte(e["stream"], i * 2 + 1).alias("v"), _byte(e["stream"], i * 2 + 2).alias("w")))
        kept = lambda o: F.when(o["n"] == 1, 1 + o["v"] % 9).when(o["n"] == 2, 10 + o["v"] % 90).otherwise(100 + o["v"] % 155)
        return F.array_join(F.transform(parts, lambda o: F.when(e["attempt"] < KEPT, kept(o)).otherwise(1 + (o["v"] * 256 + o["w"]) % 254).cast("string")), ".")

    drawn = F.transform(marked, lambda e: _with(e, ["raw", "kind"], new=F.when(e["kind"] == "number", e["raw"]).when(e["kind"] == "ip", octets(e)).otherwise(F.concat(spelled(e), e["tail"]))))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    fronts = F.transform(drawn, lambda e: _with(e, ["kind", "new"], front=F.when(e["kind"] == "iban", F.replace(e["new"], F.lit(" "), F.lit(""))).otherwise(F.substring(e["new"], F.lit(1), F.length(e["new"]) - 1))))
    checked = lambda e: F.when(e["kind"] == "card", F.concat(e["front"], _check_digit(digits(e["front"])))).when(e["kind"] == "iban", _with_check_digits(e["new"], e["front"]))
    return F.transform(fronts, lambda e: F.coalesce(checked(e), e["new"]))


def _votes(text: Column, names: Column) -> Column:
    """Structs raw, votes: for each titled name of two words or more its first word, with 1 for a woman's title, -1 for a man's."""
    woman, man = (rf"^(?:{'|'.join(TITLES[g])})\b" for g in "fm")
    titles = F.regexp_extract_all(text, F.lit(TITLED), F.lit(0))
    pairs = F.arrays_zip(titles.alias("t"), _titled(text).alias("w"))
    some = F.filter(pairs, lambda p: (F.size(p["w"]) > 1) & (p["t"].rlike(woman) | p["t"].rlike(man)))
    each = F.transform(some, lambda p: F.struct(p["w"][0].alias("raw"), F.when(p["t"].rlike(woman), 1).otherwise(-1).alias("votes")))
    return F.when(F.size(names) > 0, each).otherwise(F.array().cast("array<struct<raw:string,votes:int>>"))


def redrawn(docs: DataFrame, key: str, text: str = "text", max_rounds: int = 60, more: DataFrame | None = None) -> DataFrame:
    """The entities that aren't as their own text says: kind, canonical, attempt (from 0) and female.

    These are entities whose first surrogate isn't theirs to keep, and names whose titles say otherwise than their ending.
    Of entities that share a surrogate, in any of the ways that they are written, the smallest canonical form keeps it.
    Needs the distinct entities only; each round is a written table.  Raises if some entities find no free surrogate.
    more: names without titles, as untitled gives them.
    """
    t, names = F.col("t"), F.col("names")
    named = _with_names(docs.select(F.col(text).alias("t")), "names", "h", more, "t")
    plain = F.transform(F.array_distinct(entities(t, names)), lambda r: F.struct(r.alias("raw"), F.lit(0).alias("votes")))
    raw = named.select(F.inline(F.concat(plain, _votes(t, names)))).groupBy("raw").agg(F.sum("votes").alias("votes"))
    known = raw.select("votes", F.inline(described(F.array("raw")))).where("kind <> 'number'")
    found = written(known)
    votes = found.groupBy("kind", "canonical").agg(F.sum("votes").alias("sum"))
    woman = F.when(F.col("sum") != 0, F.col("sum") > 0).otherwise(female(F.col("canonical"))) & (F.col("kind") == "name")
    who = written(votes.select("kind", "canonical", woman.alias("female")))
    now = found.select("kind", "canonical", "raw").join(who, ["kind", "canonical"]).withColumn("attempt", F.lit(0))
    for _ in range(max_rounds):
        drawn = now.withColumn("s", surrogates(F.array(F.struct("raw", "kind", "canonical", "attempt", "female")), key)[0])
        drawn = written(drawn.withColumn("s", canonical(F.col("s"), F.col("kind"))))
        taken = drawn.groupBy("kind", "s").agg(F.min("canonical").alias("keeps"), F.max("canonical").alias("other")).where("keeps <> other").select("kind", "s", "keeps")
        lost = drawn.join(taken, ["kind", "s"]).where("canonical <> keeps").select("kind", "canonical")
        real = drawn.join(found.select("kind", F.col("canonical").alias("s")), ["kind", "s"], "left_semi").select("kind", "canonical")
        again = written(lost.unionByName(real).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            own = female(F.col("canonical")) & (F.col("kind") == "name")
            return drawn.where((F.col("attempt") > 0) | (F.col("female") != own)).select("kind", "canonical", "attempt", "female").distinct()
        now = drawn.drop("s").join(again, ["kind", "canonical"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    raise RuntimeError("surrogates: too few free ones")


def replaced(docs: DataFrame, key: str, text: str = "text", learn: int = 0) -> DataFrame:
    """docs with entities in text replaced, and n_entities; a null text stays null and has none.

    learn: words that are in titled names of so many different texts, or more, are names without a title, too, in texts
    where two of them follow each other; with 0, names are those of the text's own titles only.

    Each row has its own result, so ties and repeated rows are kept; an empty table gives none.  A column n_entities is
    replaced where docs has one, all others pass through.
    """
    more = None
    if learn:
        known = written(known_names(docs, learn, text))
        if not known.isEmpty():
            more = written(untitled(docs, known, text))
    special = written(redrawn(docs, key, text, more=more).withColumn("name", F.concat_ws("|", "kind", "canonical")))
    names, listed, hashed, drawn = (fresh(docs, n) for n in ("names_of", "entities_of", "hash_of", "drawn_of"))
    found = _with_names(docs, names, hashed, more, text).withColumn(listed, described(entities(F.col(text), F.col(names))))
    of = lambda e: F.lit(None).cast("struct<attempt:int,female:boolean>")
    if not special.isEmpty():
        # texts with such entities, by a hash of the text: a text that shares the hash gets names that it doesn't have
        at = found.where(F.size(listed) > 0).select(F.xxhash64(text).alias("h"), F.explode(listed).alias("e"))
        at = at.select("h", F.concat_ws("|", "e.kind", "e.canonical").alias("name")).distinct().join(special.select("name", "attempt", "female"), "name")
        maps = written(at.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("attempt", "female")))).alias(drawn)).withColumnRenamed("h", hashed))
        found = (found if more is not None else found.withColumn(hashed, F.xxhash64(text))).join(maps, hashed, "left")
        of = lambda e: F.try_element_at(F.col(drawn), F.concat_ws("|", e["kind"], e["canonical"]))
    known = F.transform(listed, lambda e: _with(e, ["raw", "kind", "canonical"], of=of(e)))
    known = F.transform(known, lambda e: _with(e, ["raw", "kind", "canonical"], attempt=F.coalesce(e["of"]["attempt"], F.lit(0)), female=F.coalesce(e["of"]["female"], female(e["canonical"]))))
    between = F.when(F.size(names) > 0, F.split(F.col(text), pattern_with(F.col(names)), -1)).otherwise(F.split(F.col(text), PATTERN, -1))
    parts = F.zip_with(between, F.concat(surrogates(known, key), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    whole = F.when(F.size(listed) > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return found.withColumns({text: whole, "n_entities": F.size(F.filter(listed, lambda e: e["kind"] != "number"))}).drop(names, listed, drawn, hashed)
