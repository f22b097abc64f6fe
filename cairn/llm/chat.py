"""Chat formatting: turns of typed parts become one training text with placeholders, a loss mask and attachments.

A visitor has one method for each kind of part.  Text is escaped, so that it can't be taken for markup; images, audio
and documents become placeholders whose numbers lead to attachment rows, with the number of tokens that each expands
to.  Turns are formatted one by one; a conversation is its turns' texts in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fresh

#: The type of a message's parts. What doesn't apply to a kind is null.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Template:
    """Marks turns as `begin` + role + `middle` + text + `end`; `escape` goes before each control character in a text."""

    begin: str = "### "
    middle: str = ": "
    end: str = " </turn>\n"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)

    def control(self) -> tuple[str, ...]:
        """Characters of which each mark and placeholder has one, so none can arise within or between texts."""
        return ("#", "<", ":")


class Visitor:
    """What each kind of part becomes: a placeholder or text, its attachment reference and its expanded token count.

    Counts: an image takes a token for each `patch` x `patch` pixels, sides rounded up; audio takes `rate` tokens a
    second, rounded up; a document takes `per_page` tokens a page.  Unknown sizes count as one patch, second or page, and
    no size counts as less than none.
    """

    def __init__(self, template: Template, patch: int = 14, rate: int = 25, per_page: int = 256):
        self.template, self.patch, self.rate, self.per_page = template, patch, rate, per_page

    def text(self, part: Column) -> Column:
        return self._piece(escaped(part["text"], self.template), F.lit(None).cast("string"), F.lit(0))

    def image(self, part: Column) -> Column:
        side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / self.patch)
        return self._piece(F.lit("<|image|>"), part["ref"], side(part["width"]) * side(part["height"]))

    def audio(self, part: Column) -> Column:
        return self._piece(F.lit("<|audio|>"), part["ref"], F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * self.rate))

    def document(self, part: Column) -> Column:
        return self._piece(F.lit("<|document|>"), part["ref"], F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(0)) * self.per_page)

    def other(self, part: Column) -> Column:
        """A kind without a method keeps its place, takes no tokens and keeps its reference."""
        return self._piece(F.lit("<|unknown|>"), part["ref"], F.lit(0))

    def visit(self, part: Column) -> Column:
        kinds = {k: getattr(self, k) for k in ("text", "image", "audio", "document")}
        found = self.other(part)
        for k, method in kinds.items():
            found = F.when(part["kind"] == k, method(part)).otherwise(found)
        return found

    @staticmethod
    def _piece(text: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(text.alias("text"), ref.alias("ref"), tokens.cast("long").alias("tokens"))


def escaped(text: Column, template: Template) -> Column:
    """Text in which the escape character goes before itself and before each control character; null is empty."""
    found = F.replace(F.coalesce(text, F.lit("")), F.lit(template.escape), F.lit(template.escape * 2))
    for c in template.control():
        found = F.replace(found, F.lit(c), F.lit(template.escape + c))
    return found


def unescaped(text: str, template: Template) -> str:
    """Takes escapes back: of each escape character, the character after it stays."""
    first, *rest = text.split(template.escape)
    found, literal = [first], False
    for part in rest:
        if literal or part:
            found.append(part)
            literal = False
        else:  # two in a row: the second is text, and so is what follows it
            found.append(template.escape)
            literal = True
    return "".join(found)


def formatted(turns: DataFrame, template: Template | None = None, visitor: Visitor | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Each turn's row with formatted (its text), loss_start and loss_length (code points within formatted; length 0
    where the role isn't trained on), attachments (array of kind-ordered struct ref, tokens) and expanded_tokens.

    A conversation's text is its rows' formatted in the order of turn.  Null parts are left out, null parts arrays and
    null texts are empty, a null role is empty.  Roles are escaped like texts.  The loss mask covers a turn's text
    without its marks.  Repeated rows are repeated turns; an empty table gives none; columns named as results are replaced.
    """
    template = template or Template()
    visitor = visitor or Visitor(template)
    pieces = F.transform(F.filter(F.coalesce(F.col(parts), F.array().cast(PARTS)), lambda p: p.isNotNull()), visitor.visit)
    made = fresh(turns, "pieces_of")
    rows = turns.withColumn(made, pieces)
    head = F.concat(F.lit(template.begin), escaped(F.col(role), template), F.lit(template.middle))
    body = F.array_join(F.transform(made, lambda p: p["text"]), "")
    placed = F.filter(made, lambda p: p["text"].startswith("<|"))
    return rows.withColumns({
        "formatted": F.concat(head, body, F.lit(template.end)),
        "loss_start": F.length(head),
        "loss_length": F.when(F.coalesce(F.col(role), F.lit("")).isin(*template.trained), F.length(body)).otherwise(0),
        "attachments": F.transform(placed, lambda p: F.struct(p["ref"].alias("ref"), p["tokens"].alias("tokens"))),
        "expanded_tokens": F.aggregate(made, F.lit(0).cast("long"), lambda n, p: n + p["tokens"]),
    }).drop(made)


def text_parts(text: Column) -> Column:
    """A plain text as one text part."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(k) for k, t in empty.items()]))


def parsed(text: str, template: Template) -> tuple[str, str]:
    """Role and text of a formatted turn, with placeholders as they are; raises where it isn't one."""
    if not text.startswith(template.begin) or not text.endswith(template.end):
        raise ValueError("not a turn")
    inner, i = text[len(template.begin) : len(text) - len(template.end)], 0
    while inner[i] != ":":
        i += 2 if inner[i] == template.escape else 1
    return unescaped(inner[:i], template), unescaped(inner[i + len(template.middle) :], template)


def read_back(turns: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row a conversation, read from formatted turns: its digests, as of the query op7.

    Turns are dealt out by conversation and sorted, and digests are fed turn by turn, so a task holds one batch of
    turns whatever the length of a conversation.  Rows of the same turn go by their text; null ids are one conversation.
    """
    template = template or Template()
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), "formatted", "loss_start", "loss_length")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def close():
            if now is not None:
                key, n, all_text, chars, loss, total = now
                done.append((key, n, all_text.hexdigest(), chars, loss.hexdigest(), total))

        def flushed():
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[x.split()[0] for x in schema.split(", ")])
            done.clear()
            return rows

        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            kinds[0] = batch["conv_id"].type
            for key, text, start, length in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length"))):
                if now is None or now[0] != key:
                    close()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parsed(text, template)
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
                if length:
                    trained = unescaped(text[start : start + length], template)
                    now[3] += len(trained)
                    now[4].update(trained.encode())
                now[5] += len(text)
            if len(done) > 5000:
                yield flushed()
        close()
        if done:
            yield flushed()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").drop("turn").mapInArrow(digests, schema)
