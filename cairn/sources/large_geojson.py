"""Features of GeoJSON documents of any size, which several tasks read together.

Spark's text reader cuts a document at closing braces, and files at blocks of bytes, so a task begins anywhere.  What a
block does to the reader's state (within a string or not, how deep) is found for both states that it may begin in; the
blocks' few summaries are put one after the other; and then each block is read by itself.  Only features that a block's end
cuts meet their other parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.scratch import written

#: Blocks that are sent to all executors; beyond, pieces are dealt out by block.
MOST_BLOCKS = 200_000
_FEATURE = "type string, id string, properties string, geometry string"
_ESCAPED = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{\[\]]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"?', re.S)  # of a string that began before


def effect(piece: str, inside: bool) -> tuple[bool, int]:
    """Of a piece and the brace after it: whether it ends within a string, and how much deeper it ends."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    outside = "".join(parts[1 if inside else 0 :: 2])
    ends = inside != (len(parts) % 2 == 0)
    deeper = outside.count("{") + outside.count("[") - outside.count("]") - (not ends)
    return ends, deeper


def opening(piece: str, inside: bool, depth: int, level: int) -> int | None:
    """Where in a piece an object begins at a depth of `level`, if one does that the piece doesn't end before its brace."""
    found = None
    for token in _TOKEN.finditer(piece, _REST.match(piece).end() if inside else 0):
        c = piece[token.start()]
        if c == "{" and depth == level:
            found = token.start()
        depth += (c in "{[") - (c == "]")
    return found


def effects(piece: str) -> tuple[bool, int, int]:
    """effect() for both states at once: whether the state changes, and how much deeper a piece ends that begins outside a
    string, and one that begins within."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    even = len(parts) % 2 == 0
    deeper = [(o := "".join(parts[k::2])).count("{") + o.count("[") - o.count("]") - (even == bool(k)) for k in (0, 1)]
    return even, *deeper


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, None
    for batch in batches:
        done = []
        for file, block, piece in zip(batch["file"], batch["block"], batch["value"]):
            if (file, block) != now:
                if now:
                    done.append((*now, *state))
                now, state = (file, block), (False, 0, True, 0)
            changes, *deeper = effects(piece)
            state = (state[0] != changes, state[1] + deeper[state[0]], state[2] != changes, state[3] + deeper[state[2]])
        yield pd.DataFrame(done, columns=["file", "block", "end0", "deeper0", "end1", "deeper1"])
    if now:
        yield pd.DataFrame([(*now, *state)], columns=["file", "block", "end0", "deeper0", "end1", "deeper1"])


def _in_order(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of one file's summaries, what each block begins with."""
    out, inside, depth = [], False, 0
    for r in blocks.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, depth))
        inside, depth = (r.end1, depth + r.deeper1) if inside else (r.end0, depth + r.deeper0)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth"])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Objects at depth 2, or what a block has of them, and where documents begin: file, block, n, head, begins, ends, text.

    Of a document that begins (head), text is what comes before its first closing brace, closed.
    """
    now, inside, depth, n, held, begins = None, False, 0, 0, None, False

    def part(ends: bool) -> tuple:
        return (*now, n, False, begins, ends, "".join(held))

    for batch in batches:
        done = []
        for file, block, piece, inside0, depth0 in zip(batch["file"], batch["block"], batch["value"], batch["inside"], batch["depth"]):
            if (file, block) != now:
                if held is not None:
                    done.append(part(False))
                now, inside, depth, n = (file, block), inside0, depth0, 0
                held, begins = ([], False) if depth > 2 else (None, False)
            if held is None:
                if depth == 0 and (at := opening(piece, inside, 0, 0)) is not None:
                    done.append((*now, n, True, True, True, piece[at:] + "}}"))
                    n += 1
                at = opening(piece, inside, depth, 2)
                if at is not None:
                    held, begins = [piece[at:], "}"], True
            else:
                held += [piece, "}"]
            inside, deeper = effect(piece, inside)
            depth += deeper
            if held is not None and depth <= 2 and not inside:
                done.append(part(True))
                held, n = None, n + 1
        yield pd.DataFrame(done, columns=["file", "block", "n", "head", "begins", "ends", "text"])
    if held is not None:
        yield pd.DataFrame([part(False)], columns=["file", "block", "n", "head", "begins", "ends", "text"])


def read_large_features(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """One row a feature: file, ordinal (from 0, within its file), id, properties and geometry (JSON) and geometry_type.

    As read_features of whole documents, but for what a collection says of itself; a collection without features has no row.
    Blocks are as large as Spark cuts files (spark.sql.files.maxPartitionBytes); compressed files are one block.  A feature
    is one row, however long.  What isn't JSON gives no features from there on.

    With packed, files hold many collections, one after the other (see write_collections): ordinal is within the
    collection, and name is one more column, of the name in the properties that it begins with (null: it has none there).
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    blocks = pieces.select("file", "block", "value").mapInPandas(_summaries, "file string, block long, end0 boolean, deeper0 long, end1 boolean, deeper1 long")
    starts = written(blocks.groupBy("file").applyInPandas(_in_order, "file string, block long, inside boolean, depth long"))
    if starts.count() <= MOST_BLOCKS:
        known = pieces.join(F.broadcast(starts), ["file", "block"])
    else:
        known = pieces.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "nth")
    parts = known.select("file", "block", "value", "inside", "depth").mapInPandas(_parts, "file string, block long, n long, head boolean, begins boolean, ends boolean, text string")
    # written, as what follows reads them several times over, and Python should not
    read_f = F.from_json("text", _FEATURE)
    is_whole = F.col("begins") & F.col("ends")
    parts = written(parts.select("file", "block", "n", "head", "begins", "ends", F.when(is_whole & ~F.col("head"), read_f).alias("f"), F.when(F.col("head"), F.get_json_object("text", "$.properties.name")).alias("name"), F.when(~is_whole, F.col("text")).alias("text")))
    whole = parts.where("begins and ends").select("file", "block", "n", "head", "name", "f")
    cut = parts.where("not (begins and ends)")  # two of a block at most
    order = Window.partitionBy("file").orderBy("block", "n")
    cut = cut.withColumn("which", F.sum(F.col("begins").cast("long")).over(order))
    first = F.min(F.struct("block", "n"))
    met = cut.groupBy("file", "which").agg(first.alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "text"))), lambda p: p["text"]), "").alias("text"))
    met = met.select("file", "at.block", "at.n", F.lit(False).alias("head"), F.lit(None).cast("string").alias("name"), read_f.alias("f"))
    # what is counted goes by place in the block: the features up to each row, and the last collection that began before it
    upto = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = whole.unionByName(met).where("head or f.type = 'Feature'").withColumn("upto", F.count(F.when(~F.col("head"), 1)).over(upto))
    begun = F.when(F.col("head"), F.struct("name", F.col("upto").alias("at")))
    placed = placed.withColumn("begun", F.last(begun, ignorenulls=True).over(upto))
    counts = placed.groupBy("file", "block").agg(F.max("upto").alias("n_features"), F.max_by("begun", "n").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n_features").over(before), F.lit(0)))
    later = F.when(F.col("last").isNotNull(), F.struct(F.col("last.name").alias("name"), (F.col("before") + F.col("last.at")).alias("at")))
    counts = counts.withColumn("earlier", F.last(later, ignorenulls=True).over(before)).select("file", "block", "before", "earlier")
    found = placed.where("not head").join(counts, ["file", "block"])
    ordinal = F.col("before") + F.col("upto") - 1
    own = F.when(F.col("begun").isNotNull(), F.struct(F.col("begun.name").alias("name"), (F.col("before") + F.col("begun.at")).alias("at"))).otherwise(F.col("earlier"))
    of = [own["name"].alias("name")] if packed else []
    return found.select("file", ((ordinal - own["at"]) if packed else ordinal).alias("ordinal"), "f.id", "f.properties", "f.geometry", F.get_json_object("f.geometry", "$.type").alias("geometry_type"), *of)
