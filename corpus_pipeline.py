"""From raw documents to token ids: language, near duplicates, benchmark passages, personal data, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import scratch
from cairn.llm import bpe, langid, pii, simhash, tiling
from cairn.llm.common import crc_mod, table, written

#: Stages pass these columns of documents on; others, whatever their names, are left out.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The key of surrogates. A deployment sets its own, kept secret, in the session's setting of this name.
KEY, KEY_SETTING = "cairn", "spark.cairn.surrogates.key"
#: Words after titles in so many texts are names without a title, too.
LEARN = 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of undetermined language: those whose text is null or has no letter.

    Each row is judged by its own text, so ties and repeated rows are kept; ids may be null or shared.  Where nothing can be
    learned (no row has a language), all rows go; an empty table gives none.
    """
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return langid.with_language(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of those that share 0.8 or more of their five-word shingles: that of the smallest id.

    Repeated rows count once.  Rows that share an id are apart if their texts are; rows without an id come after all others.
    Null and empty texts are one group; an empty table gives none.
    """
    return simhash.deduplicated(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half or more of a benchmark item.

    Null and empty texts hold nothing and stay, as all rows do where there are no items; ids may be null or shared, repeated
    rows go or stay together.
    """
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars is that of the new text.

    All rows stay, repeated ones alike; a null text stays null, with a null n_chars.
    """
    key = spark.conf.get(KEY_SETTING, KEY)
    return pii.replaced(docs, key, learn=LEARN).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (packed 32-bit integers), their number, and whether they decode to its text.

    All rows stay; a null or empty text has no ids.
    """
    spec = bpe.read_spec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.with_tokens(docs, spec)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


#: Name and function (spark, docs, sf_dir) of each stage; each gets what the one before it kept.
STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL expresses neither the networks, the fingerprints nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next.

    When a stage is written, the tables that it made on the way are removed, and so is its predecessor's.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with scratch.tables() as made:
            docs = written(stage(spark, docs, sf_dir))
        scratch.remove(spark, before + made[:-1])
        before = made[-1:]
    return docs
