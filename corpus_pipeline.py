"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of ``documents``. ``docs`` must be a stored table, which
tells repeated rows apart. What each stage does with nulls, empty texts and ties is stated in its operator's
module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosegauge.llm import langid, packing, paragraphs, simhash, toxicity
from prosegauge.llm.queries import table, tokenizer_path
from prosegauge.session import stored

#: Texts of whose n-grams a smaller share speaks for the best language are no text of a known language.
LEAST_LANGUAGE_SCORE = 0.3


#: Texts, and bytes, that a Python worker gets at a time; Spark's default of 10,000 long texts takes hundreds of megabytes.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of ``BATCH_ROWS`` and some ``BATCH_BYTES`` at most."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(setting).lower().removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(setting, str(most))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    bounded(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents teach."""
    bounded(spark)
    return langid.keep_known(docs, LEAST_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (three-word shingles) link at two bits or fewer, that of the smallest id."""
    bounded(spark)
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or the same before, has."""
    bounded(spark)
    return paragraphs.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences."""
    bounded(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL expresses none of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
