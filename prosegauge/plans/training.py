"""Training rows out of the class corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.config import Config
from prosegauge.operators.chunk import chunk_corpus
from prosegauge.operators.tokens import build_vocab, lm_labels, pad_rows, tokenized, with_padding
from prosegauge.session import fresh_path, stored
from prosegauge.sources.writers import write_table


def prepare_training(
    corpus: DataFrame,
    out: str | None = None,
    config: Config = Config(),
    tokenizer: Callable | None = None,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """Chunk each class corpus, tokenise the chunks to one length and label them.

    ``corpus`` has row_id, text and class. Chunks are stored, since without a tokenizer
    or a vocabulary they are read twice. Gives and writes (class, chunk_id, input_ids,
    attention_mask, labels). Rows are padded as they are written: padding makes them some
    twenty times as large, and shuffled or sorted that would be a task's memory.
    """
    spark = corpus.sparkSession
    out = out or fresh_path(spark, "training")
    chunks = stored(chunk_corpus(corpus, size=config.chunk_chars, by=["class"]), "chunks", f"{out}/chunks")
    if tokenizer is None and vocab is None:
        vocab = stored(with_padding(build_vocab(chunks, "chunk")), "vocab", f"{out}/vocab")
    ids = tokenized(chunks, ["class", "chunk_id"], "chunk", vocab, config.sequence_length, tokenizer)

    def labelled(rows: DataFrame) -> DataFrame:
        rows = pad_rows(rows, config.sequence_length)
        return rows.withColumn("labels", lm_labels(F.col("input_ids"), F.col("attention_mask")))

    write_table(ids, f"{out}/rows", ["class"], labelled)
    return spark.read.schema(labelled(ids).schema).parquet(f"{out}/rows")
