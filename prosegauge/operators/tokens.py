"""Token ids of fixed length, training labels and banned sequences.

A subword tokenizer is a plug-in: a picklable factory, called once per task,
that gives an object with ``encode(text) -> list[int]`` and ``decode(ids) -> str``.
Without one, tokens are separated by white space and ids come from a vocabulary table.
"""

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.text import words
from prosegauge.session import checkpointed

PAD = "[PAD]"
PAD_ID = 0
IGNORED = -100  # fixed value: the label that training leaves out
BROADCAST_TERMS = 500_000
MAX_TERM_CHARS = 256
#: Tokens that one task of the lookup takes, about; a row's tokens stay together.
TASK_TOKENS = 1 << 19
MAX_TASKS = 65_536


def build_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """Vocabulary of a corpus, standing in for a pretrained one: (token, n, id).

    Ids are dense from 1 by falling count, then token; 0 is the padding token. Counting
    combines before the shuffle. Terms are sorted over all tasks and numbered by the size
    of the partitions before theirs, so no single task sees them all.
    """
    counts = df.select(F.explode(words(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ordered = checkpointed(counts.orderBy(F.desc("n"), "token"))
    place = F.monotonically_increasing_id()
    placed = ordered.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dict(placed.groupBy("_part").count().collect())  # one number per shuffle partition
    base, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, base))
        base += sizes[part]
    offsets = df.sparkSession.createDataFrame(rows, "_part bigint, _base bigint")
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.select("token", "n", (F.col("_base") + F.col("_at") + 1).alias("id"))


def with_padding(vocab: DataFrame) -> DataFrame:
    """The vocabulary with the padding token, added only if it has none."""
    absent = vocab.where(F.col("token") == PAD).limit(1).count() == 0
    if not absent:
        return vocab
    pad = vocab.sparkSession.createDataFrame([(PAD, PAD_ID)], "token string, id bigint")
    return vocab.unionByName(pad, allowMissingColumns=True)


def token_ids(df: DataFrame, key: Sequence[str], tokens: Column, vocab: DataFrame) -> DataFrame:
    """Look the tokens of every row up: (key, ids, n_unknown), ids in token order.

    Rows are shuffled once by their key, and the lookup and regrouping keep that
    partitioning. Regrouping sorts a row for every token, many times the text that is shuffled,
    so tokens are counted first and set the number of tasks. The most frequent terms,
    ``BROADCAST_TERMS`` of them at most, are broadcast. Of the tokens beyond, each row gives
    every distinct one once, with its places; these alone are shuffled, to their term and back
    to their row, where all ids are put in order. Unknown tokens, which may be frequent, are such
    too, so a hot one is a long left side of that join, which adaptive execution splits.
    """
    tasks = _tasks(df, tokens)
    rows = df.select(F.struct(*key).alias("_key"), F.array_join(tokens, " ").alias("_line"))
    line = F.array_remove(F.split("_line", " "), "")
    each = _by_key(rows, tasks).select("_key", F.posexplode_outer(line).alias("_at", "token"))
    terms = vocab.select("token", F.col("id").cast("int").alias("_id"))
    short = F.length("token") <= MAX_TERM_CHARS
    head = (F.col("_id") <= BROADCAST_TERMS) & short
    found = each.join(F.broadcast(terms.where(head)), "token", "left")
    missing = F.col("token").isNotNull() & F.col("_id").isNull()
    known = found.groupBy("_key").agg(
        F.collect_list(_placed_id(F.col("_at"), F.col("_id"))).alias("_ids"), F.count_if(missing).alias("n_unknown")
    )
    if terms.where(~head).limit(1).count():
        rare = found.where(missing).groupBy("_key", "token").agg(F.collect_list("_at").alias("_places"))
        back = rare.join(terms.where(~head), "token")
        looked_up = (_by_key(back, tasks) if tasks else back).groupBy("_key").agg(
            F.flatten(F.collect_list(F.transform("_places", lambda at: _placed_id(at, F.col("_id"))))).alias("_more"),
            F.sum(F.size("_places")).alias("_n"),
        )
        known = known.join(looked_up, "_key", "left").withColumns(
            {
                "_ids": F.when(F.col("_more").isNull(), F.col("_ids")).otherwise(F.concat("_ids", "_more")),
                "n_unknown": F.col("n_unknown") - F.coalesce("_n", F.lit(0)),
            }
        )
    ids = F.transform(F.sort_array("_ids"), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    return known.select(*[F.col("_key")[name].alias(name) for name in key], ids.alias("ids"), "n_unknown")


def _tasks(df: DataFrame, tokens: Column) -> int:
    """Tasks of ``TASK_TOKENS`` tokens each, one a core at least, ``MAX_TASKS`` at most; 0 where
    one task may take all."""
    total = df.select(F.sum(F.greatest(F.size(tokens), F.lit(0)))).first()[0] or 0
    if total <= TASK_TOKENS:
        return 0
    tasks = max(math.ceil(total / TASK_TOKENS), df.sparkSession.sparkContext.defaultParallelism)
    return min(tasks, MAX_TASKS)


def _by_key(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt by their key to that many tasks, or to as many as adaptive execution finds for 0."""
    return rows.repartition(tasks, "_key") if tasks else rows.repartition("_key")


def _placed_id(at: Column, term: Column) -> Column:
    """Place and id in one long, in the order of the two."""
    return F.shiftleft(at.cast("bigint"), 32) + term


def padded(ids: Column, length: int, pad: int = PAD_ID) -> tuple[Column, Column]:
    """Ids cut or padded to ``length``, and the mask telling ids from padding."""
    kept = F.slice(ids, 1, length)
    blanks = F.lit(length) - F.size(kept)
    input_ids = F.concat(kept, F.array_repeat(F.lit(pad), blanks))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), blanks))
    return input_ids, mask


def tokenized(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    vocab: DataFrame | None = None,
    length: int = 512,
    tokenizer: Callable | None = None,
    unknown: str = "raise",
) -> DataFrame:
    """The first ``length`` token ids of every row, not yet padded: (key, ids); the text goes.

    With a ``tokenizer`` plug-in the rows stay where they are. A vocabulary that lacks a
    token raises, unless ``unknown`` is ``drop``.
    """
    if tokenizer is not None:
        return df.select(*key, F.slice(encoder(tokenizer)(F.col(text)), 1, length).alias("ids"))
    rows = token_ids(df, key, words(F.col(text), length), vocab)
    ids = F.col("ids")
    if unknown == "raise":
        message = F.lit("token missing from the vocabulary")
        ids = F.when(F.col("n_unknown") == 0, ids).otherwise(F.raise_error(message).cast("array<int>"))
    return rows.select(*key, ids.alias("ids"))


def pad_rows(df: DataFrame, length: int = 512) -> DataFrame:
    """``ids`` become input_ids and attention_mask of fixed length."""
    input_ids, mask = padded(F.col("ids"), length)
    return df.select(*[c for c in df.columns if c != "ids"], input_ids.alias("input_ids"), mask.alias("attention_mask"))


def tokenize_pad(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    vocab: DataFrame | None = None,
    length: int = 512,
    tokenizer: Callable | None = None,
    unknown: str = "raise",
) -> DataFrame:
    """Token ids of fixed length, as ``tokenized`` gives them: (key, input_ids, attention_mask)."""
    return pad_rows(tokenized(df, key, text, vocab, length, tokenizer, unknown), length)


def lm_labels(ids: Column, mask: Column) -> Column:
    """Labels of next-token training: the ids, padding left out."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(IGNORED)))


def banned_token_ids(
    lexicon: DataFrame, vocab: DataFrame | None = None, tokenizer: Callable | None = None
) -> DataFrame:
    """Token ids of every lexicon term, to keep a generator from writing it: (term, ids).

    A term with a word the vocabulary lacks cannot be written, so its ids are null.
    """
    if tokenizer is not None:
        return lexicon.select("term", encoder(tokenizer)(F.col("term")).alias("ids"))
    looked_up = token_ids(lexicon, ["term"], words(F.col("term")), vocab)
    return looked_up.select("term", F.when(F.col("n_unknown") == 0, F.col("ids")).alias("ids"))


def encoder(factory: Callable) -> Callable[[Column], Column]:
    """Vectorised ``encode`` of a tokenizer plug-in."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([None if t is None else model.encode(t) for t in texts], dtype=object)

    return encode


def subword_truncator(factory: Callable, limit: int = 20) -> Callable[[Column, Column], Column]:
    """As ``truncate_new_tokens``, counting the tokens of a tokenizer plug-in."""

    @F.pandas_udf("string")
    def truncate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()

        def cut(prompt, text):
            if prompt is None or text is None:
                return None
            new = model.encode(prompt + text)[len(model.encode(prompt)) :]
            return text if len(new) <= limit else model.decode(new[:limit])

        for prompts, texts in batches:
            yield pd.Series([cut(p, t) for p, t in zip(prompts, texts)], dtype=object)

    return truncate
