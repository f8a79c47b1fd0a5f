"""Chat logs to training text: fold a log of events into messages, render them, mark the trained text.

A log has one row per event: ``conv_id``, ``place`` (of the message in its conversation),
``message_id``, ``seq`` (order of the events), ``kind``, ``role`` and ``text``. Kinds:

- ``open`` begins a message, its text is what has come so far;
- ``delta`` adds to the text;
- ``edit`` puts another text in its place;
- ``regenerate`` drops the text, deltas that follow begin anew;
- ``delete`` takes the message away, unless an event of the other three kinds follows.

All is DataFrame operations. Work is shared out by conversation and block of ``SEGMENT`` places,
so one conversation with very many turns is spread over many tasks; each segment is rendered by
itself, and the text of a conversation is that of its segments in order.

Defined results: an event delivered again, equal in all columns, counts once; null ``text`` is
empty; a message with no role has the empty role; events of null or unknown kind do nothing, and
a message of such events alone does not exist; null ``conv_id`` is a conversation of its own;
messages with null ``place`` come first. Messages at one place follow each other by role, text
and id. An empty log gives no rows. Other columns of the log are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 256
#: Segments for messages without a place, which are spread by their id.
LOOSE = 1024
START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
BASES = ("open", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """No ``<|`` is left: ``<``, any backslashes and ``|`` get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As of a text; line ends, which close a role, get a control string."""
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, segment, place, message_id, role, text.

    One shuffle, by conversation and segment; later grouping by these needs no other.
    """
    loose = -1 - F.pmod(F.xxhash64("message_id"), F.lit(LOOSE))
    log = events.select(
        "conv_id",
        F.coalesce(F.floor(F.col("place") / SEGMENT), loose).alias("segment"),
        "place",
        "message_id",
        F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), "role", "text").alias("event"),
    ).repartition("conv_id", "segment")
    folded = log.groupBy("conv_id", "segment", "place", "message_id").agg(F.sort_array(F.collect_set("event")).alias("log"))
    base = F.array_max(F.transform("log", lambda e, i: F.when(e.kind.isin(*BASES), i)))
    with_base = folded.withColumn("base", base)
    texts = F.transform(
        F.expr("slice(log, base + 1, size(log) - base)"),
        lambda e: F.when(e.kind.isin("open", "edit", "delta"), F.coalesce(e.text, F.lit(""))).otherwise(F.lit("")),
    )
    roles = F.filter(F.col("log.role"), lambda r: r.isNotNull())
    return (
        with_base.where("base is not null and log[base].kind <> 'delete'")
        .select(
            "conv_id",
            "segment",
            "place",
            "message_id",
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(texts, "").alias("text"),
        )
    )


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """A row per segment: conv_id, segment, n_turns, formatted, loss_spans.

    ``loss_spans`` are start and length, in code points of ``formatted``, of each text of the
    role ``trained``: the loss mask.
    """
    turns = messages.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "message_id"))).alias("turns")
    )
    parts = turns.select(
        "conv_id",
        "segment",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t.role), F.lit("\n")).alias("head"),
                escape(t.text).alias("body"),
                (t.role == trained).alias("trained"),
            ),
        ).alias("parts"),
    )
    pieces = F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END)))
    measured = parts.select(
        "conv_id", "segment", "parts", pieces.alias("pieces"), F.transform(pieces, F.length).alias("sizes")
    )
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            (
                F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(p.head)
            ).alias("start"),
            F.length(p.body).alias("length"),
            p.trained.alias("trained"),
        ),
    )
    return measured.select(
        "conv_id",
        "segment",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join("pieces", "").alias("formatted"),
        F.transform(
            F.filter(spans, lambda s: s.trained),
            lambda s: F.struct(s.start.alias("start"), s.length.alias("length")),
        ).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts, as they were before escaping, from rendered text."""
    turns = F.split(formatted, r"<\|im_start\|>")
    bodies = F.transform(F.slice(turns, F.lit(2), F.size(turns)), lambda t: F.substring(t, F.lit(1), F.length(t) - len(END)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def masked_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.length)))


def turn_events(turns: DataFrame) -> DataFrame:
    """A log of a table of turns (conv_id, turn, role, text): every row is a message of its own.

    Assistant texts arrive as two deltas, as a stream would bring them.
    """
    half = F.ceil(F.length("text") / 2).cast("int")
    none = F.lit(None).cast("string")

    def event(seq: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.col("role"), text.alias("text"))

    events = F.when(
        F.col("role") == "assistant",
        F.array(
            event(0, "open", none),
            event(1, "delta", F.substring("text", F.lit(1), half)),
            event(2, "delta", F.substring("text", half + 1, F.length("text"))),
        ),
    ).otherwise(F.array(event(0, "open", F.col("text"))))
    return turns.select(
        "conv_id", F.col("turn").alias("place"), F.monotonically_increasing_id().alias("message_id"), "role", "text"
    ).select("conv_id", "place", "message_id", F.inline(events))


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Counts and digests per conversation, all read back from the rendered segments.

    A digest is of one string, so the text of a conversation meets in one row here.
    """
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    read = segments.select(
        "conv_id",
        "segment",
        F.size(turns).cast("long").alias("n_turns"),
        F.array_join(turns, "").alias("turns_text"),
        F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("formatted_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("segment", "turns_text", "loss_text"))).alias("parts"),
    )
    loss = F.array_join(F.col("parts.loss_text"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("parts.turns_text"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
