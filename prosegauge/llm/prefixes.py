"""Prefix trie of conversations by collapsing whole sequences.

1. Turns are sorted by ranges of (conversation, turn) and each gets the hash of its conversation up to it, a polynomial
   modulo the prime ``MODULUS``. Such hashes of two stretches give that of both, so a conversation may lie in
   several partitions, and the first turns of another may be put before it, without reading its turns again.
2. Conversations are rebuilt and identical ones grouped into sequences: one representative (the smallest id), a weight, and
   the digest of the ids that end there.
3. Only the prefixes of representatives are formed. A sequence that is a proper prefix of another drops out of the leaves by an
   anti-join; weights, leaves and saved characters are summed per prefix.

Saved characters of a subtree are the sum over its members' remaining characters less the characters of each node once.
The nodes that a representative owns (no smaller one reaches them) are the last part of its path, so the second
sum needs only where that part begins: nothing is expanded to ancestors.

Defined results: turns are ordered by ``turn`` (null first), then role and a digest of the turn; equal turns of one
conversation all count. Null roles and texts are empty. Rows without conv_id belong to no conversation and take no part. An empty
table gives no rows, not even a root. Texts are read once, for their length and digest. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.operators.join import hot_keys, join_skewed
from prosegauge.session import stored

#: Conversations that share their first turns, and most turns that they share.
FAMILY, MOST_HEAD = 100, 5
MODULUS, FACTOR = 2**127 - 1, 0x5BD1E995_7F4A7C15_9E3779B9_2545F491
#: Ends of a sequence are joined in ranges of 2**16 ids.
RANGE_BITS = 16
#: Keys with more rows than this are joined by broadcast, the heaviest of them.
HOT = 1_000
SCANNED = "part int, conv_id long, pos long, n_chars long, chars long, before string, hash string"


def _hex(x: int) -> str:
    return f"{x:032x}"


def _joined(first: int, second: int, n: int) -> int:
    """The hash of a stretch and, after it, one of ``n`` turns."""
    return (first * pow(FACTOR, n, MODULUS) + second) % MODULUS


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place, characters and hash up to each turn, within this partition; turns of a conversation come in order."""
    part, current = TaskContext.get().partitionId(), None
    pos = chars = value = 0
    for batch in batches:
        rows = []
        for conv, digest, n in zip(batch["conv_id"].tolist(), batch["digest"], batch["n_chars"].tolist(), strict=True):
            if conv != current:
                current, pos, chars, value = conv, 0, 0, 0
            before, value = value, (value * FACTOR + int(digest, 16) + 1) % MODULUS
            pos, chars = pos + 1, chars + n
            rows.append((part, conv, pos, n, chars, _hex(before), _hex(value)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCANNED.split(", ")])


def _split_offsets(scanned: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """What comes before each part of the conversations that lie in several partitions: turns, characters, hash.

    A partition shares no more than its first and its last conversation with others.
    """
    edges = scanned.groupBy("part").agg(F.min("conv_id"), F.max("conv_id")).collect()
    seen: dict[int, set[int]] = {}
    for part, low, high in edges:
        for conv in (low, high):
            seen.setdefault(conv, set()).add(part)
    split = [c for c, parts in seen.items() if len(parts) > 1]
    if not split:
        return {}
    some = F.broadcast(scanned.sparkSession.createDataFrame([(c,) for c in split], "conv_id long"))
    last = F.max(F.struct("pos", "chars", "hash")).alias("last")
    parts = scanned.join(some, "conv_id", "left_semi").groupBy("conv_id", "part").agg(last).collect()
    offsets, totals = {}, {}
    for conv, part, (pos, chars, value) in sorted(parts, key=lambda x: (x[0], x[1])):
        n, before, first = totals.get(conv, (0, 0, 0))
        offsets[part, conv] = (n, before, first)
        totals[conv] = (n + pos, before + chars, _joined(first, int(value, 16), pos))
    return offsets


def _shift(batches: Iterator[pd.DataFrame], offsets: dict) -> Iterator[pd.DataFrame]:
    """Turns whose conversation began in an earlier partition, with what came before them."""
    nothing = (0, 0, 0)
    for batch in batches:
        rows = []
        for part, conv, pos, n_chars, chars, before, value in batch.itertuples(index=False, name=None):
            n, more, first = offsets.get((part, conv), nothing)
            if n:
                before, value = _hex(_joined(first, int(before, 16), pos - 1)), _hex(_joined(first, int(value, 16), pos))
            rows.append((part, conv, pos + n, n_chars, chars + more, before, value))
        yield pd.DataFrame(rows, columns=batch.columns)


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with place (from 1), characters and hash of the conversation before and up to them."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.length(text).cast("long").alias("n_chars"), digest.alias("digest")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = stored(ordered.select("conv_id", "digest", "n_chars").mapInPandas(_scan, SCANNED), "scanned")
    offsets = _split_offsets(scanned)
    if not offsets:
        return scanned
    return stored(scanned.mapInPandas(lambda batches: _shift(batches, offsets), SCANNED), "turns")


def shared_head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % (MOST_HEAD + 1)).cast("long")


REBUILT = (
    "conv_id long, head long, n_head long, depth long, chars long, shift_chars long, key string, first string,"
    " own string, heads array<struct<pos:long,n_chars:long,chars:long,hash:string>>"
)


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each conversation is rebuilt: its length, characters and key, and what its own turns' hashes lack."""
    names = [x.split()[0] for x in REBUILT.split(", ")[:9]] + ["heads"]
    for batch in batches:
        rows = []
        for conv, head, turns, last, own, base in zip(
            *(batch[c] for c in ("conv_id", "head", "n_turns", "last", "heads", "base_heads")), strict=True
        ):
            base = list(base[:head]) if base is not None else []
            own = list(own[:head])
            before = base[-1] if base else {"chars": 0, "hash": _hex(0)}
            skipped = own[-1] if own else {"chars": 0, "hash": _hex(0)}
            first, lost = int(before["hash"], 16), int(skipped["hash"], 16)
            rest, shift = max(turns - head, 0), before["chars"] - skipped["chars"]
            depth = len(base) + rest
            value = (int(last["hash"], 16) + (first - lost) * pow(FACTOR, rest, MODULUS)) % MODULUS if rest else first
            chars = last["chars"] + shift if rest else before["chars"]
            key = node_key(depth, value)
            rows.append((conv, head, len(base), depth, chars, shift, key, _hex(first), _hex(lost), base))
        yield pd.DataFrame(rows, columns=names)


def node_key(depth: int, value: int) -> str:
    return f"{depth}-{_hex(value)}"


def rebuilt(turns: DataFrame) -> DataFrame:
    """A row of ``REBUILT`` per conversation; turns before ``head`` are those of the first of its family."""
    entry = F.struct("pos", "n_chars", "chars", "hash")
    convs = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n_turns"),
        F.max(F.struct("pos", "chars", "hash")).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST_HEAD, entry))).alias("heads"),
    )
    convs = stored(convs, "conversations")
    families = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.col("heads").alias("base_heads")
    )
    based = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(families, "base", "left")
    asked = based.withColumn("head", shared_head(F.col("conv_id")))
    return asked.select("conv_id", "head", "n_turns", "last", "heads", "base_heads").mapInPandas(_rebuild, REBUILT)


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined parts of each key; parts come in order, and one is held at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """The digest of the ids (conv_id) of each key, ascending and comma-joined: key, ends_sha256."""
    ranges = members.groupBy("key", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ordered = ranges.repartition("key").sortWithinPartitions("key", "range")
    return ordered.select("key", "ids").mapInPandas(_end_digests, "key string, ends_sha256 string")


def _prefix_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of the own turns of representatives, and of what comes before each."""
    for batch in batches:
        keys, parents = [], []
        for pos, before, value, head, n_head, first, own in zip(
            *(batch[c] for c in ("pos", "before", "hash", "head", "n_head", "first", "own")), strict=True
        ):
            depth, lack = n_head + pos - head, int(first, 16) - int(own, 16)
            at = lack * pow(FACTOR, pos - head - 1, MODULUS)
            keys.append(node_key(depth, (int(value, 16) + at * FACTOR) % MODULUS))
            parents.append(node_key(depth - 1, (int(before, 16) + at) % MODULUS))
        yield batch[["rep", "weight", "depth", "n_chars", "left"]].assign(key=keys, parent_key=parents)


PREFIX = "rep long, weight long, depth long, n_chars long, left long, key string, parent_key string"


def prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every sequence, the root too: ``left`` counts the characters from its last turn to the end."""
    hot = hot_keys(turns, "conv_id", HOT)
    info = sequences.withColumnRenamed("rep", "conv_id")
    own = join_skewed(turns, info.drop("heads", "key", "depth"), "conv_id", "inner", hot).where("pos > head")
    own = own.select(
        F.col("conv_id").alias("rep"), "weight", (F.col("n_head") + F.col("pos") - F.col("head")).alias("depth"), "n_chars",
        (F.col("total") - F.col("shift_chars") - F.col("chars") + F.col("n_chars")).alias("left"),
        "pos", "before", "hash", "head", "n_head", "first", "own",
    ).mapInPandas(_prefix_keys, PREFIX)
    given = sequences.select("rep", "weight", "total", F.posexplode("heads").alias("place", "turn"), "heads")
    key = F.concat_ws("-", F.col("turn.pos").cast("string"), "turn.hash")
    above = F.when(F.col("place") > 0, F.get("heads", F.col("place") - 1)["hash"]).otherwise(_hex(0))
    given = given.select(
        "rep", "weight", F.col("turn.pos").alias("depth"), F.col("turn.n_chars").alias("n_chars"),
        (F.col("total") - F.col("turn.chars") + F.col("turn.n_chars")).alias("left"), key.alias("key"),
        F.concat_ws("-", F.col("place").cast("string"), above).alias("parent_key"),
    )
    root = sequences.select(
        "rep", "weight", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"),
        F.col("total").alias("left"), F.lit(node_key(0, 0)).alias("key"), F.lit(None).cast("string").alias("parent_key"),
    )
    return own.select(*root.columns).unionByName(given).unionByName(root)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations (conv_id, turn, role, text).

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = hashed_turns(conversations)
    members = stored(rebuilt(turns), "rebuilt")
    how = F.min_by(F.struct("depth", "chars", "head", "n_head", "shift_chars", "first", "own", "heads"), "conv_id")
    grouped = members.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), how.alias("how"))
    sequences = stored(
        grouped.select("key", "rep", "weight", "how.*").withColumnRenamed("chars", "total"), "sequences"
    )
    paths = stored(prefixes(turns, sequences), "prefixes")
    # a sequence that another goes on from is no leaf
    proper = paths.where("parent_key is not null").select(F.col("parent_key").alias("key")).distinct()
    leaves = sequences.select("key", "rep").join(proper, "key", "left_anti").select("rep", F.lit(1).alias("leaf"))
    # the nodes of a representative that no smaller one reaches begin where it still has ``owned`` characters
    owners = paths.groupBy("key").agg(F.min(F.struct("rep", "left")).alias("owner"))
    owned = owners.groupBy("owner.rep").agg(F.max("owner.left").alias("owned"))
    facts = sequences.select("rep").join(leaves, "rep", "left").join(owned, "rep", "left").na.fill(0)
    known = join_skewed(paths, stored(facts, "facts"), "rep", "inner", hot_keys(paths, "rep", HOT))
    nodes = known.groupBy("key").agg(
        F.min("rep").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent_key").alias("parent_key"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("left") - F.least("left", "owned")).alias("saved_tokens"),
    )
    nodes = stored(nodes, "nodes")
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("n_children")
    )
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    placed = join_skewed(nodes, parents, "parent_key", "left", hot_keys(nodes, "parent_key", HOT))
    ended = ends(members.select("key", "conv_id"))
    return (
        placed.join(children, "key", "left")
        .join(ended, "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
