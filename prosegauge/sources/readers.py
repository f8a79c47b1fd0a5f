"""Scans with explicit schemas; no pass over the data to infer types."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegauge.config import ATTRS
from prosegauge.functions.records import lenient_struct, scored_text
from prosegauge.operators.report import counted
from prosegauge.sources.versions import read_current

# Column names of exchanged CSV files and ours.
COLUMNS = {"Prompts": "prompt", "Continuation": "continuation", "Timestamp": "collected_at"}
PAIR = ("prompt", "continuation")
LABEL_FILE = r"responses_([^/]+)\.csv"

_CSV = {"header": True, "multiLine": True, "quote": '"', "nullValue": ""}


def read_pairs_jsonl(
    spark: SparkSession, path: str | list[str], nested: bool = True, attrs: Sequence[str] = ATTRS
) -> DataFrame:
    """Pair corpus, one JSON record per line: (prompt, continuation).

    Each value is a struct, or a string that holds a dict-like record; both are read, value by
    value. With ``nested=False`` strings are left as they are (parse those with
    ``flatten_struct``). A string that is no record has its fields null.
    """
    rows = read_pair_lines(spark, path).select(*PAIR)
    return parsed_pairs(rows, attrs) if nested else rows


def read_pair_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The two values of each line as strings, and the line itself where it is no JSON record: (prompt, continuation, unparsed)."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*PAIR, "unparsed")])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "unparsed").json(path)


def parsed_pairs(rows: DataFrame, attrs: Sequence[str] = ATTRS) -> DataFrame:
    """The strings of ``read_pair_lines`` as structs; other columns stay."""
    return rows.withColumns({name: lenient_struct(F.col(name), scored_text(attrs)) for name in PAIR})


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows at ingest, in the order of the partitions of ``df``. Write the result to a table
    before any use of the numbers. For rows of files use ``with_file_row_id``."""
    return df.select(F.monotonically_increasing_id().alias(name), *df.columns)


def with_file_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a scan by file name, and by place in the file, as (name, all columns of ``df``).

    However the scan is split, a file's rows get rising numbers and come before those of
    the next file. Blocks of files are numbered on the driver, which needs their names and starts
    only. Write the result to a table before any use of the numbers.
    """
    place = F.monotonically_increasing_id()
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    rows = rows.withColumn("_place", place)
    blocks = rows.groupBy("_file", "_start").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last")).collect()
    blocks.sort(key=lambda b: (b["_file"], b["_start"]))
    starts, total = [], 0
    for b in blocks:
        starts.append((b["_file"], b["_start"], total - b["_first"]))
        total += b["_last"] - b["_first"] + 1
    shifts = df.sparkSession.createDataFrame(starts, "_file string, _start long, _shift long")
    numbered = rows.join(F.broadcast(shifts), ["_file", "_start"])  # a row per block of a file
    return numbered.select((F.col("_place") + F.col("_shift")).alias(name), *df.columns)


def _by_header(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """Column names and the files that have them, one entry for each header in use.

    The first line of every file is read by its own task; no more than headers and paths
    come back. An empty file has no rows and is left out.
    """
    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")
    )
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    headers = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("header")
    return [(_fields(row.header), [unquote(f) for f in row.files]) for row in headers.collect() if row.header.strip()]


def _fields(header: str) -> list[str]:
    """Names in a header line; a name that is repeated or empty gets its place as a suffix."""
    names = next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")]))
    return [n if n and names.count(n) == 1 else f"{n}_{i}" for i, n in enumerate(names)]


def _union(frames: list[DataFrame]) -> DataFrame:
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def _named(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed(COLUMNS)
    if "collected_at" in df.columns:
        df = df.withColumn("collected_at", F.try_to_timestamp("collected_at"))
    return df


def _read_csv(spark: SparkSession, path: str | list[str], lenient: bool, kept: list[Column]) -> DataFrame:
    """Rows of files that may each have columns of their own, in any order; ``kept`` comes first.

    With ``lenient`` the last column, ``_surplus``, has the first field beyond those of the header.
    """
    frames = []
    for names, files in _by_header(spark, path):
        fields = [*names, "_surplus"] if lenient else names
        schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
        quoting = {"escape": "\\", "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE"} if lenient else {"escape": '"'}
        rows = spark.read.schema(schema).options(**_CSV, enforceSchema=True, **quoting).csv(files)
        texts = [F.col(f"`{n}`") for n in names]
        if lenient:
            texts = [F.replace(text, F.lit('""'), F.lit('"')) for text in texts]
        surplus = [F.col("_surplus")] if lenient else []
        columns = [text.alias(n) for text, n in zip(texts, names, strict=True)]
        frames.append(_named(rows.select(*kept, *columns, *surplus)))
    if not frames:
        raise ValueError(f"no CSV file with a header in {path}")
    return _union(frames)


def read_prompts(spark: SparkSession, path: str | list[str], kept: Sequence[Column] = ()) -> DataFrame:
    """Range files, each read by its own header. All columns are read as text, so the prompt
    ``null`` stays a text; scores are then cast."""
    rows = _read_csv(spark, path, False, list(kept))
    scores = {c: F.col(c).try_cast("double") for c in rows.columns if c in ATTRS}
    return rows.withColumns(scores) if scores else rows


def read_responses_lenient(spark: SparkSession, path: str | list[str], kept: Sequence[Column] = ()) -> DataFrame:
    r"""Response files of any origin: short rows are padded with nulls, over-long ones left out.

    Each file is read by its own header. Quotes inside a quoted field may be doubled or
    escaped by ``\``. One column more than the header names takes in the first surplus
    field of a row.
    """
    return _read_csv(spark, path, True, list(kept)).where(F.col("_surplus").isNull()).drop("_surplus")


def read_responses_counted(
    spark: SparkSession, path: str | list[str], kept: Sequence[Column] = ()
) -> tuple[DataFrame, Observation]:
    """``read_responses_lenient`` and what the first job over it sees: rows (``n_rows``), over-long ones left out
    (``n_over_long``), and rows kept without a prompt (``n_no_prompt``) or a continuation (``n_no_continuation``)."""
    rows = _read_csv(spark, path, True, list(kept))
    long = F.col("_surplus").isNotNull()
    blank = {f"n_no_{c}": ~long & F.col(c).isNull() for c in PAIR if c in rows.columns}
    rows, counts = counted(rows, n_over_long=long, **blank)
    return rows.where(~long).drop("_surplus"), counts


def load_lexicon(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Distinct lower-case terms, one per line of a UTF-8 file or row of a one-column frame."""
    lines = spark.read.text(source) if isinstance(source, str) else source
    term = F.lower(F.trim(F.col(lines.columns[0])))
    return lines.select(term.alias("term")).where("term <> ''").distinct()


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    r"""Lines of one corpus file in order: (row_id, text); ``\r\n`` and ``\r`` end lines too.

    The order over several files is not defined, so a folder of them is refused: keep such
    corpora as tables with their row ids.
    """
    lines = spark.read.text(path)
    if len(lines.inputFiles()) > 1:
        raise ValueError("a corpus text must be one file; read the corpus table instead")
    return with_row_id(lines.withColumnRenamed("value", "text"))


def read_corpus_lines(spark: SparkSession, path: str, name: str = "class") -> DataFrame:
    """Lines of the class corpora, without order: (value, class)."""
    schema = f"value string, {name} int"
    return spark.read.schema(schema).text(path)


def read_responses(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Response table partitioned by model and label; a model that was replaced as a whole has its current version."""
    rows = read_current(spark, path, schema or RESPONSES)
    if rows is None:
        raise FileNotFoundError(f"no responses in {path}")
    return rows


RESPONSES = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("continuation", T.StringType()),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


def scan_model_dirs(spark: SparkSession, model_dirs: Mapping[str, str], lenient: bool = True) -> DataFrame:
    """All response files of several models as one frame: (model, label, prompt, continuation, collected_at).

    The model comes from the mapping, the range from the file name. A folder that is
    missing is an error.
    """
    frames = []
    for model, folder in model_dirs.items():
        path = f"{folder.rstrip('/')}/*.csv"
        label = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), LABEL_FILE, 1)
        read = read_responses_lenient if lenient else read_prompts
        frames.append(read(spark, path, [F.lit(model).alias("model"), label.alias("label")]))
    union = _union(frames)
    if "collected_at" not in union.columns:
        union = union.withColumn("collected_at", F.lit(None).cast("timestamp"))
    return union


def load_ranges(ranges: DataFrame, labels: Sequence[str], name: str = "toxicity_bin") -> DataFrame:
    """Rows of the named ranges, by partition; a range without data gives none."""
    return ranges.where(F.col(name).isin(list(labels)))


def select_range(ranges: DataFrame, label: str, name: str = "toxicity_bin") -> DataFrame:
    return load_ranges(ranges, [label], name)
