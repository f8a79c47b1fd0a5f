"""Registry of queries over the test tables, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.text import SPACE
from prosegauge.operators.shape import pair_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prompts with a score: (row_id, score)."""
    return table(spark, sf_dir, "events").selectExpr("event_id as row_id", "value / 200 as score")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered user turns: (row_id, conv_id, turn, prompt, continuation)."""
    answered = pair_turns(table(spark, sf_dir, "conversations"))
    return answered.select((F.col("conv_id") * 100000 + F.col("turn")).alias("row_id"), *answered.columns)


SCORED_EVENTS_SQL = """scored as (select event_id as row_id, value / 200 as score,
  case when value / 200 < 0 then null when value / 200 <= 0.25 then '0-0.25'
       when value / 200 <= 0.5 then '0.25-0.5' when value / 200 <= 0.75 then '0.5-0.75'
       when value / 200 <= 1 then '0.75-1.0' end as toxicity_bin from events)"""

PAIRS_SQL = """pairs as (select conv_id * 100000 + turn as row_id, conv_id, turn, text as prompt, after_text as continuation
  from (select *, lead(role) over turns as after_role, lead(text) over turns as after_text
        from conversations window turns as (partition by conv_id order by turn))
  where role = 'user' and after_role = 'assistant')"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {quoted(SPACE + '+')}, ' ', 'g'))"


def words_sql(text: str) -> str:
    return f"list_filter(string_split({collapse_sql(text)}, ' '), lambda w: w <> '')"


def clean_sql(text: str) -> str:
    return collapse_sql(f"""replace({text}, '"', '''')""")


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def fold_sql(text: str) -> str:
    return f"""replace(translate({text}, '“”‘’—', '""''''-'), '...', ' ')"""


def normalize_sql(text: str) -> str:
    return collapse_sql(f"regexp_replace({fold_sql(text)}, '[[:punct:]]', '', 'g')")


def md5_share_sql(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint) / 4294967295.0::double"


def joined(array: Column) -> Column:
    """Arrays as text, so that both engines hash them alike."""
    return F.array_join(array.cast("array<string>"), " ")
