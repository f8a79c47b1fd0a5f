"""Parsing, flattening, pairing and joining."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegauge.config import ATTRS
from prosegauge.functions import records
from prosegauge.functions.text import strip_prompt_prefix, to_text
from prosegauge.operators import join, report, shape
from prosegauge.queries.common import PAIRS_SQL, pairs, query, table

KEYED = T.StructType([T.StructField("k", T.LongType())])


@query(f"with {PAIRS_SQL} select conv_id, turn, prompt, continuation from pairs")
def pair_turns(spark, sf_dir):
    return shape.pair_turns(table(spark, sf_dir, "conversations"))


@query("select event_id, cast(props->>'$.k' as bigint) as k from events")
def lenient_parse(spark, sf_dir):
    parsed = records.lenient_struct(F.col("props"), KEYED)
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query("""select event_id as row_id, case when event_id % 5 <> 4 then event_type end as prompt,
case when event_id % 5 in (1, 2, 3) then value end as toxicity, null::double as threat from events""")
def flatten_struct(spark, sf_dir):
    """Records as JSON, Python literals and junk, in turn."""
    kinds = [
        """concat('{"text": "', event_type, '", "toxicity": null}')""",
        """concat('{"text": "', event_type, '", "toxicity": ', value, '}')""",
        """concat("{'text': '", event_type, "', 'toxicity': ", value, "}")""",
        """concat("{'text': '", event_type, "', 'toxicity': ", value, ", 'threat': None}")""",
        """concat('no record ', event_type)""",
    ]
    cases = " ".join(f"when {i} then {kind}" for i, kind in enumerate(kinds))
    rows = table(spark, sf_dir, "events").selectExpr("event_id as row_id", f"case event_id % 5 {cases} end as prompt")
    return shape.flatten_struct(rows, "prompt", "prompt", schema=records.scored_text(("toxicity", "threat")))


@query("select conv_id, turn, text as content from conversations")
def chat_content(spark, sf_dir):
    message = F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))
    rows = table(spark, sf_dir, "conversations").withColumn(
        "reply", F.to_json(F.struct(F.array(message).alias("choices")))
    )
    return rows.select("conv_id", "turn", records.chat_content(F.col("reply")).alias("content"))


@query("select event_id, " + ", ".join(f"value / {i + 2} as {a}" for i, a in enumerate(ATTRS)) + " from events")
def summary_scores(spark, sf_dir):
    each = [
        F.struct(F.struct((F.col("value") / (i + 2)).alias("value")).alias("summaryScore")).alias(a.upper())
        for i, a in enumerate(ATTRS)
    ]
    reply = F.to_json(F.struct(F.struct(*each).alias("attributeScores")))
    rows = table(spark, sf_dir, "events").select("event_id", records.summary_scores(reply).alias("scores"))
    return rows.select("event_id", "scores.*")


@query("select conv_id, turn, role, null::double as toxicity, null::double as threat from conversations")
def ensure_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return shape.ensure_columns(rows, ["role", "toxicity", "threat"])


@query(f"with {PAIRS_SQL} select row_id, continuation from pairs")
def strip_prefix(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("full", F.concat("prompt", "continuation"))
    return rows.select("row_id", strip_prompt_prefix(F.col("full"), F.col("prompt")).alias("continuation"))


@query(
    """select conv_id, turn, cast(to_json([{'role': 'user', 'content': 'Continue this text: ' || text}]) as varchar)
as message from conversations where role = 'user'"""
)
def prompt_message(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", records.prompt_message(F.col("text")).alias("message"))


@query("""select event_id, case when user_id % 3 = 0 then event_type else event_type || '_' || (user_id % 3) end
as model from events""")
def model_variant(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    variant = F.when(F.col("user_id") % 3 != 0, to_text(F.col("user_id") % 3))
    return rows.select("event_id", records.model_variant(F.col("event_type"), variant).alias("model"))


SIDES_SQL = """turns as (select conv_id * 100000 + turn as row_id, role, text from conversations),
prompts as (select row_id + 1 as row_id, text as prompt from turns where role = 'user'),
continuations as (select row_id, text as continuation from turns where role <> 'user')"""


def _sides(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id * 100000 + turn as row_id", "role", "text")
    prompts = turns.where("role = 'user'").selectExpr("row_id + 1 as row_id", "text as prompt")
    return turns.where("role <> 'user'").selectExpr("row_id", "text as continuation"), prompts


@query(f"with {SIDES_SQL} select row_id, continuation, prompt from continuations left join prompts using (row_id)")
def attach_prompt(spark, sf_dir):
    return join.attach_prompt(*_sides(spark, sf_dir))


@query(f"""with {SIDES_SQL} select count_if(prompt is null)::bigint as prompt, count_if(continuation is null)::bigint as continuation
from continuations left join prompts using (row_id)""")
def null_report(spark, sf_dir):
    return report.null_report(join.attach_prompt(*_sides(spark, sf_dir)), ["prompt", "continuation"])


@query(f"""with {SIDES_SQL}, sides as (select c.row_id as l, p.row_id as r from continuations c full join prompts p
  on c.row_id = p.row_id)
select count_if(l is not null and r is not null)::bigint as both_sides, count_if(r is null)::bigint as left_only,
count_if(l is null)::bigint as right_only, count_if(l is null or r is null) = 0 as aligned from sides""")
def key_alignment(spark, sf_dir):
    return join.key_alignment(*_sides(spark, sf_dir)).withColumnRenamed("both", "both_sides")


@query("""select 'documents' as frame, count(*) as n_rows, 5 as n_columns from documents
union all select 'labels', count(*), 3 from labels""")
def row_report(spark, sf_dir):
    return report.row_report(**{name: table(spark, sf_dir, name) for name in ("documents", "labels")})
