"""Text clean-up. The test texts hold no curly quotes, echoes or chat openings, so
both sides of these queries put them in."""

from pyspark.sql import functions as F

from prosegauge.functions import text as t
from prosegauge.queries.common import (
    PAIRS_SQL,
    clean_sql,
    fold_sql,
    normalize_sql,
    pairs,
    query,
    quoted,
    strip_sql,
    table,
    words_sql,
)

MARKED_SQL = "'“' || text || '”... ‘so’ — it' || chr(160) || 'ends'"


def _documents(spark, sf_dir, function):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return texts.select("doc_id", function(F.col("text")).alias("text"))


def _marked(text):
    return F.concat(F.lit("“"), text, F.lit("”... ‘so’ — it ends"))


@query(f"select doc_id, {clean_sql('text')} as text from documents")
def clean_text(spark, sf_dir):
    return _documents(spark, sf_dir, t.clean_continuation)


@query(f"select doc_id, {fold_sql(MARKED_SQL)} as text from documents")
def fold_typography(spark, sf_dir):
    return _documents(spark, sf_dir, lambda text: t.fold_typography(_marked(text)))


@query(f"select doc_id, {normalize_sql(MARKED_SQL)} as text from documents")
def normalize_match(spark, sf_dir):
    return _documents(spark, sf_dir, lambda text: t.normalize_for_match(_marked(text)))


# replies: the prompt echoed, echoed with other punctuation, or left out; with and
# without a chat opening
OPENING = "Of course! Here’s a continuation of that text: "
REPLIES_SQL = f"""{PAIRS_SQL}, echoes as (
  select row_id, prompt, 'exact' as echo, prompt || ' ' || continuation as reply from pairs
  union all select row_id, prompt, 'loose', replace(prompt, '.', ' !') || ' ' || continuation from pairs
  union all select row_id, prompt, 'none', continuation from pairs
  union all select row_id, prompt, 'opening', {quoted(OPENING)} || continuation from pairs)"""


def _replies(spark, sf_dir):
    prompt, continuation = F.col("prompt"), F.col("continuation")
    kinds = {
        "exact": F.concat(prompt, F.lit(" "), continuation),
        "loose": F.concat(F.replace(prompt, F.lit("."), F.lit(" !")), F.lit(" "), continuation),
        "none": continuation,
        "opening": F.concat(F.lit(OPENING), continuation),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("echo"), v.alias("reply")) for k, v in kinds.items()]))
    return pairs(spark, sf_dir).select("row_id", "prompt", each.alias("_each")).select("row_id", "prompt", "_each.*")


def overlap_steps_sql(source: str, kept: str) -> str:
    """Overlap removal as steps over ``source``; the result is ``text`` of ``removed``."""
    return f"""rests as (select {kept}, prompt, replace(reply, prompt, '') as rest from {source}),
sides as (select *, {normalize_sql('prompt')} as needle, {normalize_sql('rest')} as hay, {words_sql('rest')} as tokens
  from rests),
ends as (select *, case when instr(hay, needle) > 0 then instr(hay, needle) - 1 + length(needle)
  else len(tokens) end as stop from sides),
removed as (select {kept}, prompt, array_to_string(case when stop = 0 or stop >= len(tokens) then tokens
  else tokens[len(tokens) - stop + 1 : len(tokens)] end, ' ') as text from ends)"""


#: The opening phrase and white space once more, spelled out for the other engine.
BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PHRASE = (
    f"(?i)^{BLANK}*of course\\b[.,:!]*{BLANK}*here(?:{BLANK}+is|['’]s){BLANK}+(?:(?:the|a){BLANK}+)?continuation\\b"
    f"(?:{BLANK}+of\\b(?:{BLANK}+(?:that|the){BLANK}+text\\b)?)?"
    f"(?:{BLANK}*,?{BLANK}*written{BLANK}+in{BLANK}+the{BLANK}+style{BLANK}+of{BLANK}+[^.:]+)?{BLANK}*[:.]?{BLANK}*"
)


def boilerplate_sql(text: str) -> str:
    return strip_sql(f"regexp_replace({text}, {quoted(PHRASE)}, '')")


def truncate_sql(prompt: str, text: str, limit: int) -> str:
    seen, full = f"len({words_sql(prompt)})", words_sql(f"{prompt} || {text}")
    return f"""case when len({full}) - {seen} <= {limit} then {text}
else array_to_string(({full})[{seen} + 1 : {seen} + {limit}], ' ') end"""


@query(f"with {REPLIES_SQL}, {overlap_steps_sql('echoes', 'row_id, echo')} select row_id, echo, text from removed")
def remove_overlap(spark, sf_dir):
    text = t.remove_overlap(F.col("prompt"), F.col("reply"))
    return _replies(spark, sf_dir).select("row_id", "echo", text.alias("text"))


@query(f"with {REPLIES_SQL} select row_id, echo, {boilerplate_sql('reply')} as text from echoes")
def remove_boilerplate(spark, sf_dir):
    return _replies(spark, sf_dir).select("row_id", "echo", t.remove_boilerplate(F.col("reply")).alias("text"))


@query(f"with {PAIRS_SQL} select row_id, {truncate_sql('prompt', 'continuation', 20)} as text from pairs")
def truncate_tokens(spark, sf_dir):
    text = t.truncate_new_tokens(F.col("prompt"), F.col("continuation"), 20)
    return pairs(spark, sf_dir).select("row_id", text.alias("text"))


@query(f"""with {REPLIES_SQL}, {overlap_steps_sql('echoes', 'row_id, echo')},
plain as (select row_id, echo, prompt, {boilerplate_sql('text')} as text from removed)
select row_id, echo, {truncate_sql('prompt', 'text', 20)} as text from plain""")
def clean_response(spark, sf_dir):
    text = t.clean_response(F.col("prompt"), F.col("reply"))
    return _replies(spark, sf_dir).select("row_id", "echo", text.alias("text"))
