"""Collecting, resuming, scoring and streaming, with stub plug-ins built on md5."""

from hashlib import md5

from pyspark.sql import functions as F

from prosegauge.config import ATTRS, LABELS, Config
from prosegauge.functions.ranks import digest_share
from prosegauge.functions.text import clean_continuation, strip_prompt_prefix
from prosegauge.operators import enrich, join, report, split, take
from prosegauge.plans import prompts as prompt_plan
from prosegauge.plans import responses as response_plan
from prosegauge.plans.scoring import score_responses
from prosegauge.queries.common import PAIRS_SQL, md5_share_sql, pairs, query, scored_events, table
from prosegauge.queries.common import SCORED_EVENTS_SQL
from prosegauge.queries.texts import boilerplate_sql, overlap_steps_sql, truncate_sql
from prosegauge.session import fresh_path, stored
from prosegauge.sources import readers, writers
from prosegauge.streaming import incremental, windows

SCORES_SQL = ", ".join(f"{md5_share_sql(f"'{a}|' || text")} as {a}" for a in ATTRS)


def _share(attribute, text):
    return int(md5(f"{attribute}|{text}".encode()).hexdigest()[:8], 16) / 4294967295


def stub_scorer():
    """Scores from md5; every text of an odd length is unsupported."""

    def score(texts):
        return [
            enrich.Reply(400) if len(t) % 2 else enrich.Reply(200, {a: _share(a, t) for a in ATTRS}) for t in texts
        ]

    return score


def plain_scorer():
    return lambda texts: [enrich.Reply(200, {a: _share(a, t) for a in ATTRS}) for t in texts]


def failing_scorer():
    """Replies with a status of its own for every residue of the length."""
    statuses = (200, 400, 429, 500)
    return lambda texts: [enrich.Reply(statuses[len(t) % 4], dict.fromkeys(ATTRS, 0.5)) for t in texts]


def stub_generator(banned=()):
    """The prompt, a break and its md5 in quotes."""
    return lambda texts: [f'{t}\n "{md5(t.encode()).hexdigest()}" ' for t in texts]


def chat_generator():
    """A chat reply that echoes the prompt; no reply for every prompt of a length divisible by 3."""

    def reply(texts):
        return [None if len(t) % 3 == 0 else f"{t} {md5(t.encode()).hexdigest()} ends here." for t in texts]

    return reply


@query("""with users as (select *, lead(role) over (partition by conv_id order by turn) as after_role from conversations),
done as (select text from users where role = 'user' and after_role = 'assistant')
select conv_id, turn, text as prompt from users where role = 'user' and text not in (select text from done)""")
def pending_prompts(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    users = users.select("conv_id", "turn", F.col("text").alias("prompt"))
    return join.pending(users, pairs(spark, sf_dir))


@query(f"""with {PAIRS_SQL}, users as (select conv_id * 100000 + turn as row_id, 'chat' as model,
  cast(turn as varchar) as label, text as prompt from conversations where role = 'user'),
done as (select cast(turn as varchar) as label, count(distinct prompt) as n from pairs group by 1),
rest as (select *, row_number() over (partition by label order by row_id) as place from users
  where prompt not in (select prompt from pairs))
select row_id, model, rest.label, prompt from rest left join done using (label)
where place <= greatest(0, 120 - coalesce(n, 0))""")
def take_quota(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    tagged = users.selectExpr(
        "conv_id * 100000 + turn as row_id", "'chat' as model", "cast(turn as string) as label", "text as prompt"
    )
    done = pairs(spark, sf_dir).selectExpr("'chat' as model", "cast(turn as string) as label", "prompt")
    return take.take_quota(join.pending(tagged, done), "row_id", 120, done)


@query(f"""with {PAIRS_SQL} select 'chat' as model, cast(turn as varchar) as label, count(distinct prompt) as n_done,
cast(50 as bigint) as quota, count(distinct prompt) >= 50 as complete from pairs group by turn""")
def progress(spark, sf_dir):
    done = pairs(spark, sf_dir).selectExpr("'chat' as model", "cast(turn as string) as label", "prompt")
    return report.progress(done, 50)


ANSWERS_SQL = f"""{PAIRS_SQL}, answers as (select row_id, case turn when 0 then continuation when 1 then null
  when 2 then '' else continuation end as continuation from pairs)"""


def _answers(spark, sf_dir):
    answer = "case turn when 0 then continuation when 1 then null when 2 then '' else continuation end as continuation"
    return pairs(spark, sf_dir).selectExpr("row_id", answer)


@query(f"with {ANSWERS_SQL} select * from answers where continuation <> ''")
def accepted(spark, sf_dir):
    return join.accepted(_answers(spark, sf_dir))


@query(f"with {ANSWERS_SQL} select * from answers where continuation is null or continuation = ''")
def rejected(spark, sf_dir):
    return join.rejected(_answers(spark, sf_dir))


@query(f"""select doc_id, case when length(text) % 2 = 0 then 200 else 400 end as status, s.* exclude (doc_id)
from documents left join (select doc_id, {SCORES_SQL} from documents where length(text) % 2 = 0) s using (doc_id)""")
def score_attributes(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return enrich.score_attributes(texts, "text", stub_scorer).drop("text")


@query("""select doc_id, case when length(text) % 4 = 0 then 'ok' when length(text) % 4 = 3 then 'dead_letter'
else 'null_score' end as route, case when length(text) % 4 = 0 then 0.5::double end as toxicity from documents""")
def status_route(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = Config().retry.__class__(attempts=2, base=0.0)
    scored = enrich.score_attributes(texts, "text", failing_scorer, retry=none, dead_letters=True)
    return scored.select("doc_id", enrich.status_route(F.col("status")).alias("route"), "toxicity")


VARIANTS_SQL = f"""{PAIRS_SQL}, responses as (select row_id, model, cast(turn as varchar) as label, prompt,
  continuation || model as continuation from pairs, (select unnest(['base', 'base_BW']) as model))"""


def _variants(spark, sf_dir):
    models = F.explode(F.array(F.lit("base"), F.lit("base_BW")))
    rows = pairs(spark, sf_dir).withColumn("model", models)
    return rows.selectExpr("row_id", "model", "cast(turn as string) as label", "prompt", "continuation || model as continuation")


@query(f"""with {VARIANTS_SQL} select row_id, model, label, {SCORES_SQL}
from (select *, continuation as text from responses) where not (model = 'base' and label = '0')""")
def score_models(spark, sf_dir):
    responses = _variants(spark, sf_dir)
    done = responses.where("model = 'base' and label = '0'")
    return enrich.score_models(responses, plain_scorer, done).drop("prompt", "continuation", "status")


@query(f"""with {PAIRS_SQL} select row_id, '''' || md5(prompt) || '''' as continuation from pairs""")
def enrich_text(spark, sf_dir):
    rows = enrich.enrich_text(pairs(spark, sf_dir).select("row_id", "prompt"), stub_generator, name="full")
    text = clean_continuation(strip_prompt_prefix(F.col("full"), F.col("prompt")))
    return rows.select("row_id", text.alias("continuation"))


def _foreign_csv(spark, sf_dir):
    path = fresh_path(spark, "foreign-csv")
    kind = "case when event_type = 'error' then 'error,surplus' else event_type end as Continuation"
    rows = table(spark, sf_dir, "events").selectExpr("cast(event_id as string) as Prompts", kind)
    rows.write.options(header=True, quote="").csv(path)
    return path


@query("""select cast(event_id as varchar) as prompt, event_type as continuation from events
where event_type <> 'error'""")
def lenient_csv(spark, sf_dir):
    """Errors are written with a surplus field."""
    return readers.read_responses_lenient(spark, _foreign_csv(spark, sf_dir))


@query("""select count(*) as n_rows, count_if(event_type = 'error') as n_over_long, count_if(event_type <> 'error') as n_kept
from events""")
def counted_csv(spark, sf_dir):
    """The same file: rows and over-long rows as counted by the job that writes the table."""
    rows, counts = readers.read_responses_counted(spark, _foreign_csv(spark, sf_dir))
    kept, seen = stored(rows, "responses"), counts.get
    return kept.agg(F.count("*").alias("n_kept")).withColumns({c: F.lit(seen[c]) for c in ("n_rows", "n_over_long")}).select(
        F.col("n_rows").cast("long"), F.col("n_over_long").cast("long"), "n_kept"
    )


@query(f"""with {PAIRS_SQL} select model, case when turn < 2 then '0-0.25' else '0.75-1.0' end as label, prompt,
continuation || model as continuation,
case when (model = 'base') <> (turn < 2) then '2025-01-02 03:04:05' end as collected_at from pairs, (select unnest(['base', 'base_BW']) as model)""")
def scan_models(spark, sf_dir):
    """Files of one model lack the timestamp, those of the other have it first and the texts the other way round."""
    root = fresh_path(spark, "responses")
    rows = _variants(spark, sf_dir).withColumn("range", F.expr("if(cast(label as int) < 2, '0-0.25', '0.75-1.0')"))
    columns = {
        ("base", LABELS[0]): ["Prompts", "Continuation"],
        ("base", LABELS[-1]): ["Continuation", "Prompts", "Timestamp"],
        ("base_BW", LABELS[0]): ["Timestamp", "Continuation", "Prompts"],
        ("base_BW", LABELS[-1]): ["Prompts", "Continuation"],
    }
    for (model, label), names in columns.items():
        part = rows.where((F.col("model") == model) & (F.col("range") == label))
        part = part.selectExpr("prompt as Prompts", "continuation as Continuation", "'2025-01-02 03:04:05' as Timestamp")
        writers.write_csv(part.select(*names), f"{root}/{model}/responses_{label}.csv")
    dirs = {model: f"{root}/{model}" for model in ("base", "base_BW")}
    found = readers.scan_model_dirs(spark, dirs)
    return found.withColumn("collected_at", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss"))


RECORDS_SQL = f"""{PAIRS_SQL}, scored as (select row_id, prompt, continuation,
  {md5_share_sql("'prompt|' || prompt")} as prompt_score, {md5_share_sql("'reply|' || continuation")} as score from pairs)"""


def _pair_corpus(spark, sf_dir):
    """The answered turns as a JSON Lines corpus with scores from md5."""
    path = fresh_path(spark, "pairs-jsonl")
    rows = pairs(spark, sf_dir)
    first = digest_share(F.md5(F.concat(F.lit("prompt|"), "prompt")))
    second = digest_share(F.md5(F.concat(F.lit("reply|"), "continuation")))
    rows.select(
        F.struct(F.col("prompt").alias("text"), first.alias("toxicity")).alias("prompt"),
        F.struct(F.col("continuation").alias("text"), second.alias("toxicity")).alias("continuation"),
    ).write.json(path)
    return path


@query(f"""with {RECORDS_SQL}, binned as (select prompt, prompt_score, case when prompt_score <= 0.25 then '0-0.25'
  when prompt_score <= 0.5 then '0.25-0.5' when prompt_score <= 0.75 then '0.5-0.75' else '0.75-1.0' end as toxicity_bin
  from scored)
select toxicity_bin, count(*) as n_prompts from binned group by 1""")
def prompt_ranges(spark, sf_dir):
    """The prompt job over a corpus of the answered turns: rows per range before equalising."""
    tables = prompt_plan.generate_prompts(spark, _pair_corpus(spark, sf_dir), fresh_path(spark, "prompts"))
    binned = tables.prompts.withColumn("toxicity_bin", split.bucketize(F.col("toxicity")))
    return binned.groupBy("toxicity_bin").agg(F.count("*").alias("n_prompts"))


@query(f"""with {RECORDS_SQL} select 'ranges' as name, count(*) * 4 as n_rows from (select case
  when prompt_score <= 0.25 then 0 when prompt_score <= 0.5 then 1 when prompt_score <= 0.75 then 2 else 3 end as b
  from scored) group by b qualify row_number() over (order by count(*)) = 1
union all select 'corpus', 2 * least(count_if(score >= 0.5), count_if(score < 0.5))::bigint from scored
union all select 'continuations', count(*) from scored""")
def prompt_tables(spark, sf_dir):
    """Sizes of what the prompt job writes: equal ranges, balanced classes, all continuations."""
    tables = prompt_plan.generate_prompts(spark, _pair_corpus(spark, sf_dir), fresh_path(spark, "prompts"))
    frames = {"ranges": tables.ranges, "corpus": tables.corpus, "continuations": tables.continuations}
    return report.row_report(**frames).selectExpr("frame as name", "n_rows")


@query(f"""with {PAIRS_SQL}, kinds as (select row_id % 7 as kind, prompt, continuation from pairs)
select 'n_rows' as name, count(*) as n from kinds
union all select 'unparsed_lines', count_if(kind = 0) from kinds
union all select 'unparsed_prompt', count_if(kind = 1 or kind > 1 and prompt is null) from kinds
union all select 'unparsed_continuation', count_if(kind not in (0, 2) and continuation is null) from kinds
union all select 'null_prompt', count_if(kind < 2 or prompt is null) from kinds
union all select 'null_continuation', count_if(kind in (0, 2) or continuation is null) from kinds
union all select 'null_toxicity', count(*) from kinds""")
def prompt_counts(spark, sf_dir):
    """The prompt job's own counts over a corpus with broken lines, prompts that are no record and absent replies."""
    source, kind, absent = fresh_path(spark, "mixed-jsonl"), F.pmod(F.col("row_id"), F.lit(7)), F.lit(None)
    prompt = F.when(kind == 1, "no record").otherwise(F.to_json(F.struct(F.col("prompt").alias("text"))))
    reply = F.when(kind == 2, absent).otherwise(F.to_json(F.struct(F.col("continuation").alias("text"))))
    line = F.to_json(F.struct(prompt.alias("prompt"), reply.alias("continuation")))
    pairs(spark, sf_dir).select(F.when(kind == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(source)
    counts = prompt_plan.generate_prompts(spark, source, fresh_path(spark, "prompts")).counts
    told = ("n_rows", "unparsed_lines", "unparsed_prompt", "unparsed_continuation", "null_prompt", "null_continuation", "null_toxicity")
    return spark.createDataFrame([(name, counts[name]) for name in told], "name string, n long")


RANGED_SQL = f"{SCORED_EVENTS_SQL}, ranged as (select row_id, cast(row_id as varchar) as prompt, toxicity_bin as label from scored where toxicity_bin is not null)"


def _ranged(spark, sf_dir):
    rows = scored_events(spark, sf_dir).withColumn("toxicity_bin", split.bucketize(F.col("score")))
    return rows.where("toxicity_bin is not null").selectExpr("row_id", "cast(row_id as string) as prompt", "toxicity_bin")


@query(f"""with {RANGED_SQL} select 'base_BW' as model, label, prompt, '''' || md5(prompt) || '''' as continuation
from ranged""")
def generate_responses(spark, sf_dir):
    """The local-model job with a banned list, over every event as a prompt."""
    path = fresh_path(spark, "responses")
    response_plan.generate_responses(
        _ranged(spark, sf_dir), path, {"base": stub_generator}, variant="BW", banned=[[1], [2, 3]]
    )
    return readers.read_responses(spark, path).select("model", "label", "prompt", "continuation")


@query(f"""with {RANGED_SQL} select 'base' as model, label, count(*) as n_rows from ranged where label <> '0-0.25' group by label
union all select 'other', label, count(*) from ranged group by label""")
def replace_models(spark, sf_dir):
    """Two models generated over all ranges, then one of them anew without the lowest range."""
    path, ranged = fresh_path(spark, "responses"), _ranged(spark, sf_dir)
    response_plan.generate_responses(ranged, path, {"base": stub_generator, "other": stub_generator})
    response_plan.generate_responses(ranged.where("toxicity_bin <> '0-0.25'"), path, {"base": stub_generator})
    return readers.read_responses(spark, path).groupBy("model", "label").agg(F.count("*").alias("n_rows"))


@query(f"""with {RANGED_SQL}, echoes as (select label, prompt, prompt || ' ' || md5(prompt) || ' ends here.' as reply
  from ranged where length(prompt) % 3 <> 0),
{overlap_steps_sql('echoes', 'label')}, plain as (select label, prompt, {boilerplate_sql('text')} as text from removed)
select 'chat' as model, label, prompt, {truncate_sql('prompt', 'text', 20)} as continuation from plain""")
def collect_responses(spark, sf_dir):
    """The collector job over every event as a prompt; some prompts never get a reply."""
    path = fresh_path(spark, "collected")
    config = Config(rounds=2, in_flight=1)  # a generator that never waits gains nothing by threads
    rows = response_plan.collect_responses(
        _ranged(spark, sf_dir), path, "chat", chat_generator, config, quota=0, sleep=lambda seconds: None
    )
    return rows.select("model", "label", "prompt", "continuation")


def short_prompt_failures():
    """No reply for prompts of two characters."""
    return lambda texts: [None if len(t) == 2 else f"{t} and more." for t in texts]


def some_failures():
    """No reply for prompts that end in 3."""
    return lambda texts: [None if t.endswith("3") else f"{t} and more." for t in texts]


@query(f"""with {RANGED_SQL}, answered as (select *, row_number() over (partition by label order by row_id) as place
  from ranged where prompt not like '%3')
select 'chat' as model, label, prompt from answered where place <= 60""")
def collect_range_quota(spark, sf_dir):
    """The collector with a quota over every event as a prompt; some of the first prompts never get a reply."""
    path = fresh_path(spark, "collected")
    config = Config(rounds=2, slice_rows=25, in_flight=2, concurrency=4)
    rows = response_plan.collect_responses(
        _ranged(spark, sf_dir), path, "chat", some_failures, config, quota=60, sleep=lambda seconds: None
    )
    return rows.select("model", "label", "prompt")


@query(f"""with {VARIANTS_SQL} select model, label, prompt, status, toxicity, flirtation from (
  select model, label, prompt, 200 as status, {SCORES_SQL} from (select *, continuation as text from responses))""")
def score_resume(spark, sf_dir):
    """The scoring job over a part of the rows, then over all, a few at a time."""
    out = fresh_path(spark, "scored")
    responses = _variants(spark, sf_dir).drop("row_id")
    config = Config(pace=None, slice_rows=150)
    for part in (responses.where("label = '0'"), responses):
        rows = score_responses(spark, part, out, plain_scorer, config, resume=True)
    return rows.select("model", "label", "prompt", "status", "toxicity", "flirtation")


@query(f"""with {VARIANTS_SQL} select model, label, prompt, status, toxicity, flirtation from (
  select model, label, prompt, 200 as status, {SCORES_SQL} from (select *, continuation as text from responses))""")
def score_responses_job(spark, sf_dir):
    """The scoring job, run twice with resume: the second run finds nothing left."""
    out = fresh_path(spark, "scored")
    responses = _variants(spark, sf_dir).drop("row_id")
    for _ in range(2):
        rows = score_responses(spark, responses, out, plain_scorer, Config(pace=None), resume=True)
    return rows.select("model", "label", "prompt", "status", "toxicity", "flirtation")


@query("""select text as prompt, min(md5(text)) as continuation from conversations where role = 'user'
and length(text) % 3 <> 0 group by text""")
def incremental_enrich(spark, sf_dir):
    """Prompts arrive in two files, the second repeating the first."""
    source, out, marks = (fresh_path(spark, name) for name in ("arrivals", "collected", "progress"))
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("text").alias("prompt"))

    def reply(fresh):
        rows = enrich.enrich_text(fresh, chat_generator, name="raw")
        return rows.select("prompt", F.element_at(F.split(strip_prompt_prefix(F.col("raw"), F.col("prompt")), " "), 2).alias("continuation"))

    schema = reply(users).schema
    for _ in range(2):
        users.write.mode("append").parquet(source)
        stream = spark.readStream.schema(users.schema).parquet(source)
        incremental.incremental_enrich(stream, reply, schema, out, marks).awaitTermination()
    return incremental.read_collected(spark, out, schema).drop(incremental.BATCH)


@query("select event_id, event_type from events")
def dedupe_watermark(spark, sf_dir):
    """Every event arrives twice."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(ts as timestamp) as collected_at")
    source, out, marks = (fresh_path(spark, name) for name in ("arrivals", "deduped", "progress"))
    events.write.parquet(source)
    schema = events.schema
    twice = spark.readStream.schema(schema).parquet(source).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = incremental.dedupe_within_watermark(twice.drop("copy"), "event_id", "collected_at")
    writer = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).drop("collected_at")


@query("""with hours as (select date_trunc('hour', ts::timestamp) as hour, count(distinct event_id) as n_rows from events group by 1)
select strftime(hour, '%Y-%m-%d %H:%M:%S') as window_start, n_rows, 'counted' as kind from hours
union all select strftime(min(hour), '%Y-%m-%d %H:%M:%S'), 1, 'late' from hours""")
def window_counts(spark, sf_dir):
    """Events arrive in four parts, in the order of their time; then one of them again, one from the first hour, and one a day later."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(ts as timestamp) as ts")
    source, out, marks = (fresh_path(spark, name) for name in ("arrivals", "windows", "progress"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.lit(3), F.floor((F.unix_timestamp("ts") - int(first.timestamp())) * 4 / max(1, int((last - first).total_seconds()))))
    for number in range(4):
        events.where(part == number).coalesce(1).write.mode("append").parquet(source)
    again = events.where(F.col("ts") == last).limit(1)
    late = events.where(F.col("ts") == first).limit(1).withColumn("event_id", F.lit(-1).cast("long"))
    again.unionByName(late).coalesce(1).write.mode("append").parquet(source)
    end = again.withColumn("event_id", F.lit(-2).cast("long")).withColumn("ts", F.expr("ts + interval 1 day"))
    end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for started in windows.start_counts(stream, out, marks, "event_id", "ts"):
        started.awaitTermination()
    counted = windows.read_counts(spark, out).select("window_start", "n_rows", F.lit("counted").alias("kind"))
    missed = windows.read_late(spark, out, events.schema).select(F.date_trunc("hour", "ts"), F.lit(1).cast("long"), F.lit("late"))
    return counted.union(missed).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
