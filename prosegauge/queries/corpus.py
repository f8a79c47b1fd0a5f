"""Chunks, vocabularies and token rows."""

from pyspark.sql import functions as F

from prosegauge.operators import chunk, take, tokens
from prosegauge.plans.training import prepare_training
from prosegauge.queries.common import joined, query, table, words_sql
from prosegauge.session import stored
from prosegauge.sources.readers import load_lexicon

CHUNK_EACH_SQL = """chunks as (select doc_id, n::int as chunk_no, substring(text, n * 512 + 1, 512) as chunk
  from documents, lateral (select unnest(range((length(text) + 511) // 512)) as n))"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


@query(f"with {CHUNK_EACH_SQL} select * from chunks")
def chunk_each(spark, sf_dir):
    return chunk.chunk_each(_documents(spark, sf_dir), keep=["doc_id"])


def chunk_corpus_sql(source: str, by: str, order: str) -> str:
    return f"""corpora as (select {by}, string_agg(text || chr(10), '' order by {order}) as whole from {source} group by {by}),
chunks as (select {by}, n as chunk_id, substring(whole, n * 512 + 1, 512) as chunk
  from corpora, lateral (select unnest(range((length(whole) + 511) // 512)) as n))"""


@query(f"with {chunk_corpus_sql('documents', 'lang', 'doc_id')} select * from chunks")
def chunk_corpus(spark, sf_dir):
    return chunk.chunk_corpus(_documents(spark, sf_dir), "doc_id", by=["lang"], block_rows=2_000)


def vocab_sql(source: str, text: str) -> str:
    return f"""each_token as (select unnest({words_sql(text)}) as token from {source}),
vocab as (select token, count(*) as n, row_number() over (order by count(*) desc, token) as id
  from each_token group by token)"""


def rows_sql(source: str, keys: str, text: str, length: int) -> str:
    """Ids of ``length`` at most as ``ids`` of ``looked_up``."""
    return f"""cut as (select {keys}, ({words_sql(text)})[1:{length}] as words from {source}),
places as (select {keys}, unnest(words) as token, unnest(range(len(words))) as place from cut),
found as (select {keys}, list(vocab.id order by place) as known from places join vocab using (token) group by {keys}),
looked_up as (select {keys}, coalesce(known, []) as ids from cut left join found using ({keys}))"""


def padded_sql(length: int) -> tuple[str, str]:
    ids = f"array_to_string(list_concat(ids, list_transform(range({length} - len(ids)), lambda i: 0)), ' ')"
    mask = f"array_to_string(list_transform(range({length}), lambda i: case when i < len(ids) then 1 else 0 end), ' ')"
    return ids, mask


def labels_sql(length: int) -> str:
    return f"array_to_string(list_concat(ids, list_transform(range({length} - len(ids)), lambda i: -100)), ' ')"


@query(f"with {vocab_sql('documents', 'text')} select token, n, id from vocab")
def build_vocab(spark, sf_dir):
    return tokens.build_vocab(_documents(spark, sf_dir))


def _token_rows(spark, sf_dir, length):
    texts = _documents(spark, sf_dir)
    vocab = stored(tokens.with_padding(tokens.build_vocab(texts)), "vocab")
    return tokens.tokenize_pad(texts, ["doc_id"], "text", vocab, length)


@query(f"""with {vocab_sql('documents', 'text')}, {rows_sql('documents', 'doc_id', 'text', 512)}
select doc_id, {padded_sql(512)[0]} as input_ids, {padded_sql(512)[1]} as attention_mask from looked_up""")
def tokenize_pad(spark, sf_dir):
    rows = _token_rows(spark, sf_dir, 512)
    return rows.select(
        "doc_id", joined(rows.input_ids).alias("input_ids"), joined(rows.attention_mask).alias("attention_mask")
    )


@query(f"""with {vocab_sql('documents', 'text')}, {rows_sql('documents', 'doc_id', 'text', 128)}
select doc_id, {labels_sql(128)} as labels from looked_up""")
def lm_labels(spark, sf_dir):
    rows = _token_rows(spark, sf_dir, 128)
    return rows.select("doc_id", joined(tokens.lm_labels(rows.input_ids, rows.attention_mask)).alias("labels"))


@query(f"""with lexicon as (select distinct lower(trim(p_name)) as term from part),
{vocab_sql('part', 'p_name')}, {rows_sql('lexicon', 'term', 'term', 9)}
select term, array_to_string(ids, ' ') as ids from looked_up""")
def banned_token_ids(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name")
    vocab = stored(tokens.build_vocab(names, "p_name"), "vocab")
    banned = tokens.banned_token_ids(load_lexicon(spark, names), vocab)
    return banned.select("term", joined(F.col("ids")).alias("ids"))


@query(f"""with both_tables as (select doc_id, toxic as class, text from labels join documents using (doc_id)),
placed as (select *, row_number() over (partition by class order by doc_id) as place,
  least(count_if(class = 0) over (), count_if(class = 1) over ()) as smallest from both_tables),
balanced as (select * from placed where place <= smallest),
{chunk_corpus_sql('balanced', 'class', 'doc_id')}, {vocab_sql('chunks', 'chunk')},
{rows_sql('chunks', 'class, chunk_id', 'chunk', 512)}
select class, chunk_id, {padded_sql(512)[0]} as input_ids, {labels_sql(512)} as labels from looked_up""")
def training_rows(spark, sf_dir):
    """From labelled documents to balanced, chunked and tokenised class corpora."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic as class")
    corpus = labels.join(_documents(spark, sf_dir).drop("lang"), "doc_id").withColumnRenamed("doc_id", "row_id")
    rows = prepare_training(take.balance_classes(corpus, "class", "row_id"))
    return rows.select("class", "chunk_id", joined(rows.input_ids).alias("input_ids"), joined(rows.labels).alias("labels"))
