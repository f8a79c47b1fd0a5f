"""Classes, ranges, heads and samples."""

from pyspark.sql import functions as F

from prosegauge.functions.text import clean_continuation
from prosegauge.operators import split, take
from prosegauge.queries.common import SCORED_EVENTS_SQL, clean_sql, query, scored_events, table
from prosegauge.session import fresh_path
from prosegauge.sources import readers, writers

CLASSED_SQL = "classed as (select row_id, score, case when score >= 0.5 then 1 else 0 end as class from scored)"


@query(f"""with both_tables as (select doc_id, toxic as class, text from labels join documents using (doc_id)),
placed as (select *, row_number() over (partition by class order by doc_id) as place,
  least(count_if(class = 0) over (), count_if(class = 1) over ()) as smallest from both_tables)
select doc_id, class, {clean_sql('text')} as text from placed where place <= smallest""")
def balanced_corpus(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic as class")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    balanced = take.balance_classes(labels.join(texts, "doc_id"), "class", "doc_id")
    return balanced.select("doc_id", "class", clean_continuation(F.col("text")).alias("text"))


@query(f"with {SCORED_EVENTS_SQL}, {CLASSED_SQL} select row_id, class from classed where score is not null")
def threshold_split(spark, sf_dir):
    return split.split_by_threshold(scored_events(spark, sf_dir), "score").select("row_id", "class")


@query(f"with {SCORED_EVENTS_SQL}, {CLASSED_SQL} select class, count(*) as n_rows from classed group by class")
def class_counts(spark, sf_dir):
    return split.class_counts(split.split_by_threshold(scored_events(spark, sf_dir), "score"))


def _binned(spark, sf_dir):
    return scored_events(spark, sf_dir).withColumn("toxicity_bin", split.bucketize(F.col("score")))


@query(f"""with {SCORED_EVENTS_SQL} select row_id, toxicity_bin,
coalesce(list_position(['0-0.25', '0.25-0.5', '0.5-0.75', '0.75-1.0'], toxicity_bin) - 1, -1) as bin_idx from scored""")
def bucketize_scores(spark, sf_dir):
    binned = _binned(spark, sf_dir)
    return binned.select("row_id", "toxicity_bin", F.coalesce(split.range_index(F.col("toxicity_bin")), F.lit(-1)).alias("bin_idx"))


@query(f"""with {SCORED_EVENTS_SQL}, frame as (select unnest(['0-0.25', '0.25-0.5', '0.5-0.75', '0.75-1.0']) as toxicity_bin,
  unnest([0, 1, 2, 3]) as bin_idx)
select toxicity_bin, bin_idx, (select count(*) from scored where scored.toxicity_bin = frame.toxicity_bin) as n_rows
from frame""")
def range_counts(spark, sf_dir):
    return split.range_counts(_binned(spark, sf_dir), "toxicity_bin")


@query(f"""with {SCORED_EVENTS_SQL}, counts as (select toxicity_bin, count(*) as n from scored
  where toxicity_bin is not null group by 1)
select case when count(*) < 4 then 0 else least(min(n), 6250) end as common_size from counts""")
def common_size(spark, sf_dir):
    return split.common_size(split.range_counts(_binned(spark, sf_dir), "toxicity_bin"), 6250)


@query(f"""with {SCORED_EVENTS_SQL}, placed as (select *, row_number() over (partition by toxicity_bin order by row_id) as place
  from scored where toxicity_bin is not null)
select row_id, toxicity_bin from placed where place <= 200""")
def head_per_range(spark, sf_dir):
    binned = _binned(spark, sf_dir).where("toxicity_bin is not null")
    return take.head_per_group(binned, ["toxicity_bin"], "row_id", 200).select("row_id", "toxicity_bin")


@query("""select o_custkey, o_orderkey from (
  select *, row_number() over (partition by o_custkey order by o_orderkey) as place from orders) where place <= 2""")
def head_per_customer(spark, sf_dir):
    """More groups than are collected, at any but the smallest size."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return take.head_per_group(orders, ["o_custkey"], "o_orderkey", 2)


@query("select event_id from events order by md5('42|' || event_id) limit 500")
def sample_exact(spark, sf_dir):
    return take.sample_exact(table(spark, sf_dir, "events").select("event_id"), 500, 42, "event_id")


EQUALIZED_SQL = """headed as (select * from (select *, count(*) over (partition by toxicity_bin) as n,
    row_number() over (partition by toxicity_bin order by row_id) as place from scored where toxicity_bin is not null)
  where place <= 2000),
equalized as (select row_id, toxicity_bin, score from (select *, row_number() over (partition by toxicity_bin
    order by md5('42|' || row_id)) as drawn, (select case when count(distinct toxicity_bin) < 4 then 0
    else least(min(n), 2000) end from headed) as common from headed) where drawn <= common)"""


def _equalized(spark, sf_dir):
    return take.equalize_ranges(scored_events(spark, sf_dir), "score", "row_id", size=2000)


@query(f"with {SCORED_EVENTS_SQL}, {EQUALIZED_SQL} select row_id, toxicity_bin from equalized")
def equalize_ranges(spark, sf_dir):
    return _equalized(spark, sf_dir).select("row_id", "toxicity_bin")


@query(f"""with {SCORED_EVENTS_SQL}, {EQUALIZED_SQL} select row_id, score, toxicity_bin from equalized
where toxicity_bin in ('0-0.25', '0.75-1.0')""")
def write_ranges_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "ranges")
    ranges = _equalized(spark, sf_dir)
    writers.write_ranges(ranges, path)
    back = spark.read.schema(ranges.schema).parquet(path)
    return readers.load_ranges(back, ["0-0.25", "0.75-1.0"]).select("row_id", "score", "toxicity_bin")


@query("""with lines as (select toxic as class, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as parts, text
  from labels join documents using (doc_id)),
each as (select class, unnest(case when text like '%' || chr(10) then parts[:-2] else parts end) as line from lines)
select class, line as value, count(*) as n_rows from each group by 1, 2""")
def corpus_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "class-corpora")
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic as class")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    writers.write_corpus(labels.join(texts, "doc_id"), path)
    lines = readers.read_corpus_lines(spark, path)
    return lines.groupBy("class", "value").agg(F.count("*").alias("n_rows"))
