import duckdb
import pytest

import corpus_pipeline
from prosegauge.llm.queries import QUERIES, SQL, table
from prosegauge.session import stored

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for each in ("benchmark", "conversations", "documents", "pages"):
        connection.sql(f"create view {each} as select * from '{SF_DIR}/{each}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    expected = connection.sql(SQL[name]).df()[columns]
    rows = [sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))) for frame in (found.select(*columns).toPandas().astype(expected.dtypes), expected)]
    assert rows[0] == rows[1]


def test_every_stage_keeps_the_columns_of_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).toPandas()
    assert packed[packed.piece == 0].doc_id.nunique() == sizes[-1]
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
