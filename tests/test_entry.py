"""Driver contract: entry runs on sf0.001, every query has a name-matching oracle or is
documented as rows-only, and a few cheap queries equal their oracle on sf0.001."""

import duckdb

import __spark_entry__ as entry
from quire.plans import queries
from conftest import SF001

ROWS_ONLY: set[str] = set()
TABLES = "documents embeddings pages labels conversations".split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"input_id", "document_no", "topic_name", "page_start", "page_end"} <= set(df.columns)


def test_every_query_of_the_library_has_an_oracle():
    own = set(queries.registry())
    assert own - set(entry.oracle_sql()) == ROWS_ONLY
    assert own | set(entry.oracle_sql()) <= set(entry.queries())


def _compare(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    s = entry.queries()[key](spark, SF001).toPandas()
    o = con.sql(entry.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(o.columns)
    cols = sorted(s.columns)
    a = sorted(map(tuple, s[cols].astype(str).values.tolist()))
    b = sorted(map(tuple, o[cols].astype(str).values.tolist()))
    assert a == b


def test_cheap_queries_match_oracles(spark):
    for key in ["page_numbering", "l2_distance", "cluster_average", "gap_split", "page_text", "boundary_detection", "adjusted_rand"]:
        _compare(spark, key)
