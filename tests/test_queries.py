"""Each registered query against its SQL on DuckDB."""

import math

import pytest

from nearfold import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    rel = db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    found, expected = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert found == expected
    assert found or name in ("list_groups_page",)


def test_every_query_without_sql_gives_rows(spark, sf):
    for name in queries.QUERIES.keys() - queries.ORACLE_SQL.keys():
        assert queries.QUERIES[name](spark, sf).count()


@pytest.mark.parametrize("name", ["stream_upsert", "streamed_events"])
def test_streams_read_tables_that_are_folders(spark, sf, tmp_path, name):
    """A table may be one file or a folder of parts, whose names say nothing of the table."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df, rel = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLE_SQL[name])
    found = rows_of(df.columns, df.collect())
    assert found and found == rows_of(rel.columns, rel.fetchall())


def test_capture_data_is_parsed_once(spark, sf):
    plan = queries.QUERIES["exif_tags"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
