"""Registered queries on tables with empty texts, against their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
NAMES = ["category_paths", "mbox_ingest", "mime_decode", "msg_normalized", "thread_input"]

pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def blank(tmp_path_factory):
    """The smallest tables, every third document without text, some others with slashes in front."""
    folder = tmp_path_factory.mktemp("blank")
    for table in SF.iterdir():
        if table.name != "documents.parquet":
            (folder / table.name).symlink_to(table)
    duckdb.connect().execute(f"""
        COPY (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 10 = 2 THEN '/a/b ' || text ELSE text END AS text)
              FROM '{SF}/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_on_blank_texts(spark, blank, name):
    db = duckdb.connect()
    for table in blank.iterdir():
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = db.sql(entry.oracle_sql()[name])
    frame = entry.queries()[name](spark, str(blank)).select(*want.columns)
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)
