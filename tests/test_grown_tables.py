"""Queries against their SQL on rows that the given tables reach only when they have grown."""

import duckdb

import __spark_entry__ as entry
from tests.test_queries import plain

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def same(spark, folder, name, rows):
    spark.createDataFrame([(i, t, "de", "src1", len(t or "")) for i, t in rows], DOCUMENTS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = entry.queries()[name](spark, str(folder))
    want = duckdb.sql(entry.oracle_sql()[name].replace("documents", f"read_parquet('{folder}/documents.parquet/*.parquet')"))
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert a == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    return a


def test_numbers_of_six_digits_are_no_days(spark, tmp_path):
    rows = [(3 * n + k, "x") for n in (100_101, 250_315, 143_228) for k in range(3)] + [(None, "x")]
    assert len(same(spark, tmp_path, "content_dates", rows)) == 9


def test_a_stamp_counts_whole_and_rows_without_id_are_left_out(spark, tmp_path):
    rows = [(i, "y" * n) for i, n in enumerate(range(60, 110))] + [(None, "y" * 200), (60, None), (61, None)]
    assert len(same(spark, tmp_path, "refinable_documents", rows)) == 16
