"""Queries against their own SQL on tables with what larger ones have: repeats, equal moments, blank lines."""

from __future__ import annotations

import datetime

import pytest

from quillstack.plans import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def both(spark, folder, query, **tables):
    """Rows of the query and of its SQL, sorted; a table is (columns, rows)."""
    sql = duckdb.connect()
    for name, (columns, rows) in tables.items():
        sql.execute(f"CREATE TABLE {name} ({columns})")
        sql.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        sql.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    wanted = sql.execute(ORACLES[query])
    columns = [d[0] for d in wanted.description]
    found = QUERIES[query](spark, str(folder)).select(*columns).collect()
    return sorted(map(tuple, found), key=repr), sorted(wanted.fetchall(), key=repr)


def test_methods_keep_repeated_urls(spark, tmp_path):
    rows = [(1, "https://h/a", ""), (2, "https://h/a", ""), (3, "https://h/b", ""), (4, "https://h/a", "")]
    found, wanted = both(spark, tmp_path, "method_rows", pages=("page_id BIGINT, url VARCHAR, html VARCHAR", rows))
    assert found == wanted and len(found) == 6


def test_last_memory_within_a_second(spark, tmp_path):
    """The last of the events of one second counts, not the largest of them; whole seconds pass between the first and the last."""
    at = lambda *t: datetime.datetime(*t)
    rows = [(1, at(1969, 12, 31, 23, 59, 58, 700000), 3.0), (2, at(1970, 1, 1, 0, 0, 1, 100000), 9.0), (3, at(1970, 1, 1, 0, 0, 1, 200000), 4.0), (4, at(1970, 1, 1, 0, 0, 1, 200000), 5.0), (5, at(1970, 1, 1, 0, 0, 1, 300000), None)]
    found, wanted = both(spark, tmp_path, "run_metrics", events=("event_id BIGINT, ts TIMESTAMP, value DOUBLE", rows))
    assert found == wanted == [(5, 3.0, 9.0, 5.0, round(5 / 3, 6))]


@pytest.mark.parametrize("query", ["validate_posts", "doc_validation_report", "validation_issues"])
def test_blank_first_lines_and_texts(spark, tmp_path, query):
    texts = ["\nrest", "  \nrest", "", "   ", "\n", "\n\n \n", "\t\nabc", "\u00a0", "\u00a0\n", "\x0b\nabc", "plain\nlines", "<b>x</b> " + "y" * 250, "a" * 201 + "\nz", "  <i>" + "b " * 120]
    rows = [(100 * n + k, t, None if n == 10 and k > 11 else "en", "src1", len(t)) for n, t in enumerate(texts) for k in (3, 4, 5, 6, 7, 8, 10, 11, 12, 13)]
    columns = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"
    found, wanted = both(spark, tmp_path, query, documents=(columns, rows), labels=("doc_id BIGINT, quality INT, toxic INT", [(12, 1, 0), (12, 0, 0)]))
    assert found == wanted
