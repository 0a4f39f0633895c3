"""Every registered query of the index against its SQL in DuckDB."""

import os
import re

import duckdb
import pytest

from symweave.plans import corpus, oracle, queries, texts

assert corpus and texts
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_each_query_has_its_sql():
    assert set(oracle.ORACLES) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(oracle.ORACLES[name])
    assert sorted(want.columns) == cols
    rows = sorted((tuple(map(str, r)) for r in got.select(*cols).collect()))
    assert rows == sorted(tuple(map(str, r)) for r in want.select(*cols).fetchall())
    assert rows


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["rename_type_edits", "unresolved_symbol"])
def test_references_are_not_shuffled_with_their_paths(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file_path#\d+, name#", plan) and re.search(r"hashpartitioning\(k#", plan)


def test_types_whose_numbers_do_not_tell_their_names(spark, sf, tmp_path):
    """Names that end in digits: texts are compared and not numbers."""
    c = duckdb.connect()
    for t in ("supplier", "lineitem"):
        c.sql(f"copy (select * from '{sf}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    c.sql(f"copy (select * replace (case p_partkey when 5 then 'a21' when 215 then 'a' else p_name end as p_name) from '{sf}/part.parquet') to '{tmp_path}/part.parquet'")
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    for name in ("resolve_fqn_strict", "unresolved_symbol"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        cols = sorted(got.columns)
        want = c.sql(oracle.ORACLES[name]).select(*cols).fetchall()
        assert sorted(tuple(map(str, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in want)
