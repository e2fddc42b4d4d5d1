"""Every query over the driver's tables against its SQL, on the smallest scale."""

import glob
import os

import duckdb
import pytest

from rtlake import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(plain(tuple(r)) for r in got.select(*columns).collect())
    if name in plans.ORACLES:
        assert rows == sorted(map(plain, con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({plans.ORACLES[name]})").fetchall()))


def test_fuzzy_matches_of_many_patterns(spark, tmp_path):
    """Other patterns than the one that the given nations have, names in many copies and null parts of names, against the SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE part AS SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name || '_' || p_partkey % 40 END AS p_name, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Natural' ELSE p_brand END AS p_brand FROM '{FOLDER}/part.parquet', range(3)")
    con.sql("CREATE TABLE nation AS SELECT * FROM (VALUES ('NATION'), ('nat'), ('Gear'), ('RNG'), ('b#1'), ('_2'), ('e'), ('xyz'), ('ll '), (NULL)) t(n_name)")
    for table in ("part", "nation"):
        con.sql(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    rows = sorted(plain(tuple(r)) for r in plans.QUERIES["fuzzy_matches"](spark, str(tmp_path)).select("name", "pattern", "score").collect())
    assert rows == sorted(map(plain, con.sql(f"SELECT name, pattern, score FROM ({plans.ORACLES['fuzzy_matches']})").fetchall())) and len({r[1] for r in rows}) > 5
