"""Every registered query over packets against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewire import queries as q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name not in q.ORACLES:
        assert len(cols) > 1
        return
    cur = con.execute(q.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = sorted((tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.fixture(scope="module")
def used_again(tmp_path_factory):
    """Events whose DNS ids come again: four copies, a day and 65,536 events apart."""
    d = tmp_path_factory.mktemp("used_again")
    c = duckdb.connect()
    c.execute(f"copy (select e.* replace (event_id + k * 65536 as event_id, ts + to_days(k::int) as ts) from '{DIR}/events.parquet' e, range(4) r(k)) to '{d}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{d}/events.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["dns_transactions", "dns_problem_domains", "dns_causes"])
def test_ids_used_again(spark, used_again, name):
    d, c = used_again
    df = q.QUERIES[name](spark, d)
    want = sorted(c.execute(f"select {', '.join(df.columns)} from ({q.ORACLES[name]})").fetchall(), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want
