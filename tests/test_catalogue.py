"""Every catalogue query against its DuckDB SQL."""

import os

import duckdb
import pytest

from tests.conftest import SF
from tilewright import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(rows):
    return sorted((tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name not in catalogue.SQL:
        assert rows
        return
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_split_stats_query_takes_no_broadcast(spark, sf_dir):
    plan = catalogue.QUERIES["split_stats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
