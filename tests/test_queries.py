"""Every registered query beside its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from framerank.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(frame):
    def plain(v):
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_contract(spark, duck):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == len(duck.execute(ORACLES["rank_pipeline"]).df()) > 100


@pytest.mark.parametrize("name", ["funnel_counts", "group_totals", "group_view", "groups_surviving", "keepers", "ungrouped"])
def test_groups_broadcast_nothing_that_grows(spark, monkeypatch, name):
    from framerank.operators import dedupe, rank
    from framerank.plans import queries

    plans, write = [], dedupe.cut

    def cut(df, what="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, what)

    for module in (dedupe, rank, queries):
        monkeypatch.setattr(module, "cut", cut)
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "HashJoin" in line]
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5
    assert all("__range" in line for line in joins), joins  # a count for each task is all that may be broadcast
