"""Every query against its SQL on the smallest tables."""

import math

import pytest

from dupelens.plans import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()
#: Models are fitted in these. test_operators has topics and the search on small data; rf_predict is below.
SLOW = {"lda_topics", "rf_predict", "rf_tuning"}


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == b or (isinstance(a, float) and (math.isclose(a, b, rel_tol=1e-9) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    if name not in registry.ORACLE_SQL:
        assert mine
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    theirs = con.execute(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert len(mine) == len(theirs)
    assert all(same(x, y) for a, b in zip(mine, sorted(theirs, key=key), strict=True) for x, y in zip(a, b, strict=True))


def test_predictions_tell_duplicates(spark, small):
    found = registry.QUERIES["rf_predict"](spark, small).toPandas()
    tested = registry.QUERIES["test_candidates"](spark, small).select("dup_id", "candidate_id", "is_dup").toPandas()
    assert len(found) == len(tested) and len(found.merge(tested)) == len(tested)
    assert found.pred.between(0, 1).all() and found.pred[found.is_dup].mean() > 0.5 > found.pred[~found.is_dup].mean()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
