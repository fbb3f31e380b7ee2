import duckdb
import pytest

import __spark_entry__
from mnemora.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(catalog.ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, found.fetchall()))


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not __spark_entry__.entry(spark).isEmpty()
