"""Every registered query beside its SQL on the smallest tables."""

import pytest

from oracle_check import compare, connect
from placegraph import catalog

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare(catalog.queries()[name](spark, SF), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["resolved_ends", "route_costs"])
def test_building_codes_of_four_digits_match_sql(spark, tmp_path, name):
    import duckdb

    there, c = str(tmp_path), duckdb.connect()
    for t, moved in {"customer": "c_custkey + 60000 AS c_custkey", "orders": "o_custkey + 60000 AS o_custkey", "supplier": "s_suppkey + 4000 AS s_suppkey"}.items():
        c.execute(f"COPY (SELECT * REPLACE ({moved}) FROM '/root/testdata/sf0.01/{t}.parquet') TO '{there}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{there}/{t}.parquet'")
    assert compare(catalog.queries()[name](spark, there), c, ORACLE[name]) == []
