"""Every registered SQL function beside its column expression."""

import pytest
from pyspark.sql import functions as F

from placegraph import sqlfunctions as S

RING = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 1D), named_struct('x', 3D, 'y', 5D))"
VALUES = {"ARRAY": [RING, "array(named_struct('x', 1D, 'y', 1D), named_struct('x', 2D, 'y', 1D), named_struct('x', 2D, 'y', 2D))"], "DOUBLE": ["0.25D", "-7.5D", "49D", "CAST(NULL AS DOUBLE)"],
          "STRING": ["'B2 4019'", "' SW3-1615 '", "'it''s \\\\d; a, b'", "''", "CAST(NULL AS STRING)", "'13:05'"], "INT": ["0", "77", "CAST(NULL AS INT)"],
          "TIMESTAMP": ["TIMESTAMP '2025-03-04 13:05:00'", "CAST(NULL AS TIMESTAMP)"]}


@pytest.fixture(scope="module")
def known(spark):
    return S.register(spark)


@pytest.mark.parametrize("name", [n for n, _, _ in S.FUNCTIONS])
def test_sql_equals_the_expression(spark, known, name):
    _, told, expression = next(f for f in S.FUNCTIONS if f[0] == name)
    names = S.parameters(told)
    types = [t.split("<")[0].split()[-1] for t in told.replace("STRUCT<x: DOUBLE, y: DOUBLE>", "S").split(", ")]
    assert len(types) == len(names) and set(types) <= set(VALUES)
    rows = []
    for turn in range(6):
        rows.append("SELECT " + ", ".join(f"{VALUES[t][(turn + 2 * i * (t != 'ARRAY')) % len(VALUES[t])]} AS {n}" for i, (n, t) in enumerate(zip(names, types))))
    df = spark.sql(" UNION ALL ".join(rows))
    got = df.select(F.expr(f"{name}({', '.join(names)})").alias("v"), expression(*map(F.col, names)).alias("w")).collect()
    assert len(got) == 6 and all(repr(r.v) == repr(r.w) for r in got), got
