"""Queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from walkloom.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["O-GS1", "O-GS6", "O-GS12", "O-GS13_validity", "O-GS18", "O-SE11", "O-SE13", "O-SC3", "O-SC9", "O-TK9_edges", "O-TK14", "O-PF1", "O-PF2", "O-BP1", "O-BP3", "O-BP10", "O-BP12", "O-BP16", "O-VO5", "O-AG3", "O-AG4", "O-AG5", "O-AG16", "O-EV1", "O-EV3_best", "O-EV7", "O-EV8_classes", "O-EV17", "O-SP1", "O-SP2"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}" if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "") in ("i", "f") else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_against_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert rows(got) == rows(con.execute(ORACLE_SQL[name]).df())
