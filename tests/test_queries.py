"""Every query with SQL returns the same rows as DuckDB on the smallest tables; the rest return rows."""

import os

import duckdb
import pytest

from kinlink.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "" if str(v) in ("None", "<NA>", "nan") else f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ours = rows(QUERIES[name](spark, SF).toPandas())
    if name not in SQL:
        assert ours[1]
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = rows(con.sql(SQL[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
