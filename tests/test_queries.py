"""Every registered query of the session engine against its DuckDB SQL, at the smallest size."""

import decimal
import math
import os

import duckdb
import pytest

from threadmill.plans import ingest_queries  # noqa: F401  registers its queries
from threadmill.plans import queries as Q

DIR = os.environ.get("THREADMILL_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(*names).collect())
    if name in Q.ORACLES:
        cur = duck.execute(Q.ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == names
        want = sorted(str([plain(r[cols.index(c)]) for c in names]) for r in cur.fetchall())
        assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_excerpt_of_every_match(spark, tmp_path):
    from threadmill.functions.textsearch import excerpt_of

    rows = [(i, 0, "user", f"line {i} has the word, {'and the other ' * (i % 40)}end" if i % 4 else "none here") for i in range(120)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{DIR}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["excerpt"], r["highlights"]) for r in Q.excerpt_highlight(spark, str(tmp_path)).collect())
    want = sorted((e, len(m)) for e, m in (excerpt_of(t, ["the"]) for _, _, _, t in rows if " the " in t))
    assert len(want) == 90 and got == want
