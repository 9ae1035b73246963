"""Every query of the library against its SQL, on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest

from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) if name in catalog.ORACLES else None
    if got is None:
        assert df.count() > 0
        return
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want and got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_dimension_ids_without_one_sorted_task(spark, tmp_path):
    from inkspan.plans import views

    text = "Ana Ruiz y Ana Ruis con Anabel, Ñoño Paz, Éric Sol, Casa Rosada y ONU en Lima; Limo, Li Po"
    spark.createDataFrame([(k, text[k:], "es", "s", 1) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = views.canonical(spark, str(tmp_path))
    rows = sorted((r["type"].encode(), r["name"].encode(), r["id"]) for r in out.collect())
    assert len(rows) > 5 and [r[2] for r in rows] == list(range(1, len(rows) + 1))
    assert not re.search(r"windowspecdefinition\(type#\d+ ASC NULLS FIRST, name#", out._jdf.queryExecution().optimizedPlan().toString())
