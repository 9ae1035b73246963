"""Queries against their SQL on small tables of odd rows."""

from collections import Counter

import duckdb
import pytest

from inkspan.plans import catalog
from tests.test_queries import plain

PAGES = "page_id long, url string, html string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def agree(spark, folder, name, table, rows, schema):
    """The rows of a query on one small table, which its SQL must give too."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert Counter(got) == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    return [dict(zip(cols, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", ["batch_ingest", "extracted_articles", "filtered_ingest", "ingest_stream"])
def test_references_without_a_semicolon(spark, tmp_path, name):
    html = "<html><head><title>x</title></head><body><h1>the ver&amp;&amp</h1><p>a &amp;copy; b &copy c &amp</p></body></html>"
    (row,) = agree(spark, tmp_path, name, "pages", [(7, "https://site1.example/a", html)], PAGES)
    assert (row["title"], row["body"]) == ("the ver&&", "a &copy; b © c &")


@pytest.mark.parametrize("name", ["mapped_llm_results", "recounted_mentions", "verified_entities", "whole_llm_results"])
def test_a_sharp_s_is_no_z(spark, tmp_path, name):
    rows = [(k, f"Enzu und enzu, enßu, Verßü und verzu {k} Stß; Stz_ Schßü schzu Anton", "de", "src1", 70) for k in range(1, 12)]
    out = agree(spark, tmp_path, name, "documents", rows, DOCUMENTS)
    if name == "recounted_mentions":
        assert {r["mentions_count"] for r in out if r["id"] % 5 > 1} == {1, 2, 4}  # title and body are both looked at


def test_names_are_found_in_whole_texts(spark, tmp_path):
    """Names of four words, in the last of many sentences and at the end of a long one."""
    name = "Anabela Ruiz Soto Pazo"
    late = "nota\n" + " ".join(f"uno {k}." for k in range(450)) + f" habla {name} hoy"
    long = "nota\nsale " + "y otra vez " * 100 + name
    out = agree(spark, tmp_path, "dictionary_mentions", "documents", [(1, late, "es", "s", len(late)), (2, long, "es", "s", len(long))], DOCUMENTS)
    assert sorted((r["article_id"], r["idx"], r["word_pos"], r["name"]) for r in out) == [(1, 452, 2, name), (2, 2, 302, name)]
