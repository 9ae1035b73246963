"""Sources, stored tables and streams."""

import random
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkspan.operators import analyze, resolve
from inkspan.sources import markup, pages, store, tables
from inkspan.streaming import jobs

URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


@pytest.mark.parametrize(
    "xml, found",
    [(URLSET.format("<url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url>"), ["http://a/1", "http://a/2"]), (URLSET.format("<url><loc> </loc></url><url><loc>http://a/3</loc></url>"), ["http://a/3"]), ("<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>", []), ("<urlset><url><loc>x", []), ("", [])],
)
def test_sitemaps(spark, xml, found):
    df = spark.createDataFrame([("s", xml)], "source string, xml string")
    assert [r["url"] for r in pages.sitemap_urls(df).orderBy("ord").collect()] == found


def test_decode(spark):
    text = "año ñandú"
    data = [(text.encode(), "text/html"), (text.encode(), "text/html; charset=utf-8"), (text.encode("latin-1"), "text/html; charset=ISO-8859-1"), (text.encode("latin-1"), "text/html"), (text.encode(), "text/html; charset=nonsense")]
    df = spark.createDataFrame([(bytearray(d), t) for d, t in data], "b binary, t string")
    assert [r[0] for r in df.select(pages.decode_page(F.col("b"), F.col("t"))).collect()] == [text] * 5


HTML = '<html><head><title>no</title><meta property="article:section" content="Politica, x"><meta property="article:published_time" content="2026-01-15"></head><body><nav><p>menu</p></nav><h1>Un &amp; dos</h1><p>Primero.</p><script><p>js</p></script><p>Segundo <b>ya</b>.</p></body></html>'


def test_extract(spark):
    df = spark.createDataFrame([("s", "u1", HTML), ("s", "u2", "<h1>only</h1>"), ("s", "u3", None)], "source string, url string, html string")
    out = pages.extract_articles(df).collect()
    assert [(r["url"], r["title"], r["body"], r["section"], r["published_at"]) for r in out] == [("u1", "Un & dos", "Primero.\nSegundo ya .", "Politica", datetime(2026, 1, 15, 4))]


def test_decode_by_declared_charset(spark):
    cases = [("€ ñ Š", "ISO-8859-15"), ("Łódź ž", "windows-1250"), ("Привет", "koi8-r"), ("Привет", "CP1251"), ("“ñ” €", "windows-1252"), ("żółw", "iso-8859-2"), ("ñ", "latin1"), ("ñé", "macintosh"), ("año", "utf-16le")]
    df = spark.createDataFrame([(bytearray(t.encode(pages._PYTHON.get(c.lower(), c))), f"text/html; charset={c}") for t, c in cases] + [(bytearray(b"a\xffb"), "text/html; charset=utf-8"), (bytearray(b"a\xffb"), "text/html; charset=big7")], "b binary, t string")
    assert [r[0] for r in df.select(pages.decode_page(F.col("b"), F.col("t"))).collect()] == [t for t, _ in cases] + ["a\ufffdb", "aÿb"]


@pytest.mark.parametrize(
    "html, title, body",
    [
        ("<h1>A</h1><p>uno<p>dos</p>tres", "A", "uno\ndos"), ("<h1>A</h1><p>uno <b>dos<div>no</div><p>tres", "A", "uno dos\ntres"), ("<title>T</title><p title='a>b' x=\"c>d\">uno<br>dos</p>", "T", "uno dos"),
        ("<h1>A</h1><div><nav><p>no</div><p>si</p>", "A", "si"), ("<h1>A</h1><p>si</p><script><p>no</p>", "A", "si"), ("<h1>A</h1><p>si<!-- no --> mas</p><!-- <p>no</p>", "A", "si mas"), ("<H1>A</H1><P>1 < 2 &amp; 3 > 2 <i", "A", "1 < 2 & 3 > 2 <i"),
        ("<h1>A</h1><p>uno</nav></form></p></p><pre>no</pre><p/>", "A", "uno"), ("<h1> </h1><title>T</title><p>&lt;b&gt;</p>", "T", "<b>"), ("<h1>A</h1><noscript><p>no</noscript><p>it's \"5</p>", "A", "it's \"5"), ("<h1>A</h1><p a=\"b>uno</p><p>dos</p>", "A", "uno\ndos"), ("<h1>İ</h1><script>x</SCRIPT ><p>si</p>", "İ", "si"),
    ],
)
def test_markup(html, title, body):
    assert markup.page_fields(html)[:2] == (title, body)


@pytest.mark.parametrize("piece", ["<p>a", "<script>", "<style>x", "<!--", "<nav>", "<b>x</p>", '<a b="', "<a b='\" ", "<", "<a ", '<a "\'>\'"', "</nav><div>", "<meta x=' ", "&amp", "<title>", "<form><p>"])
def test_markup_takes_time_by_length(piece):
    """Also where everything is left open, as in pages of 5 MiB."""
    took = []
    for n in (250_000, 1_000_000):
        page, began = piece * (n // len(piece)), time.process_time()
        markup.page_fields(page)
        took.append(time.process_time() - began)
    assert took[1] < max(12 * took[0], 1.5)


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "url string, v int")
    path = str(tmp_path / "store")
    assert tables.append_new(df, path, "url").count() == 2
    assert tables.append_new(df, path, "url").count() == 0
    assert spark.read.parquet(path).count() == 2


def test_golden(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "1", "title": "t"}\n{"id": "2", "entities_exhaustive": false}\n')
    assert {r["id"]: r["entities_exhaustive"] for r in tables.read_golden(spark, str(tmp_path)).collect()} == {"1": True, "2": False}
    (tmp_path / "g.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        tables.read_golden(spark, str(tmp_path)).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"http://a/{k % 3}?utm_source={k}", HTML) for k in range(6)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "source string, url string, html string").repartition(3).write.parquet(src)
    stream = jobs.page_stream(spark, src, "source string, url string, html string")
    for _ in range(2):
        jobs.ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    batch = jobs.ingest_batch(spark.createDataFrame(rows, "source string, url string, html string"))
    store = jobs.ingest_store(spark, str(tmp_path / "store"))
    assert sorted(r["url"] for r in store.read("articles").collect()) == sorted(r["url"] for r in batch.collect())
    assert [(r["discovered"], r["saved"]) for r in store.read("runs").collect()] == [(6, 3)]


def test_reuse_window_stream_equals_batch(spark, tmp_path):
    minutes = [0, 30, 61, 90, 122, 500]
    rows = [("u", k, datetime(2026, 1, 1, m // 60, m % 60)) for k, m in enumerate(minutes)] + [("v", 9, datetime(2026, 1, 1, 0, 5))]
    df = spark.createDataFrame(rows, "url string, id long, at timestamp")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = jobs.dedupe_requests_stream(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("reuse").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sorted((r["url"], r["id"]) for r in jobs.dedupe_requests_batch(df).collect())
    assert batch == [("u", 0), ("u", 2), ("u", 4), ("u", 5), ("v", 9)]
    assert sorted((r["url"], r["id"]) for r in spark.sql("SELECT * FROM reuse").collect()) == batch


def test_reuse_of_one_busy_url(spark):
    """No row holds all requests of a URL, and sessions over several Arrow batches equal a fold."""
    rng = random.Random(3)
    at = 1_700_000_000
    rows = []
    for k in range(3000):
        at += rng.choice([0, 60, 600, 3599, 3600, 7200]) if rng.random() < 0.3 else rng.randrange(200)
        rows.append(("u" if k % 3 else None if k % 2 else f"v{k % 7}", k, at))
    want, last = [], {}
    for u, k, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if u not in last or t - last[u] >= 3600:
            last[u] = t
            want.append((u, k))
    df = spark.createDataFrame(rows, "url string, id long, s long").select("url", "id", F.timestamp_seconds("s").alias("at"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = jobs.dedupe_requests_batch(df)
        got = [(r["url"], r["id"]) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert Counter(got) == Counter(want) and len(want) > 50
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_corpus_stream(spark, tmp_path):
    page = "<h1>{}</h1><p>{}</p>"
    rows = [("s", "http://a/1?utm_source=x", page.format("Uno", "ACME y Luis Abinader")), ("s", "http://a/1", page.format("Uno", "ACME y Luis Abinader")), ("s", "http://a/2", page.format("Dos", "Abinader habla")), ("s", "http://a/3", page.format("Tres", "bad"))]
    later = [("s", "http://a/2/", page.format("Dos", "Abinader habla")), ("s", "http://a/4", page.format("Cuatro", "ACME y Abinader"))]
    schema, src, where = "source string, url string, html string", str(tmp_path / "in"), str(tmp_path / "store")

    def names(title, body):
        if body == "bad":
            raise ValueError(body)
        found = [n for n in ("ACME", "Luis Abinader", "Abinader") if n in body and not (n == "Abinader" and "Luis" in body)]
        return {"dominant_actor": found[-1], "topic_keywords": ["x", "y"], "content_flags": [], "entities": [{"name": n, "type": "ORG" if n == "ACME" else "PERSON", "mentions_count": 1, "extraction_confidence": 1.0} for n in found]}

    catalogue = []

    def aliases():
        return spark.createDataFrame(catalogue, "id long, alias string, alias_key string, canonical_name string, type string, is_active boolean")

    run = analyze.analysis(names)
    for batch in (rows, later):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.corpus_stream(jobs.page_stream(spark, src, schema), lambda a: analyze.analyze_articles(a, run, "n", "m", "1"), aliases, where, str(tmp_path / "state")).awaitTermination()
        catalogue.append((1, "ACME", "acme", "Acme Corporation", "ORG", True))

    def read():
        a, m, c = (jobs.corpus_store(spark, where).read(n) for n in ("articles", "entities", "canonical_entities"))
        named = m.alias("m").join(c.alias("c"), F.col("m.canonical_entity_id") == F.col("c.id")).join(a.alias("a"), F.col("a.id") == F.col("m.article_id"))
        assert m.count() == named.count() and c.count() == c.select("id").distinct().count()
        return sorted((r["url"], r["name"], r["name"] == r["known"], r["actor"]) for r in named.select("a.url", "m.name", F.col("c.name").alias("known"), (F.col("a.dominant_actor_id") == F.col("c.id")).alias("actor")).collect())

    want = [("http://a/1", "ACME", True, False), ("http://a/1", "Luis Abinader", True, True), ("http://a/2", "Abinader", True, True), ("http://a/4", "Acme Corporation", True, False), ("http://a/4", "Luis Abinader", True, True)]
    assert read() == want
    corpus = jobs.corpus_store(spark, where)
    assert [tuple(r) for r in corpus.read("runs").orderBy("batch").select("discovered", "articles", "failed", "saved").collect()] == [(4, 3, 1, 2), (2, 1, 0, 1)]  # what is stored is not analysed again
    assert corpus.read("articles").columns == tables.ARTICLES.replace("\n", " ").replace(" string", "").replace(" long", "").replace(" timestamp", "").replace(" double", "").replace(" boolean", "").replace(" int", "").split(", ")
    again = analyze.analyze_articles(jobs.ingest_batch(spark.createDataFrame(later, schema)), run, "n", "m", "1")
    stream = jobs.stream_id(spark, str(tmp_path / "state"))
    assert not jobs.save_analyses(again, aliases(), corpus, stream, 1)  # a replay
    assert read() == want and corpus.read("runs").count() == 2
    # Another stream that brings the same pages adds none; nor does a new checkpoint take earlier ones away.
    jobs.corpus_stream(jobs.page_stream(spark, src, schema), lambda a: analyze.analyze_articles(a, run, "n", "m", "1"), aliases, where, str(tmp_path / "another")).awaitTermination()
    assert read() == want


def _one(spark, url, names):
    """An analysed article."""
    entities = [{"name": n, "type": "PERSON", "mentions_count": 1, "extraction_confidence": 1.0} for n in names]
    page = spark.createDataFrame([("s", url, url, "x", None, None, None)], "source string, url string, title string, body string, section string, authors string, published_at timestamp")
    run = analyze.analysis(lambda title, body: {"topic_keywords": [], "content_flags": [], "entities": entities})
    return analyze.analyze_articles(page, run, "n", "m", "1")


def _nobody(spark):
    return spark.createDataFrame([], tables.ALIASES)


def test_a_crash_between_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    corpus = jobs.corpus_store(spark, str(tmp_path / "store"))
    assert jobs.save_analyses(_one(spark, "http://a/1", ["Ana Ruiz"]), _nobody(spark), corpus, "one", 0)
    before = {t: sorted(map(tuple, corpus.read(t).collect())) for t in corpus.schemas}
    real, written = store.Store._write, []

    def broken(self, df, name, by=None):
        if name == "canonical_entities":
            raise OSError("lost")
        written.append(real(self, df, name, by))
        return written[-1]

    monkeypatch.setattr(store.Store, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        jobs.save_analyses(_one(spark, "http://a/2", ["Luis Paz"]), _nobody(spark), corpus, "one", 1)
    monkeypatch.setattr(store.Store, "_write", real)
    assert written and before == {t: sorted(map(tuple, corpus.read(t).collect())) for t in corpus.schemas}
    assert jobs.save_analyses(_one(spark, "http://a/2", ["Luis Paz"]), _nobody(spark), corpus, "one", 1)
    assert sorted(r["url"] for r in corpus.read("articles").collect()) == ["http://a/1", "http://a/2"]
    assert sorted((r["id"], r["name"]) for r in corpus.read("canonical_entities").collect()) == [(1, "Ana Ruiz"), (2, "Luis Paz")]
    kept = sorted(r["id"] for r in corpus.read("entities").collect())
    assert corpus.vacuum(hours=0) == len(written) and kept == sorted(r["id"] for r in corpus.read("entities").collect()) == [1, 2]


def test_two_writers_at_once(spark, tmp_path):
    """The second to commit works again on what the first has left: no identifier twice, no row lost."""
    path = str(tmp_path / "store")
    one, two = jobs.corpus_store(spark, path), jobs.corpus_store(spark, path)
    real, first = two._indexed, []

    def late(now, new):
        if not first:
            first.append(jobs.save_analyses(_one(spark, "http://a/1", ["Ana Ruiz"]), _nobody(spark), one, "one", 0))
        return real(now, new)

    two._indexed = late
    assert jobs.save_analyses(_one(spark, "http://a/2", ["Ana Ruiz", "Luis Paz"]), _nobody(spark), two, "two", 0) and first == [True]
    assert sorted((r["id"], r["url"]) for r in two.read("articles").collect()) == [(1, "http://a/1"), (2, "http://a/2")]
    assert sorted((r["id"], r["name"]) for r in two.read("canonical_entities").collect()) == [(1, "Ana Ruiz"), (2, "Luis Paz")]
    assert two.snapshot().version == 1 and two.snapshot().streams == {"one": 0, "two": 0}


def test_indexes_follow_the_store(spark, tmp_path, monkeypatch):
    """Over merges of runs: surnames as `person_map` makes them anew, and every address and name found."""
    monkeypatch.setattr(store, "KEYS_A_PART", 2)
    monkeypatch.setattr(store, "FAN", 3)
    corpus = jobs.corpus_store(spark, str(tmp_path / "store"))
    names = [["Ana Ruiz", "Luis Paz"], ["Eva Ruiz"], ["Paz"], ["Juan Sol", "Ana Ruiz"], ["Sol", "Leo Mar"], ["Mar", "Ruiz"], ["Lia Cruz"], ["Cruz"]]
    for k, found in enumerate(names):
        jobs.save_analyses(_one(spark, f"http://a/{k}", found), _nobody(spark), corpus, "s", k)
    now = corpus.snapshot()
    assert all(len(held) < 6 for held in now.runs.values()) and max(r["level"] for r in now.runs["urls"]) == 1
    whole = resolve.person_map(corpus.read("entities"), corpus.read("canonical_entities"), _nobody(spark))
    asked = spark.createDataFrame([(n,) for n in ("Ruiz", "Paz", "Sol", "Mar", "Cruz", "Nadie")], "name string")
    assert sorted(map(tuple, jobs.known_surnames(corpus, asked, _nobody(spark), now).collect())) == sorted(map(tuple, whole.collect())) == [("cruz", "Lia Cruz"), ("mar", "Leo Mar"), ("paz", "Luis Paz"), ("sol", "Juan Sol")]
    keys = spark.createDataFrame([(f"http://a/{k}",) for k in range(-2, 20)], "key string")
    assert sorted(r["key"] for r in corpus.lookup("urls", keys, now).collect()) == [f"http://a/{k}" for k in range(8)]
    assert sorted(r["name"] for r in corpus.read("entities", now).filter("article_id = 6").collect()) == ["Leo Mar", "Ruiz"]
    jobs.rebuild_indexes(corpus)
    assert sorted(map(tuple, jobs.known_surnames(corpus, asked, _nobody(spark), corpus.snapshot()).collect())) == sorted(map(tuple, whole.collect()))
    corpus.compact("articles")
    assert len(corpus.snapshot().tables["articles"]) == 1 and corpus.read("articles").count() == 8


def test_lookup_reads_the_same_however_large_the_store(spark, tmp_path, monkeypatch):
    """Rows that the scan of a look-up of one key reads, in indexes of two sizes."""
    monkeypatch.setattr(store, "KEYS_A_PART", 100)
    read = []
    for n in (1_000, 16_000):
        corpus = jobs.ingest_store(spark, str(tmp_path / str(n)))
        rows = spark.range(n).select(F.concat(F.lit("u"), "id").alias("key"), "id")
        corpus.transact("s", 0, lambda now, rows=rows, n=n: ({}, {"urls": (rows, n)}, {}))
        now = corpus.snapshot()
        (run,) = now.runs["urls"]
        key = spark.createDataFrame([("u7",)], "key string")
        part = key.select(store._part(F.col("key"), run["bits"])).first()[0]
        read.append(corpus._read_run("urls", run, [part]).count())
        assert corpus.lookup("urls", key, now).collect() == [("u7", 7)]
    assert all(20 < r < 400 for r in read)


def test_the_log_restarts_from_a_whole_state(spark, tmp_path):
    corpus = jobs.ingest_store(spark, str(tmp_path / "store"))
    for k in range(18):
        corpus.commit({"version": k, "stream": "s", "batch": k, "adds": [["articles", f"articles/{k}"]], "drops": [f"articles/{k - 1}"] if k % 2 else []})
    assert (tmp_path / "store" / "_log" / "whole").exists()
    now = corpus.snapshot()
    assert now.version == 17 and now.streams == {"s": 17} and now.tables["articles"] == [f"articles/{k}" for k in range(1, 18, 2)]
    with pytest.raises(store.Conflict):
        corpus.commit({"version": 17})


def test_reading_a_database(spark, tmp_path):
    """Parts by spans of the id, with filters and columns pushed to the database; rows without an id, one row, and an empty table too."""
    url = {"url": f"jdbc:derby:{tmp_path}/press;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k * 7 - 50, f"n{k % 4}", "PERSON" if k % 3 else "ORG") for k in range(200)] + [(None, "none", "ORG")]
    names = spark.createDataFrame(rows, "id long, name string, type string")
    names.write.format("jdbc").options(**url, dbtable="canonical_entities", createTableColumnTypes="name VARCHAR(20), type VARCHAR(10)").save()
    back = tables.read_table(spark, "canonical_entities", jdbc=url)
    assert Counter(map(tuple, back.collect())) == Counter(rows) and back.rdd.getNumPartitions() == 8 and back.columns == ["id", "name", "type"]
    assert sum(n > 10 for n in back.rdd.glom().map(len).collect()) == 8
    some = back.filter("type = 'ORG' AND id > 700").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString().lower()
    assert "pushedfilters: [*isnotnull(type), *isnotnull(id), *equalto(type,org), *greaterthan(id,700)]" in plan.replace('"', "") and "readschema: struct<name:string>" in plan
    assert some.count() == sum(r[0] is not None and r[0] > 700 and r[2] == "ORG" for r in rows)
    for table, few in (("one", rows[:1]), ("empty", [])):
        spark.createDataFrame(few, "id long, name string, type string").write.format("jdbc").options(**url, dbtable=table).save()
        assert [tuple(r) for r in tables.read_table(spark, table, jdbc=url).collect()] == few


def test_pages_are_read_in_small_slices():
    """A worker holds the fields of at most 100 pages at a time, and loses none."""
    import pyarrow as pa

    from inkspan.sources import pages

    whole = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array([f"<title>t{k}</title><p>b{k}</p>" for k in range(250)])], names=["page_id", "html"])
    out = list(pages._extract("html")(iter([whole, whole.slice(0, 0)])))
    assert [b.num_rows for b in out] == [100, 100, 50, 0]
    assert [r for b in out for r in b.column("body").to_pylist()] == [f"b{k}" for k in range(250)]
