"""Queries over job tables, run summaries, patches, ingest and streams."""

from __future__ import annotations

import re
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.functions.urls import content_type_ok
from inkspan.operators import analyze, evaluate, maintain, resolve, verify
from inkspan.plans import views
from inkspan.plans.entity_queries import _CANONICAL, _PERSONS, matched_sql, surnames
from inkspan.plans.press_queries import canonical_url_sql
from inkspan.plans.views import key_sql, table, with_views, words_sql
from inkspan.sources.tables import append_new, once, read_golden, scratch_folder
from inkspan.streaming import jobs as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _now(spark: SparkSession, sf_dir: str) -> Column:
    """The time of the last event, as a literal."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])


_NOW = "(SELECT max(created_at) FROM jobs)"


@query(with_views(["jobs"], f"SELECT url, arg_max(id, (created_at, id)) AS id FROM jobs WHERE status = 'done' AND result_json IS NOT NULL AND created_at >= {_NOW} - INTERVAL 6000 MINUTE GROUP BY 1"))
def reusable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest result of each URL inside the window."""
    return maintain.reusable_jobs(views.jobs(spark, sf_dir), _now(spark, sf_dir), 6000).select("url", "id")


@query(with_views(["jobs"], f"SELECT url, arg_max(id, (created_at, id)) AS id FROM jobs WHERE status IN ('pending', 'running') AND created_at >= {_NOW} - INTERVAL 3000 MINUTE GROUP BY 1"))
def inflight_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.inflight_jobs(views.jobs(spark, sf_dir), _now(spark, sf_dir), 3000).select("url", "id")


_SWEPT = f"""s AS (SELECT id, old, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN 'El análisis se interrumpió. Vuelve a intentarlo.' ELSE error END AS error,
  CASE WHEN NOT old THEN stage END AS stage, created_at <= {_NOW} - INTERVAL 240 HOUR AS late
FROM (SELECT *, status IN ('pending', 'running') AND created_at <= {_NOW} - INTERVAL 3000 MINUTE AS old FROM jobs))"""


@query(with_views(["jobs"], f"{_SWEPT} SELECT id, status, error, stage FROM s WHERE NOT (status IN ('done', 'failed') AND late)"))
def swept_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after stale ones failed and old ones left."""
    return maintain.sweep_jobs(views.jobs(spark, sf_dir), _now(spark, sf_dir), 3000, 240).select("id", "status", "error", "stage")


@query(with_views(["jobs"], f"{_SWEPT} SELECT count(*) FILTER (WHERE old) AS interrupted, count(*) FILTER (WHERE status IN ('done', 'failed') AND late) AS purged FROM s"))
def sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs the sweep fails and deletes."""
    return maintain.sweep_counts(views.jobs(spark, sf_dir), _now(spark, sf_dir), 3000, 240)


@query(with_views(["jobs"], f"""c AS (SELECT DISTINCT url FROM jobs), saved AS (SELECT DISTINCT 'u' || user_id AS url FROM events WHERE user_id % 5 = 0),
r AS (SELECT DISTINCT url FROM jobs WHERE status = 'done' AND result_json IS NOT NULL AND created_at >= {_NOW} - INTERVAL 60 MINUTE),
i AS (SELECT DISTINCT url FROM jobs WHERE status IN ('pending', 'running') AND created_at >= {_NOW} - INTERVAL 15 MINUTE)
SELECT url, CASE WHEN url IN (FROM saved) THEN 'saved' WHEN url IN (FROM r) THEN 'reuse' WHEN url IN (FROM i) THEN 'join' ELSE 'enqueue' END AS action FROM c"""))
def request_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each requested URL."""
    j = views.jobs(spark, sf_dir)
    stored = table(spark, sf_dir, "events").filter("user_id % 5 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url")).distinct()
    return maintain.triage(j, stored, j, _now(spark, sf_dir))


@query(with_views(["articles"], f"""stored AS (SELECT url AS s FROM articles WHERE id % 3 = 0 UNION SELECT {canonical_url_sql('url')} FROM articles WHERE id % 3 = 0)
SELECT id FROM articles WHERE url NOT IN (FROM stored) AND {canonical_url_sql('url')} NOT IN (FROM stored)"""))
def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are not stored under any spelling."""
    a = views.articles(spark, sf_dir)
    return maintain.new_urls(a.select("id", "url"), a.filter("id % 3 = 0")).select("id")


@query(with_views(["stage_events"], "SELECT source, stage, arg_max(id, (\"at\", id)) AS id, arg_max(value, (\"at\", id)) AS value FROM stage_events GROUP BY 1, 2"))
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.latest_progress(views.stage_events(spark, sf_dir))


@query(with_views(["stage_events"], "SELECT source, stage, 'v' || arg_max(id, (\"at\", id)) AS status FROM stage_events GROUP BY 1, 2"))
def parsed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress stored as one JSON map for each source, read back as rows."""
    p = maintain.latest_progress(views.stage_events(spark, sf_dir))
    entry = F.struct(F.concat_ws(":", "source", "stage").alias("k"), F.struct(F.concat(F.lit("v"), F.col("id").cast("string")).alias("status"), F.lit("d").alias("detail"), F.lit("t").alias("updated_at")).alias("v"))
    js = p.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("progress_json")).select("progress_json")
    return maintain.parse_progress(js).select("source", "stage", "status")


_COUNTED = "SELECT source, count(*) FILTER (WHERE id % 397 = 3) AS cancelled, count(*) FILTER (WHERE id % 997 = 5) AS broken, count(*) FILTER (WHERE id % 3 = 0) AS discovered, count(*) FILTER (WHERE id % 3 = 1) AS saved, count(*) FILTER (WHERE id % 3 = 2) AS failed, grouping(source) = 1 AS is_total FROM stage_events GROUP BY ROLLUP (source)"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    return maintain.run_totals(views.stage_events(spark, sf_dir), k == 0, k == 1, k == 2, F.col("id") % 397 == 3, F.col("id") % 997 == 5)


@query(with_views(["stage_events"], f"t AS ({_COUNTED}) SELECT source, is_total, discovered, saved, failed, CASE WHEN broken > 0 AND NOT is_total THEN 'failed' WHEN cancelled > 0 THEN 'cancelled' ELSE 'success' END AS status FROM t"))
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


@query(with_views(["stage_events"], f"""t AS ({_COUNTED}) SELECT sum(discovered)::BIGINT AS articles_discovered, sum(saved)::BIGINT AS articles_saved, sum(failed)::BIGINT AS articles_failed,
'{{' || string_agg('"' || source || '":{{"discovered":' || discovered || ',"saved":' || saved || ',"failed":' || failed || '}}', ',' ORDER BY source) || '}}' AS stats_by_source FROM t WHERE NOT is_total"""))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row with counts by source in JSON."""
    return maintain.crawl_run_summary(_totals(spark, sf_dir))


@query(with_views(["stage_events"], "SELECT source, count(*) FILTER (WHERE stage = 'click') AS click, count(*) FILTER (WHERE stage = 'view') AS view, count(*) FILTER (WHERE stage = 'purchase') AS purchase FROM stage_events GROUP BY 1"))
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.stage_counts(views.stage_events(spark, sf_dir), ["click", "view", "purchase"])


_LE = ", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS le_{str(b).replace('.', '_')}" for b in maintain.BUCKETS)


@query(with_views(["jobs"], f"SELECT status, {_LE}, count(seconds) AS le_inf, round(sum(seconds), 4) AS total_seconds FROM jobs GROUP BY 1"))
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.duration_histogram(views.jobs(spark, sf_dir))


_ERRORS = ["output truncated", "Servicio SATURADO", "read timed out", "boom", "límite diario alcanzado", "Rate exceeded", "HTTP 429", "Timeout"]


@query(f"""WITH e AS (SELECT {_ERRORS}[(event_id % 8 + 1)::INT] || ' in ' || event_type AS error FROM events WHERE event_id % 9 > 0),
r AS (SELECT CASE WHEN regexp_matches(error, '(?i)truncat') THEN 'truncated' WHEN regexp_matches(error, '(?i)saturado|límite diario|rate') THEN 'rate_limit' WHEN regexp_matches(error, '(?i)timeout|timed out') THEN 'timeout' ELSE 'other' END AS reason FROM e)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def fallback_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of events; every ninth has none."""
    text = F.concat(F.element_at(F.array(*[F.lit(t) for t in _ERRORS]), (F.col("event_id") % 8 + 1).cast("int")), F.lit(" in "), "event_type")
    return verify.fallback_reasons(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 > 0, text).alias("error")))


@query(with_views(["jobs"], "SELECT id, status FROM jobs ORDER BY created_at DESC, id DESC LIMIT 20"))
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.recent_runs(views.jobs(spark, sf_dir), 20, "created_at").select("id", "status")


@query(with_views(["jobs"], "SELECT j.id, r.status AS run_status FROM jobs j LEFT JOIN (SELECT id, status FROM jobs WHERE id % 2 = 0) r ON r.id = j.id"))
def scrape_jobs_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = views.jobs(spark, sf_dir).withColumn("correlation_id", F.col("id"))
    return maintain.scrape_jobs_with_runs(j.select("id", "correlation_id"), j.filter("id % 2 = 0").select("correlation_id", "status")).select("id", "run_status")


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 6 <> 0")
def parsed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result texts of jobs as typed rows."""
    j = maintain.parse_result(views.jobs(spark, sf_dir).filter(F.col("result_json").isNotNull()), "struct<k:string>")
    return j.select("id", F.col("result.k").alias("k"))


def _in_turn(rest: str) -> str:
    """SQL over base (id, key) and patches (id, key), one a row: turn has the patches with ok, each judged by what those before it left."""
    return f"""held AS (SELECT p.id, list(b.id) AS h FROM patches p JOIN base b ON b.key = p.key GROUP BY p.id),
q AS (SELECT p.id, p.key, coalesce(h, []) AS h, row_number() OVER (ORDER BY p.id) AS i FROM patches p LEFT JOIN held USING (id)),
turn AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, []::STRUCT(id BIGINT, key VARCHAR)[] AS moved, true AS ok
  UNION ALL SELECT i, id, CASE WHEN clash THEN moved ELSE list_append(moved, {{'id': id, 'key': key}}) END, NOT clash FROM (SELECT q.i, q.id, q.key, moved,
    len(list_filter(h, lambda x: x <> q.id AND NOT list_contains(list_transform(moved, lambda m: m.id), x))) + len(list_filter(moved, lambda m: m.key = q.key)) > 0 AS clash FROM turn JOIN q ON q.i = turn.i + 1)),
{rest}"""


def _recursive(names: list[str], rest: str) -> str:
    return with_views(names, rest).replace("WITH", "WITH RECURSIVE", 1)


_PATCHED = _in_turn("told AS (SELECT id, ok FROM turn WHERE i > 0)")
_PATCHED = f"""base AS (SELECT id, url AS key FROM articles), patches AS (SELECT a.id, CASE a.id // 10 % 4 WHEN 0 THEN 'https://www.example/new/' || (a.id // 65) WHEN 1 THEN coalesce(e.url, a.url) WHEN 2 THEN coalesce(l.url, a.url) ELSE a.url END AS key
  FROM articles a LEFT JOIN articles e ON e.id = a.id - 10 LEFT JOIN articles l ON l.id = a.id + 10 WHERE a.id % 10 = 3), {_PATCHED}"""


def _patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every tenth article gets an address: a new one that several want, the one that an earlier patch may have left, that of a later row, or its own."""
    a, i = views.articles(spark, sf_dir).select("id", "url", "source", "framing"), F.col("id")
    earlier, later = (a.select((i + k).alias("id"), F.col("url").alias(n)) for k, n in ((10, "e"), (-10, "l")))
    kind = F.floor(i / 10) % 4
    url = F.when(kind == 0, F.concat(F.lit("https://www.example/new/"), F.floor(i / 65).cast("string"))).when(kind == 1, F.coalesce("e", "url")).when(kind == 2, F.coalesce("l", "url")).otherwise(F.col("url"))
    p = a.filter("id % 10 = 3").join(earlier, "id", "left").join(later, "id", "left")
    return maintain.apply_patches(a, p.select("id", url.alias("url"), "framing", F.lit(True).alias("set_url"), F.lit(False).alias("set_framing")), ["url", "framing"], ["url"])


@query(_recursive(["articles"], f"{_PATCHED} SELECT a.id, CASE WHEN ok THEN p.key ELSE a.url END AS url FROM articles a LEFT JOIN told t ON t.id = a.id LEFT JOIN patches p ON p.id = a.id"))
def patched_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with patches applied one after the other; clashing ones are left out."""
    return _patched(spark, sf_dir)[0].select("id", "url")


@query(_recursive(["articles"], f"{_PATCHED} SELECT id, 'clash' AS reason FROM told WHERE NOT ok"))
def rejected_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patched(spark, sf_dir)[1]


@query(with_views(["articles", "mentions"], "SELECT id FROM mentions WHERE article_id % 4 <> 0"))
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions left after articles were deleted."""
    a = views.articles(spark, sf_dir)
    return maintain.delete_articles(a, views.mentions(spark, sf_dir), a.filter("id % 4 = 0"))[1].select("id")


@query(with_views(["mentions", "canonical"], "SELECT m.id, CASE WHEN c.id % 3 <> 0 THEN c.id END AS canonical_entity_id FROM mentions m LEFT JOIN canonical c ON c.name = m.name AND c.type = m.type"))
def unlinked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links set to NULL after dimension rows were deleted."""
    from inkspan.operators.resolve import link_mentions

    c = views.canonical(spark, sf_dir)
    return maintain.delete_canonical(c, link_mentions(views.mentions(spark, sf_dir), c), c.filter("id % 3 = 0"))[1].select("id", "canonical_entity_id")


@query("SELECT page_id, page_id % 4 IN (0, 1) AS ok FROM pages")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("text/html; charset=utf-8", " Application/RSS+xml", "image/png", None)])
    return table(spark, sf_dir, "pages").select("page_id", content_type_ok(F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int"))).alias("ok"))


@query("SELECT doc_id, lang || ', ' || source AS joined, CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source END AS some, lang AS first_item FROM documents")
def joined_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as one text and back; empty ones are NULL."""
    d = table(spark, sf_dir, "documents")
    pair = F.array("lang", "source")
    some = F.when(F.col("doc_id") % 2 == 0, pair).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", text.join_list(pair).alias("joined"), text.join_list(some).alias("some"), text.split_list(text.join_list(pair))[0].alias("first_item"))


@query("SELECT event_id, CASE WHEN upper(substring(trim(event_type), 1, 3)) IN ('POS', 'NEG', 'NEU') THEN upper(substring(trim(event_type), 1, 3)) ELSE 'NEU' END AS sentiment, round(least(greatest(floor(value), 0.0), 1.0), 2) AS clamped FROM events")
def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.norm_sentiment(F.col("event_type")).alias("sentiment"), text.clamp01(F.floor("value").cast("double")).alias("clamped"))


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{scratch_folder(spark)}/inkspan-{uuid.uuid4().hex}"


@query(with_views(["articles"], "SELECT id, source, url, title FROM articles"))
def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles stored in two overlapping runs, partitioned by source; the second run adds only new ones."""
    a, path = views.articles(spark, sf_dir), _scratch(spark)
    append_new(a.filter("id % 2 = 0"), path, "id", "source")
    append_new(a, path, "id", "source")
    append_new(a, path, "id", "source")
    return spark.read.parquet(path).select("id", "source", "url", "title")


@query(with_views(["articles"], """SELECT id::VARCHAR AS id, url, overall_sentiment, id % 3 <> 0 AS entities_exhaustive, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS entities, CASE WHEN id % 2 = 0 THEN source END AS first_name, framing FROM articles"""))
def golden_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled set written as JSON lines, with fields left out, and read back."""
    a, path, i = views.articles(spark, sf_dir), _scratch(spark), F.col("id")
    entity = F.when(i % 2 == 0, F.array(F.struct(F.col("source").alias("name"), F.lit("ORG").alias("type"))))
    labelled = a.select(i.cast("string").alias("id"), "source", "url", "overall_sentiment", F.when(i % 3 == 0, False).alias("entities_exhaustive"), entity.alias("entities"), "framing")
    labelled.write.option("ignoreNullFields", "true").json(path)
    g = read_golden(spark, path)
    return g.select("id", "url", "overall_sentiment", "entities_exhaustive", F.coalesce(F.size("entities"), F.lit(0)).alias("entities"), F.get("entities", F.lit(0))["name"].alias("first_name"), "framing")


@query(with_views(["articles"], """SELECT '{"source":"' || source || '","n":' || count(*) || CASE WHEN count(framing) > 0 THEN ',"framed":' || count(framing) ELSE '' END || '}' AS report FROM articles GROUP BY source"""))
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each source as JSON texts."""
    framed = F.nullif(F.count("framing"), F.lit(0))
    return evaluate.report_json(views.articles(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), framed.alias("framed")))


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), (F.col("page_id") % 9).cast("string")).alias("source"), "url", "html")


_INGESTED = f"""WITH {views.READ_SQL}, c AS (SELECT 'm' || page_id % 9 AS source, {canonical_url_sql('url')} AS url, title, body FROM read WHERE title <> '' AND body <> '')
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY source, title, body) = 1"""


@query(_INGESTED)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages streamed into the article store: the same addresses as the batch form gives."""
    base = _scratch(spark)
    streamed = streams.page_stream(spark, f"{sf_dir}/pages.parquet*", "page_id long, url string, html string")
    rows = streamed.select(F.concat(F.lit("m"), (F.col("page_id") % 9).cast("string")).alias("source"), "url", "html")
    streams.ingest_stream(rows, f"{base}/store", f"{base}/state").awaitTermination()
    return streams.ingest_store(spark, f"{base}/store").read("articles").select("source", "url", "title", "body")


@query(_INGESTED)
def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the ingest."""
    return streams.ingest_batch(_page_rows(spark, sf_dir)).select("source", "url", "title", "body")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, a, k, a AS anchor, true AS kept FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.event_id, r.a, r.k, CASE WHEN r.a - f.anchor >= 7200000000 THEN r.a ELSE f.anchor END, r.a - f.anchor >= 7200000000 FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT 'u' || user_id AS url, event_id AS id, a AS at_us FROM f WHERE kept""")
def deduped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that start an analysis, with a window of two hours anchored at it."""
    return streams.dedupe_requests_batch(_requests(spark, sf_dir), 120)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.page_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


@query(ORACLES["deduped_requests"])
def streamed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream with keyed state."""
    base, e = _scratch(spark), _event_stream(spark, sf_dir)
    r = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    streams.dedupe_requests_stream(r, 120).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query()
def windowed_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage counts in windows of a day, as the stream would give them."""
    return streams.stage_counts_stream(views.stage_events(spark, sf_dir), "1 day").select(F.col("window.start").alias("start"), "source", "stage", "n")


@query(with_views(["stage_events"], "SELECT date_trunc('day', \"at\") AS start, source, stage, count(*) AS n FROM stage_events GROUP BY 1, 2, 3"))
def streamed_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in update mode: the last count of each window is its count."""
    base, e = _scratch(spark), _event_stream(spark, sf_dir)
    events = e.select(F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("source"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("at"))
    counts = streams.stage_counts_stream(events, "1 day")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out").select(F.col("window.start").alias("start"), "source", "stage", "n", "batch")
    return rows.groupBy("start", "source", "stage").agg(F.max_by("n", "batch").alias("n"))


ORACLES["windowed_stage_counts"] = with_views(["stage_events"], "SELECT date_trunc('day', \"at\") AS start, source, stage, count(*) AS n FROM stage_events GROUP BY 1, 2, 3")


_ALIAS_PATCHES = f"""n AS (SELECT id, CASE id % 4 WHEN 0 THEN alias || '-Dos' WHEN 1 THEN 'Clash' ELSE alias END AS alias, type, CASE WHEN id % 5 = 2 THEN false ELSE is_active END AS is_active FROM aliases),
base AS (SELECT id, {key_sql("alias")} || '/' || type AS key FROM aliases), patches AS (SELECT id, {key_sql("alias")} || '/' || type AS key FROM n), {_in_turn("told AS (SELECT id, ok FROM turn WHERE i > 0)")}"""


def _patched_aliases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, i = views.aliases(spark, sf_dir), F.col("id")
    alias = F.when(i % 4 == 0, F.concat(F.lit("  "), "alias", F.lit("-Dos "))).when(i % 4 == 1, "Clash")
    none = F.lit(None).cast("string")
    return maintain.patch_aliases(a, a.select("id", alias.alias("alias"), none.alias("canonical_name"), none.alias("type"), F.when(i % 5 == 2, False).alias("is_active")))


@query(_recursive(["aliases"], f"""{_ALIAS_PATCHES}, o AS (SELECT a.id, CASE WHEN ok THEN n.alias ELSE a.alias END AS alias, a.type, CASE WHEN ok THEN n.is_active ELSE a.is_active END AS is_active FROM aliases a JOIN n USING (id) JOIN told USING (id))
SELECT *, {key_sql("alias")} AS alias_key FROM o"""))
def patched_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases renamed and switched off; keys follow, clashing patches are left out."""
    return _patched_aliases(spark, sf_dir)[0].select("id", "alias", "alias_key", "type", "is_active")


@query(_recursive(["aliases"], f"{_ALIAS_PATCHES} SELECT id, 'clash' AS reason FROM told WHERE NOT ok"))
def rejected_alias_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patched_aliases(spark, sf_dir)[1]


@query(with_views(["articles", "canonical"], """SELECT a.id, CASE WHEN d.id % 3 <> 0 THEN d.id END AS dominant_actor_id, CASE WHEN b.id % 3 <> 0 THEN b.id END AS blamed_actor_id, CASE WHEN c.id % 3 <> 0 THEN c.id END AS credited_actor_id
FROM articles a LEFT JOIN canonical d ON d.id = a.id % 50 + 1 LEFT JOIN canonical b ON b.id = a.id % 70 + 1 LEFT JOIN canonical c ON c.id = a.id % 50 + 1"""))
def unlinked_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors of articles after a third of the dimension was deleted."""
    c, i = views.canonical(spark, sf_dir), F.col("id")
    known = c.agg(F.max("id").alias("top"))
    a = views.articles(spark, sf_dir).select("id").crossJoin(F.broadcast(known))  # one row
    of = lambda n: F.when(i % n + 1 <= F.col("top"), i % n + 1)
    a = a.select("id", of(50).alias("dominant_actor_id"), of(70).alias("blamed_actor_id"), of(50).alias("credited_actor_id"))
    return resolve.unlink_actors(a, c.filter("id % 3 = 0"))


def _lengths(title: str, body: str) -> dict:
    """A stand-in for an analyzer, which fails on some texts."""
    if len(body) % 11 == 0:
        raise ValueError("no result")
    return {"overall_sentiment": ("POS", "NEG", "NEU")[len(body) % 3], "topic_keywords": [str(len(title)), "x"], "entities": []}


@query(with_views(["articles"], """SELECT id, length(body) % 11 = 0 AS failed, CASE WHEN length(body) % 11 > 0 THEN ['POS', 'NEG', 'NEU'][length(body) % 3 + 1] END AS overall_sentiment,
CASE WHEN length(body) % 11 > 0 THEN length(coalesce(title, '')) || ', x' END AS topic_keywords, CASE WHEN length(body) % 11 > 0 THEN 'v7' END AS analyzer_version FROM (SELECT id, title, coalesce(body, '') AS body FROM articles)"""))
def analysed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article through an analyzer; those it fails on are marked, the rest go on."""
    out = analyze.analyze_articles(views.articles(spark, sf_dir).select("id", "title", "body"), analyze.analysis(_lengths), "lengths", "none", "v7")
    return out.select("id", F.col("analysis_error").isNotNull().alias("failed"), "result.overall_sentiment", F.array_join("result.topic_keywords", ", ").alias("topic_keywords"), "analyzer_version")


def _capital_runs(title: str, body: str) -> dict:
    """A stand-in for an analyzer: runs of capitalised words as mentions, the first as the dominant actor."""
    found = Counter(re.findall("[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,}){0,3}", body))
    rows = [{"name": n, "type": "PERSON" if " " in n else "ORG", "mentions_count": k, "extraction_confidence": 1.0} for n, k in found.items()]
    return {"overall_sentiment": "NEU", "content_flags": [], "topic_keywords": [], "dominant_actor": rows[0]["name"] if rows else None, "entities": rows}


_CAPITALS = "[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,}){0,3}"
#: One batch, so the only full names known beforehand are those of the aliases.
_CORPUS = f"""{views.READ_SQL}, page AS (SELECT * FROM (SELECT 'm' || page_id % 9 AS source, {canonical_url_sql('url')} AS article_id, title, body FROM read WHERE title <> '' AND body <> '') QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY source, title, body) = 1),
runs AS (SELECT article_id, unnest(l) AS name, generate_subscripts(l, 1) AS at_ FROM (SELECT article_id, regexp_extract_all(body, '{_CAPITALS}') AS l FROM page)),
mentions AS (SELECT article_id, name, CASE WHEN contains(name, ' ') THEN 'PERSON' ELSE 'ORG' END AS type, count(*) AS mentions_count, min(at_) AS at_, NULL::VARCHAR AS sentiment_toward, NULL::DOUBLE AS sentiment_score, NULL::VARCHAR AS context, 1.0::DOUBLE AS extraction_confidence FROM runs GROUP BY ALL),
surnames AS (SELECT surname, min(name) AS full_name FROM (SELECT name, ws[-1] AS surname FROM (SELECT name, {words_sql(key_sql('name'))} AS ws FROM (SELECT DISTINCT canonical_name AS name FROM aliases WHERE type = 'PERSON' AND is_active)) WHERE len(ws) >= 2) GROUP BY 1 HAVING count(*) = 1),
{_CANONICAL}, first_one AS (SELECT article_id, arg_min(name, at_) AS actor FROM mentions GROUP BY 1), {matched_sql('first_one', 'twice', 'hits')}
SELECT t.article_id AS url, t.name, t.type, t.mentions_count::INT AS mentions_count, coalesce(h.matched = t.name, false) AS dominant FROM twice t LEFT JOIN hits h USING (article_id)"""


@query(_recursive(["aliases"], _CORPUS))
def ingested_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages streamed into articles, mentions and the dimension, as (url, name, type, mentions_count, dominant)."""
    base = _scratch(spark)
    streamed = streams.page_stream(spark, f"{sf_dir}/pages.parquet*", "page_id long, url string, html string")
    rows = streamed.select(F.concat(F.lit("m"), (F.col("page_id") % 9).cast("string")).alias("source"), "url", F.encode("html", "UTF-8").alias("raw"), F.lit("text/html; charset=utf-8").alias("content_type"))
    run = analyze.analysis(_capital_runs)
    streams.corpus_stream(rows, lambda a: analyze.analyze_articles(a, run, "runs", "none", "1"), lambda: views.aliases(spark, sf_dir), f"{base}/store", f"{base}/state").awaitTermination()
    a, m, c = (streams.corpus_store(spark, f"{base}/store").read(n) for n in ("articles", "entities", "canonical_entities"))
    m = m.join(c.select(F.col("id").alias("canonical_entity_id")), "canonical_entity_id").join(a.select(F.col("id").alias("article_id"), "url", "dominant_actor_id"), "article_id")
    return m.select("url", "name", "type", "mentions_count", F.col("canonical_entity_id").eqNullSafe(F.col("dominant_actor_id")).alias("dominant"))


@query(with_views(["raw_mentions", "aliases", "mentions", "canonical"], f"""{_PERSONS},
act AS (SELECT alias_key, arg_max(canonical_name, id) AS cn, arg_max(type, id) AS ct FROM aliases WHERE is_active GROUP BY 1),
r AS (SELECT article_id, coalesce(cn, m.name) AS name, coalesce(ct, m.type) AS type FROM raw_mentions m LEFT JOIN act ON act.alias_key = {key_sql('m.name')}),
w AS (SELECT *, CASE WHEN type = 'PERSON' AND len(ws) = 1 THEN ws[1] END AS w FROM (SELECT *, {words_sql(key_sql('name'))} AS ws FROM r))
SELECT article_id, CASE WHEN full_name IS NOT NULL AND {key_sql('full_name')} <> {key_sql('name')} THEN full_name ELSE name END AS name, type, count(*) AS n FROM w LEFT JOIN surnames ON surname = w GROUP BY ALL"""))
def streamed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of arriving documents against the alias catalogue and the surname map, read for each batch."""
    base = _scratch(spark)
    d = streams.page_stream(spark, f"{sf_dir}/documents.parquet*", "doc_id long, text string")
    runs = d.select(F.col("doc_id").alias("article_id"), F.explode(F.regexp_extract_all("text", F.lit(views.NAME_RUN), F.lit(0))).alias("name"))
    person = F.contains(F.col("name"), F.lit(" ")) | (F.length("name") % 2 == 0)
    runs = runs.withColumn("type", F.when(person, "PERSON").otherwise("ORG"))
    known = once(surnames(spark, sf_dir))
    streams.resolve_stream(runs, lambda: views.aliases(spark, sf_dir), lambda: known, f"{base}/store", f"{base}/state").awaitTermination()
    return streams.mention_store(spark, f"{base}/store", runs.schema).read("mentions").groupBy("article_id", "name", "type").agg(F.count(F.lit(1)).alias("n"))


@query(_INGESTED.replace("body <> '')", "body <> '' AND contains(lower(title), 'the'))"))
def filtered_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages streamed into the article store, of one topic only; stored twice by two streams, and once in the store."""
    base = _scratch(spark)
    streamed = streams.page_stream(spark, f"{sf_dir}/pages.parquet*", "page_id long, url string, html string")
    rows = streamed.select(F.concat(F.lit("m"), (F.col("page_id") % 9).cast("string")).alias("source"), "url", "html")
    for state in ("one", "two"):
        streams.ingest_stream(rows, f"{base}/store", f"{base}/{state}", F.contains(F.lower("title"), F.lit("the"))).awaitTermination()
    return streams.ingest_store(spark, f"{base}/store").read("articles").select("source", "url", "title", "body")
