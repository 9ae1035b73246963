"""Streaming forms of the batch jobs; each micro-batch runs the batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from inkspan.functions.text import join_list, significant_words
from inkspan.functions.urls import canonical_url
from inkspan.operators import resolve
from inkspan.sources.pages import decode_page, extract_articles
from inkspan.sources.store import Snapshot, Store, stream_id
from inkspan.sources.tables import ARTICLES, CANONICAL, MENTIONS, once, one_of_each

REUSE_MINUTES = 60


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest_batch(pages: DataFrame, on_topic: Column | None = None) -> DataFrame:
    """Pages (source, url, html, or the bytes raw and their content_type) to article rows, one for each canonical address."""
    if "html" not in pages.columns:
        pages = pages.withColumn("html", decode_page(F.col("raw"), F.col("content_type"))).drop("raw", "content_type")
    a = extract_articles(pages).withColumn("url", canonical_url(F.col("url")))
    a = a.filter(on_topic) if on_topic is not None else a
    return one_of_each(a, "url")


INGESTED = "source string, url string, title string, body string, section string, authors string, published_at timestamp"
RUN = "stream string, batch long, discovered long, articles long, failed long, saved long"
#: Addresses; names of the dimension by type and name; surnames with the first and last of the full names that end in them.
URLS, NAMES, SURNAMES = ("id long", ["min(id) AS id"]), ("id long", ["min(id) AS id"]), ("lo string, hi string", ["min(lo) AS lo", "max(hi) AS hi"])


def ingest_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"articles": INGESTED, "runs": RUN}, {"urls": URLS})


def corpus_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"articles": ARTICLES, "entities": MENTIONS, "canonical_entities": CANONICAL, "runs": RUN}, {"urls": URLS, "names": NAMES, "surnames": SURNAMES})


def mention_store(spark: SparkSession, path: str, schema: StructType) -> Store:
    return Store(spark, path, {"mentions": schema}, {})


def _run_row(spark: SparkSession, *values: object) -> DataFrame:
    return spark.createDataFrame([values], RUN)


def _counted(batch: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows of a micro-batch, and their number once they have been read."""
    seen = Observation()
    return batch.observe(seen, F.count(F.lit(1)).alias("n")), seen


def save_ingested(articles: DataFrame, store: Store, stream: str, batch_id: int, discovered: int) -> bool:
    """Store the articles whose address is new, with the batch's summary; False if the batch is stored already."""
    spark, articles = store.spark, once(articles)
    keys = once(articles.select(F.col("url").alias("key")))

    def work(now: Snapshot):
        known = store.lookup("urls", keys, now).select(F.col("key").alias("url"))
        fresh = once(articles.join(known, "url", "left_anti").select([f.split()[0] for f in INGESTED.split(", ")]))
        n = fresh.count()
        rows = {"articles": fresh} if n else {}
        return rows | {"runs": _run_row(spark, stream, batch_id, discovered, keys.count(), 0, n)}, {"urls": (fresh.select(F.col("url").alias("key"), F.lit(0).cast("long").alias("id")), n)}, {}

    return store.transact(stream, batch_id, work)


def ingest_stream(pages: DataFrame, path: str, checkpoint: str, on_topic: Column | None = None):
    """Append new articles of each micro-batch to a store, with one summary row.

    A replayed micro-batch changes nothing; another stream, or a new
    checkpoint, adds what is not stored.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch, seen = _counted(batch)
        found = once(ingest_batch(batch, on_topic))
        spark = batch.sparkSession
        save_ingested(found, ingest_store(spark, path), stream_id(spark, checkpoint), batch_id, seen.get["n"])

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _name_key(type_: str, name: str) -> Column:
    return F.concat_ws("\n", type_, name)


def known_surnames(store: Store, names: DataFrame, aliases: DataFrame, now: Snapshot) -> DataFrame:
    """The rows of `person_map` that these names (and the catalogue's) can need, from the index instead of all stored names."""
    active = aliases.filter("is_active").select(F.col("canonical_name").alias("name"), "type")
    words = names.select("name").union(active.select("name")).select(F.explode(significant_words(F.col("name"))).alias("key"))
    stored = store.lookup("surnames", once(words.distinct()), now)
    own = resolve.last_words(active.filter("type = 'PERSON'").select("name")).select(F.col("surname").alias("key"), F.col("name").alias("lo"), F.col("name").alias("hi"))
    both = stored.unionByName(own).groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return both.filter("lo = hi").select(F.col("key").alias("surname"), F.col("lo").alias("full_name"))


def save_analyses(analysed: DataFrame, aliases: DataFrame, store: Store, stream: str, batch_id: int, discovered: int | None = None) -> bool:
    """Store analysed articles, their mentions and the new dimension rows as one commit; False if the batch is stored already.

    Stored addresses are left out, and so are articles whose analysis failed.
    Names go through the alias catalogue and the surnames known so far; actors
    become dimension ids.  Of what is stored, only the parts of the indexes in
    which the batch's addresses, names and surnames can be are read.
    """
    spark, analysed = store.spark, once(analysed)
    good = analysed.filter("analysis_error IS NULL")
    urls = once(good.select(F.col("url").alias("key")))
    names = [f.name for f in spark.createDataFrame([], ARTICLES).schema]
    at = F.current_timestamp()

    def work(now: Snapshot):
        top = lambda table: spark.range(1).select(F.lit(now.tops.get(table, 0)).cast("long").alias("id"))
        fresh = good.join(store.lookup("urls", urls, now).select(F.col("key").alias("url")), "url", "left_anti")
        fresh = once(resolve.numbered(fresh, top("articles"), "url"))
        found = fresh.select(F.col("id").alias("article_id"), F.explode("result.entities").alias("e")).select("article_id", "e.*")
        actors = fresh.select(F.col("id").alias("article_id"), *[f"result.{a}" for a in resolve.ACTORS])
        entities, actors = resolve.canonicalize_result(actors, found, aliases, once(known_surnames(store, found, aliases, now)))
        entities = once(entities)
        used = once(entities.select("name", "type").distinct().withColumn("key", _name_key("type", "name")))
        known = used.join(store.lookup("names", used, now), "key").select("id", "name", "type")
        new = once(resolve.numbered(used.join(known, ["name", "type"], "left_anti"), top("canonical_entities"), "type", "name").select("id", "name", "type"))
        linked = once(resolve.numbered(resolve.link_mentions(entities, known.unionByName(new)), top("entities"), "article_id", "name", "type"))
        row = fresh.join(resolve.with_actor_ids(actors, linked).withColumnRenamed("article_id", "id"), "id").select("*", "result.*").withColumn("scraped_at", at)
        row = row.withColumn("topic_keywords", join_list(F.col("topic_keywords"))).withColumn("content_flags", join_list(F.col("content_flags")))
        n = {"articles": fresh.count(), "entities": linked.count(), "canonical_entities": new.count()}
        rows = {
            "articles": row.select(names),
            "entities": linked.withColumn("mentions_count", F.col("mentions_count").cast("int")).select([f.name for f in spark.createDataFrame([], MENTIONS).schema]),
            "canonical_entities": new.select("id", "name", "type", F.lit(None).cast("string").alias("description"), at.alias("created_at"), at.alias("updated_at")),
        }
        counts = analysed.agg(F.count(F.lit(1)).alias("all"), F.count("analysis_error").alias("failed")).first()
        summary = _run_row(spark, stream, batch_id, counts["all"] if discovered is None else discovered, counts["all"], counts["failed"], n["articles"])
        surnames = resolve.last_words(new.filter("type = 'PERSON'").select("name")).groupBy(F.col("surname").alias("key")).agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
        indexed = {
            "urls": (fresh.select(F.col("url").alias("key"), "id"), n["articles"]),
            "names": (new.select(_name_key("type", "name").alias("key"), "id"), n["canonical_entities"]),
            "surnames": (surnames, n["canonical_entities"]),
        }
        return {t: df for t, df in rows.items() if n[t]} | {"runs": summary}, indexed, {t: now.tops.get(t, 0) + k for t, k in n.items()}

    return store.transact(stream, batch_id, work)


def rebuild_indexes(store: Store) -> None:
    """The indexes of a corpus made anew from its tables, after names or addresses were changed or deleted."""
    now = store.snapshot()
    names = store.read("canonical_entities", now)
    mentioned = store.read("entities", now).filter("type = 'PERSON'").select("name")
    surnames = resolve.last_words(names.filter("type = 'PERSON'").select("name").union(mentioned)).select(F.col("surname").alias("key"), F.col("name").alias("lo"), F.col("name").alias("hi"))
    store.replace({}, {"urls": store.read("articles", now).select(F.col("url").alias("key"), "id"), "names": names.select(_name_key("type", "name").alias("key"), "id"), "surnames": surnames})


def corpus_stream(pages: DataFrame, analyze: Callable[[DataFrame], DataFrame], aliases: Callable[[], DataFrame], path: str, checkpoint: str, on_topic: Column | None = None):
    """The whole ingest of each micro-batch: decode, extract, one page an address, topic, analysis, names, storage.

    analyze is `analyze_articles` with its analyzer, and gets only pages whose
    address is not stored; aliases reads the catalogue, anew for each batch.
    The store's runs have one summary a batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch, seen = _counted(batch)
        found, store = once(ingest_batch(batch, on_topic)), corpus_store(spark, path)
        known = store.lookup("urls", found.select(F.col("url").alias("key")), store.snapshot()).select(F.col("key").alias("url"))
        analysed = analyze(found.join(known, "url", "left_anti"))
        save_analyses(analysed, aliases(), store, stream_id(spark, checkpoint), batch_id, seen.get["n"])

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolve_stream(mentions: DataFrame, aliases: Callable[[], DataFrame], surnames: Callable[[], DataFrame], path: str, checkpoint: str):
    """Arriving mentions against the alias catalogue and the surname map, both read anew for each micro-batch; stored in `mention_store`."""
    columns, schema = mentions.columns, mentions.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = resolve.resolve_surnames(resolve.resolve_aliases(batch, aliases()), surnames()).select(columns)
        mention_store(spark, path, schema).transact(stream_id(spark, checkpoint), batch_id, lambda now: ({"mentions": out}, {}, {}))

    return mentions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _reuse(minutes: int):
    span = minutes * 60_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        kept = []
        for r in rows.itertuples(index=False):
            if last is None or r.at - last >= span:
                kept.append((key[0], r.id, r.at))
                last = r.at
        state.update((last,))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        if kept:
            yield pd.DataFrame(kept, columns=["url", "id", "at_us"])

    return run


def dedupe_requests_stream(requests: DataFrame, minutes: int = REUSE_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """Requests (url, id, at) that start an analysis: those not within the window after the last one that did.

    The window is anchored at the analysis; a request that reuses it does not
    extend it.  State is one time for each URL, dropped when the watermark
    passes the end of its window.
    """
    r = requests.withWatermark("at", delay).select("url", "id", F.unix_micros("at").alias("at_us"), "at")
    r = r.select("url", "id", "at_us", "at").withColumnRenamed("at", "event_time").withColumnRenamed("at_us", "at")
    return r.groupBy("url").applyInPandasWithState(_reuse(minutes), "url string, id long, at_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def _fold(span: int):
    """Requests that start an analysis, from rows sorted by (url, session, at, id); the state is the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            kept = []
            for k, (url, session, at) in enumerate(zip(*[b.column(c).to_pylist() for c in ("url", "session", "at_us")], strict=True)):
                if now != (url, session):
                    now, last = (url, session), None
                elif at is None or at - last < span:
                    continue
                last = at
                kept.append(k)
            yield b.select(["url", "id", "at_us"]).take(pa.array(kept, pa.int64()))

    return run


def dedupe_requests_batch(requests: DataFrame, minutes: int = REUSE_MINUTES) -> DataFrame:
    """The same over a table, where one URL may hold most rows.

    A request at least the window after its predecessor always starts an
    analysis.  Time is cut in slots of one window; a slot after an empty one
    starts a session, and each session of a URL is folded alone, row by row.
    A URL's requests without a time are a session of their own.
    """
    span = minutes * 60_000_000
    r = requests.select("url", "id", F.unix_micros("at").alias("at_us")).withColumn("slot", F.expr(f"(at_us - pmod(at_us, {span}L)) div {span}L"))
    slots = r.select("url", "slot").distinct()
    of_url = Window.partitionBy("url").orderBy("slot")
    slots = slots.withColumn("head", F.when(F.coalesce(F.lag("slot").over(of_url) == F.col("slot") - 1, F.lit(False)), None).otherwise(F.col("slot")))
    slots = slots.select(F.col("url").alias("slot_url"), F.col("slot").alias("slot_"), F.last("head", ignorenulls=True).over(of_url).alias("session"))
    r = r.join(slots, F.col("url").eqNullSafe(F.col("slot_url")) & F.col("slot").eqNullSafe(F.col("slot_"))).select("url", "session", "at_us", "id")
    dealt = r.repartition("url", "session").sortWithinPartitions("url", "session", "at_us", "id")
    kinds = dict(r.dtypes)
    return dealt.mapInArrow(_fold(span), f"url {kinds['url']}, id {kinds['id']}, at_us long")


def stage_counts_stream(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of each source and stage in tumbling windows."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width), "source", "stage").agg(F.count(F.lit(1)).alias("n"))
