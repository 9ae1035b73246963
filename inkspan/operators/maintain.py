"""Job tables, run summaries, patches and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import norm_key
from inkspan.functions.urls import canonical_url
from inkspan.sources.tables import once

REUSE_MINUTES, STALE_MINUTES, KEEP_HOURS = 60, 15, 48
BUCKETS = (1, 2.5, 5, 10, 20, 30, 60, 120, 300)
STALE_ERROR = "El análisis se interrumpió. Vuelve a intentarlo."  # a fixed value
PROGRESS = "map<string,struct<status:string,detail:string,updated_at:string>>"


def _latest(df: DataFrame, key: str, order: str, tie: str = "id") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))).filter("_r = 1").drop("_r")


def _within(column: str, now: Column, minutes: int) -> Column:
    return F.col(column) >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def reusable_jobs(jobs: DataFrame, now: Column, minutes: int = REUSE_MINUTES) -> DataFrame:
    """For each URL the latest finished job with a result inside the window; none for a window of 0."""
    if minutes <= 0:
        return jobs.limit(0)
    return _latest(jobs.filter((F.col("status") == "done") & F.col("result_json").isNotNull() & _within("created_at", now, minutes)), "url", "created_at")


def inflight_jobs(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    return _latest(jobs.filter(F.col("status").isin("pending", "running") & _within("created_at", now, minutes)), "url", "created_at")


def _swept(now: Column, stale: int, keep_hours: int) -> tuple[Column, Column]:
    """Whether a job is stale, and whether it goes (a job that just failed too); never for keep_hours of 0."""
    old = F.col("status").isin("pending", "running") & (F.col("created_at") <= now - F.expr(f"INTERVAL {int(stale)} MINUTES"))
    over = F.col("status").isin("done", "failed") | old
    gone = over & (F.col("created_at") <= now - F.expr(f"INTERVAL {int(keep_hours)} HOURS")) if keep_hours > 0 else F.lit(False)
    return F.coalesce(old, F.lit(False)), F.coalesce(gone, F.lit(False))


def sweep_jobs(jobs: DataFrame, now: Column, stale: int = STALE_MINUTES, keep_hours: int = KEEP_HOURS) -> DataFrame:
    """The jobs after a sweep: stale ones failed and without a stage, old finished ones (those just failed too) gone."""
    old, gone = _swept(now, stale, keep_hours)
    failed = {"status": F.lit("failed"), "error": F.lit(STALE_ERROR), "finished_at": now, "stage": F.lit(None)}
    swept = jobs.filter(~gone).withColumn("_old", old)
    return swept.withColumns({c: F.when(F.col("_old"), v).otherwise(F.col(c)) for c, v in failed.items() if c in jobs.columns}).drop("_old")


def sweep_counts(jobs: DataFrame, now: Column, stale: int = STALE_MINUTES, keep_hours: int = KEEP_HOURS) -> DataFrame:
    """(interrupted, purged): how many jobs a sweep fails and deletes; one may count as both."""
    return jobs.agg(*[F.count(F.when(c, 1)).alias(n) for c, n in zip(_swept(now, stale, keep_hours), ("interrupted", "purged"), strict=True)])


def triage(requests: DataFrame, articles: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(url, action) of each requested URL: saved, reuse, join or enqueue, the first that applies."""
    r = requests.select("url").distinct().withColumn("_c", canonical_url(F.col("url")))
    stored = articles.select(F.explode(F.array("url", canonical_url(F.col("url")))).alias("_c")).distinct().withColumn("_saved", F.lit(True))
    reuse = reusable_jobs(jobs, now).select("url", F.lit(True).alias("_reuse"))
    join = inflight_jobs(jobs, now).select("url", F.lit(True).alias("_join"))
    j = r.join(stored, "_c", "left").join(reuse, "url", "left").join(join, "url", "left")
    return j.select("url", F.when(F.col("_saved"), "saved").when(F.col("_reuse"), "reuse").when(F.col("_join"), "join").otherwise("enqueue").alias("action"))


def new_urls(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Candidates stored neither under their own URL nor under its canonical form."""
    stored = articles.select(F.explode(F.array("url", canonical_url(F.col("url")))).alias("_s")).distinct()
    c = candidates.withColumn("_c", canonical_url(F.col("url")))
    return c.join(stored, F.col("_c") == F.col("_s"), "left_anti").join(stored, F.col("url") == F.col("_s"), "left_anti").drop("_c")


def latest_progress(updates: DataFrame) -> DataFrame:
    """(source, stage, id, value): the last update of each stage of each source."""
    last = F.max_by(F.struct("id", "value"), F.struct("at", "id"))
    return updates.groupBy("source", "stage").agg(last.alias("u")).select("source", "stage", "u.*")


def parse_progress(rows: DataFrame, column: str = "progress_json") -> DataFrame:
    """Entries `source:stage` of a JSON map as rows; those without a status or a stage are dropped."""
    e = rows.select("*", F.explode(F.from_json(column, PROGRESS)).alias("_k", "_v"))
    e = e.filter(F.contains(F.col("_k"), F.lit(":")) & F.col("_v.status").isNotNull())
    return e.select(*[c for c in rows.columns if c != column], F.substring_index("_k", ":", 1).alias("source"), F.regexp_extract("_k", ":(.*)$", 1).alias("stage"), "_v.*")


def parse_result(jobs: DataFrame, schema: str, column: str = "result_json") -> DataFrame:
    return jobs.withColumn("result", F.from_json(column, schema))


def run_totals(events: DataFrame, discovered: Column, saved: Column, failed: Column, cancelled: Column | None = None, broken: Column | None = None) -> DataFrame:
    """(source, is_total, discovered, saved, failed, status) for each source and over all.

    An event that is cancelled, or broken, makes its source so.  The whole run
    is cancelled if a source is, and failed only if broken without a source.
    """
    n = lambda c: F.count(F.when(c, 1))
    of = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    run_broke = of(broken) & F.col("source").isNull()
    g = events.rollup("source").agg(
        (F.grouping("source") == 1).alias("is_total"), n(discovered).alias("discovered"), n(saved).alias("saved"), n(failed).alias("failed"),
        n(of(cancelled)).alias("_cancelled"), n(of(broken)).alias("_broken"), n(run_broke).alias("_run"),
    ).filter("is_total OR source IS NOT NULL")
    fails = F.when(F.col("is_total"), F.col("_run") > 0).otherwise(F.col("_broken") > 0)
    return g.withColumn("status", F.when(fails, "failed").when(F.col("_cancelled") > 0, "cancelled").otherwise("success")).drop("_cancelled", "_broken", "_run")


def crawl_run_summary(totals: DataFrame) -> DataFrame:
    """One row: sums and a JSON map by source, sources in order."""
    each = F.array_sort(F.collect_list(F.struct(F.col("source"), F.struct("discovered", "saved", "failed").alias("n"))))
    sums = [F.sum(c).alias(f"articles_{c}") for c in ("discovered", "saved", "failed")]
    return totals.filter("NOT is_total").agg(*sums, F.to_json(F.map_from_entries(each)).alias("stats_by_source"))


def stage_counts(events: DataFrame, stages: list[str]) -> DataFrame:
    """Articles of each source by stage, one column a stage."""
    return events.groupBy("source").pivot("stage", stages).count().na.fill(0)


def duration_histogram(jobs: DataFrame, seconds: str = "seconds", buckets: tuple = BUCKETS) -> DataFrame:
    """Cumulative buckets, count and sum of seconds for each status."""
    cols = [F.count(F.when(F.col(seconds) <= b, 1)).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    return jobs.groupBy("status").agg(*cols, F.count(seconds).alias("le_inf"), F.round(F.sum(seconds), 4).alias("total_seconds"))


def scrape_jobs_with_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.select("correlation_id", *[F.col(c).alias(f"run_{c}") for c in runs.columns if c != "correlation_id"])
    return jobs.join(r, "correlation_id", "left")


def recent_runs(runs: DataFrame, n: int = 20, order: str = "started_at") -> DataFrame:
    return runs.orderBy(F.desc(order), F.desc("id")).limit(n)


def _row_key(row: Column, unique: list[str]) -> Column:
    """The values of the unique columns of a struct as one text; nulls count as a value."""
    return F.to_json(F.struct(*[row[c].alias(f"k{k}") for k, c in enumerate(unique)]), {"ignoreNullFields": "false"})


def apply_patches(df: DataFrame, patches: DataFrame, fields: list[str], unique: list[str], order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(patched table, rejected patches): as if the patches came one after the other, in the order of `order`, then id.

    A patch has an id, and for each field a value and a flag `set_<field>`.  One
    that names no row is rejected as missing; one that would give a row the
    unique key of another row, as things stand at its turn, as a clash, whole.
    So a key that an earlier patch has left is free, and one that a later patch
    will leave is not; of several that want a free key the first gets it; two
    rows cannot swap keys.  A row may have many patches.

    Patches are decided in rounds, all at once that depend on no undecided one:
    a patch waits for earlier patches to its row, to the row that holds the key
    it wants, and, if nobody does, for earlier ones that want that key.  There
    is a round for each link of the longest such chain.  Only rows that are
    patched, or hold a key that a patch asks for, take part.
    """
    at = F.struct(F.col(order), F.col("id"), F.col("_tie")) if order != "id" else F.struct(F.col("id"), F.col("_tie"))
    p = patches.withColumn("_tie", F.monotonically_increasing_id() if order == "id" else F.xxhash64(*patches.columns))
    p = once(p.select("id", at.alias("at"), F.struct(*[F.col(f) for f in fields]).alias("new"), F.struct(*[F.col(f"set_{f}").alias(f) for f in fields]).alias("set")))
    missing = p.join(df.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("reason"))
    row = F.struct(*[F.col(c) for c in df.columns])
    taking = once(df.join(p.select("id").distinct(), "id", "left_semi").select("id", row.alias("row"), F.lit(False).alias("changed")))
    open_ = once(p.join(df.select("id"), "id", "left_semi"))
    rejected = open_.select("id", "at").limit(0)
    changed = lambda of: F.struct(*[F.when(F.col(f"set.{c}"), F.col(f"new.{c}")).otherwise(of[c]).alias(c) if c in fields else of[c].alias(c) for c in df.columns])
    while not open_.isEmpty():
        first = open_.groupBy("id").agg(F.min("at").alias("first"))
        j = open_.join(first, "id").join(taking.select("id", "row"), "id").withColumn("to", changed(F.col("row")))
        # What a later patch to a row wants is known if it sets all of the key; if not, others that want a free key wait for it.
        whole = F.lit(True)
        for c in unique:
            whole = whole & (F.col(f"set.{c}") if c in fields else F.lit(True))
        j = once(j.withColumn("known", (F.col("at") == F.col("first")) | whole).withColumn("key", _row_key(F.col("to"), unique)).withColumn("own", F.col("key") == _row_key(F.col("row"), unique)))
        fence = j.filter("NOT known").agg(F.min("at").alias("fence"))  # one row
        wanted = j.filter("known").groupBy("key").agg(F.min("at").alias("first_claim"))
        # Who holds the keys: rows that take part as they now are, and the others as they are stored.
        held = taking.select("id", _row_key(F.col("row"), unique).alias("key"))
        rest = df.join(taking.select("id"), "id", "left_anti").select("id", _row_key(row, unique).alias("key")).join(wanted.select("key"), "key", "left_semi")
        held = held.unionByName(rest).join(first, "id", "left").select("key", F.col("id").alias("holder"), F.col("first").alias("may_go"))
        met = j.filter("known").join(held, "key", "left")
        others = F.col("holder") != F.col("id")
        stays = others & (F.col("may_go").isNull() | (F.col("may_go") > F.col("at")))
        seen = met.groupBy("id", "at").agg(F.coalesce(F.max(stays), F.lit(False)).alias("taken"), F.coalesce(F.max(others), F.lit(False)).alias("held"))
        seen = j.filter("known").join(seen, ["id", "at"]).join(wanted, "key").crossJoin(F.broadcast(fence))
        turn = F.col("at") == F.col("first")
        alone = (F.col("first_claim") == F.col("at")) & (F.col("fence").isNull() | (F.col("at") < F.col("fence")))
        verdict = F.when(turn & F.col("own"), "yes").when(F.col("taken") & (turn | whole), "no").when(turn & ~F.col("held") & alone, "yes")
        done = once(seen.select("id", "at", "to", verdict.alias("verdict")).filter("verdict IS NOT NULL"))
        rejected = rejected.unionByName(done.filter("verdict = 'no'").select("id", "at"))
        won = done.filter("verdict = 'yes'").select("id", F.col("to").alias("_to"))
        taking = once(taking.join(won, "id", "left").select("id", F.coalesce("_to", "row").alias("row"), (F.col("changed") | F.col("_to").isNotNull()).alias("changed")))
        open_ = once(open_.join(done.select("id", "at"), ["id", "at"], "left_anti"))
    now = taking.filter("changed").select("id", F.col("row").alias("_row"))
    kept = df.join(now, "id", "left").select(*[F.when(F.col("_row").isNotNull(), F.col(f"_row.{c}")).otherwise(F.col(c)).alias(c) for c in df.columns])
    return kept, rejected.select("id", F.lit("clash").alias("reason")).unionByName(missing)


def patch_aliases(aliases: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched aliases, rejected patches): what is not NULL in a patch (id, alias, canonical_name, type, is_active) is set, and the key follows the alias."""
    p = patches.select("id", F.trim("alias").alias("alias"), norm_key(F.col("alias")).alias("alias_key"), F.trim("canonical_name").alias("canonical_name"), "type", "is_active")
    fields = [c for c in p.columns if c != "id"]
    return apply_patches(aliases, p.withColumns({f"set_{c}": F.col(c).isNotNull() for c in fields}), fields, ["alias_key", "type"])


def delete_articles(articles: DataFrame, mentions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given articles."""
    return articles.join(ids.select("id"), "id", "left_anti"), mentions.join(ids.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def delete_canonical(canonical: DataFrame, linked: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dimension without the given rows, and mentions with links to them set to NULL; for actors see unlink_actors."""
    gone = ids.select(F.col("id").alias("_gone"))
    m = linked.join(gone, F.col("canonical_entity_id") == F.col("_gone"), "left")
    return canonical.join(ids.select("id"), "id", "left_anti"), m.withColumn("canonical_entity_id", F.when(F.col("_gone").isNull(), F.col("canonical_entity_id"))).drop("_gone")
