"""Counts, per-entity reports, quotas and the columns of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import finds


def count_by_source(articles: DataFrame) -> DataFrame:
    """(source, n) and the total, whose source is NULL and is_total true."""
    return articles.rollup("source").agg(F.count(F.lit(1)).alias("n"), (F.grouping("source") == 1).alias("is_total"))


def count_by_sentiment(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.coalesce("overall_sentiment", F.lit("-")).alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))


def article_facets(articles: DataFrame) -> DataFrame:
    """(facet, value): the distinct sources and sections that are not empty."""
    pairs = articles.select(F.explode(F.array(F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")), F.struct(F.lit("section").alias("facet"), F.col("section").alias("value")))).alias("p")).select("p.*")
    return pairs.filter("value <> ''").distinct()


def top_entities(linked: DataFrame, canonical: DataFrame, n: int = 15) -> DataFrame:
    """(name, type, n): most mention rows by dimension name, or by their own name without one."""
    c = canonical.select(F.col("id").alias("canonical_entity_id"), F.col("name").alias("_name"), F.col("type").alias("_type"))
    # Rows are counted by id before the dimension is joined.
    own = linked.groupBy("canonical_entity_id", F.when(F.col("canonical_entity_id").isNull(), F.col("name")).alias("name"), F.when(F.col("canonical_entity_id").isNull(), F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    j = own.join(c, "canonical_entity_id", "left").groupBy(F.coalesce("_name", "name").alias("name"), F.coalesce("_type", "type").alias("type")).agg(F.sum("n").alias("n"))
    return j.orderBy(F.desc("n"), "name", "type").limit(n)


def canonical_counts(linked: DataFrame, canonical: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """(id, name, type, article_count, mention_count) of dimension rows; 0 without mentions."""
    c = canonical
    if kind:
        c = c.filter(F.col("type") == kind)
    if name:
        c = c.filter(finds(F.col("name"), name))
    # By entity and article first, so that an entity in very many articles is summed before it meets in one task.
    per = linked.filter("canonical_entity_id IS NOT NULL").groupBy("canonical_entity_id", "article_id").agg(F.sum("mentions_count").alias("m"))
    per = per.groupBy("canonical_entity_id").agg(F.count(F.lit(1)).alias("article_count"), F.sum("m").alias("mention_count"))
    j = c.join(per, c["id"] == per["canonical_entity_id"], "left")
    return j.select("id", "name", "type", F.coalesce("article_count", F.lit(0)).alias("article_count"), F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


def entity_count(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    n = mentions.groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("entity_count"))
    return articles.select("id").join(n, "id", "left").select("id", F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def entity_articles(linked: DataFrame, articles: DataFrame, n: int = 200) -> DataFrame:
    """The newest n articles of each dimension entity, with their rank."""
    j = linked.filter("canonical_entity_id IS NOT NULL").select("canonical_entity_id", F.col("article_id").alias("id")).distinct().join(articles.select("id", "title", "published_at"), "id")
    rank = F.row_number().over(Window.partitionBy("canonical_entity_id").orderBy(F.col("published_at").desc_nulls_first(), F.desc("id")))
    return j.withColumn("rank", rank).filter(F.col("rank") <= n)


def entity_report(mentions: DataFrame, articles: DataFrame, needle: str) -> DataFrame:
    """Mentions whose name holds the needle (case does not matter, accents do) with their articles."""
    m = mentions.filter(F.contains(F.lower("name"), F.lit(needle.lower())))
    return m.join(articles.select(F.col("id").alias("article_id"), "title", "source"), "article_id").select("article_id", "source", "title", "name", "type", "sentiment_toward", "sentiment_score")


def with_actor_names(articles: DataFrame, canonical: DataFrame) -> DataFrame:
    """Add the names of the dominant, blamed and credited actors."""
    out = articles
    for actor in ("dominant", "blamed", "credited"):
        c = canonical.select(F.col("id").alias(f"{actor}_actor_id"), F.col("name").alias(f"{actor}_actor"))
        out = out.join(c, f"{actor}_actor_id", "left")
    return out


def article_summary(page: DataFrame, canonical: DataFrame, mentions: DataFrame) -> DataFrame:
    """The rows of a page with actor names and their number of mentions; only the page's mentions are counted."""
    ids = F.broadcast(page.select(F.col("id").alias("article_id")))
    n = mentions.join(ids, "article_id", "left_semi").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("entity_count"))
    return with_actor_names(page, canonical).join(n, "id", "left").withColumn("entity_count", F.coalesce("entity_count", F.lit(0)))


def quota_sample(articles: DataFrame, target: int, cap: int) -> DataFrame:
    """At most cap articles of a source and target in all, oldest first (published_at, id).

    Equal to taking articles in that order and skipping full sources: a skipped
    row never uses up the target.
    """
    order = [F.col("published_at").asc_nulls_last(), F.asc("id")]
    ranked = articles.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")
    return ranked.orderBy(*order).limit(target)


def topic_yield(articles: DataFrame, on_topic: Column, sources: DataFrame) -> DataFrame:
    """(source, n, is_total): articles on the topic for every source, 0 too."""
    n = articles.filter(on_topic).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    each = sources.select("source").distinct().join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))
    return each.rollup("source").agg(F.sum("n").alias("n"), (F.grouping("source") == 1).alias("is_total"))
