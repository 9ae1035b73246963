"""Schemas of the stored tables, and reading and writing them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = """id long, source string, url string, title string, authors string, section string, published_at timestamp, scraped_at timestamp, body string,
main_topic string, topic_keywords string, overall_sentiment string, sentiment_score double, framing string, headline_intent string, lead_orientation string,
source_quality string, has_hard_data boolean, sentiment_basis string, facts_sentiment string, quoted_sentiment string, media_stance string,
media_stance_evidence string, overall_sentiment_reason string, content_flags string, analyzer_name string, analyzer_model string, analyzer_version string,
analysis_schema_version int, analyzed_at timestamp, dominant_actor_id long, blamed_actor_id long, credited_actor_id long"""
MENTIONS = "id long, article_id long, name string, type string, mentions_count int, sentiment_toward string, sentiment_score double, context string, extraction_confidence double, canonical_entity_id long"
CANONICAL = "id long, name string, type string, description string, created_at timestamp, updated_at timestamp"
ALIASES = "id long, alias string, alias_key string, canonical_name string, type string, is_active boolean"
JOBS = "id string, url string, status string, stage string, created_at timestamp, started_at timestamp, finished_at timestamp, result_json string, error string"
RUNS = """id long, correlation_id string, started_at timestamp, finished_at timestamp, status string, sources string, analyzer_name string,
articles_discovered int, articles_saved int, articles_failed int, stats_by_source string, error string"""
GOLD = """id string, source string, url string, title string, body string, overall_sentiment string, entities_exhaustive boolean,
entities array<struct<name:string,type:string,sentiment_toward:string>>, framing string, sentiment_basis string, facts_sentiment string,
quoted_sentiment string, media_stance string, content_flags array<string>, notes string"""
SCHEMAS = {"articles": ARTICLES, "entities": MENTIONS, "canonical_entities": CANONICAL, "entity_aliases": ALIASES, "analyze_jobs": JOBS, "crawl_runs": RUNS}


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None, partitions: int = 8) -> DataFrame:
    """A stored table from Parquet, or from a SQL database by JDBC options (url, and what the driver needs).

    A database table with numbers as ids is read in parts of equal spans of
    them, each by its own connection; filters and columns of a query go to the
    database.  The bounds only deal the rows out: none is left out.
    """
    if jdbc is None:
        return spark.read.schema(SCHEMAS[name]).parquet(path)
    source = spark.read.format("jdbc").options(**{"fetchsize": "10000"} | jdbc)
    whole = source.option("dbtable", name).load()
    key = next((f.name for f in whole.schema if f.name.lower() == "id" and f.dataType.typeName() in ("long", "integer")), None)
    if not key:
        return _as_stored(whole, name)
    quoted = f"{spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc['url']).quoteIdentifier(key)}"
    ends = spark.read.format("jdbc").options(**jdbc).option("query", f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {name}").load().first()
    if ends[0] is None or partitions < 2:
        return _as_stored(whole, name)
    parts = {"partitionColumn": key, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(partitions)}
    return _as_stored(spark.read.format("jdbc").options(**{"fetchsize": "10000"} | jdbc | parts).option("dbtable", name).load(), name)


def _as_stored(df: DataFrame, name: str) -> DataFrame:
    """Names as in the schemas; databases may fold them to capitals."""
    return df.select([F.col(f"`{c}`").alias(c.lower()) for c in df.columns]) if name in SCHEMAS else df


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled articles from JSON lines; a broken line is an error, absent fields are NULL."""
    g = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    return g.withColumn("entities_exhaustive", F.coalesce("entities_exhaustive", F.lit(True)))


def scratch_folder(spark: SparkSession) -> str:
    """The folder that all executors share for checkpoints; on one machine, as in tests, a fresh one if none is named."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def once(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared folder, so that a lost executor costs a read and not a second, different answer."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: the smallest by the other columns, in their order."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(*[c if c == key else f"_r.{c}" for c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_new(new: DataFrame, path: str, key: str, partition_by: str | None = None) -> DataFrame:
    """Append the rows of new whose key is not stored, one for each key; returns the rows appended.

    A second call with the same rows appends nothing.  The rows are fixed
    before the write, and nothing stored is touched.
    """
    spark = new.sparkSession
    found = one_of_each(new, key)
    if exists(spark, path):
        found = found.join(spark.read.parquet(path).select(key), key, "left_anti")
    found = once(found)
    writer = found.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return found
