"""The press tables as views over the given Parquet tables, for Spark and, as SQL, for DuckDB.

Each view is one declarative expression over `documents`, `events`, `pages` or
`labels`, written once for each engine; queries read them like stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions.text import norm_key

NAME_RUN = r"\p{Lu}\p{Ll}{2,}( \p{Lu}\p{Ll}{2,}){0,3}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARTICLE = """
doc_id AS id, source,
concat('https://www.', source, '.example/', lang, '/', CAST(doc_id AS STRING), CASE doc_id % 7 WHEN 0 THEN '?utm_source=x&b=2&a=1'
  WHEN 1 THEN '/#top' WHEN 2 THEN concat('?id=', CAST(doc_id AS STRING), '&fbclid=z') WHEN 3 THEN '/' ELSE '' END) AS url,
{title} AS title, text AS body,
CASE doc_id % 5 WHEN 0 THEN 'politica' WHEN 1 THEN 'deportes' WHEN 2 THEN 'gente' WHEN 3 THEN '' END AS section,
CASE WHEN doc_id % 41 <> 0 THEN {published} END AS published_at,
CASE doc_id % 4 WHEN 0 THEN 'POS' WHEN 1 THEN 'NEG' WHEN 2 THEN 'NEU' END AS overall_sentiment,
CASE doc_id % 6 WHEN 0 THEN 'episodic' WHEN 1 THEN 'thematic' WHEN 2 THEN 'conflict' END AS framing,
CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_hard_data,
CASE WHEN doc_id % 2 = 0 THEN lang END AS main_topic,
concat(lang, ', ', source) AS topic_keywords,
CAST(CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 3 END AS INT) AS analysis_schema_version,
CAST(doc_id % 9 AS STRING) AS analyzer_version
"""
_ARTICLE_SPARK = _ARTICLE.format(title="substring(split_part(text, '\\n', 1), 1, 120)", published="timestamp_micros(1767225600000000 + doc_id * 2220000000)")
_ARTICLE_DUCK = _ARTICLE.replace("AS STRING", "AS VARCHAR").format(title="substring(split_part(text, chr(10), 1), 1, 120)", published="make_timestamp(1767225600000000 + doc_id * 2220000000)")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_split(_ARTICLE_SPARK))


def _split(select: str) -> list[str]:
    """Cut a select list at its outer commas."""
    out, depth, now, quoted = [], 0, "", False
    for c in select:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def raw_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, name, type): every run of capitalised words."""
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.explode(F.regexp_extract_all("text", F.lit(NAME_RUN), F.lit(0))).alias("name"))
    person = F.contains(F.col("name"), F.lit(" ")) | (F.length("name") % 2 == 0)
    return runs.withColumn("type", F.when(person, "PERSON").otherwise("ORG"))


def counted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, name, type, mentions_count), of which mentions, dimension and aliases are made; a query that needs several of them makes it once."""
    return raw_mentions(spark, sf_dir).groupBy("article_id", "name", "type").agg(F.count(F.lit(1)).alias("mentions_count"))


def mentions(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """Stored mentions: one row per article, name and type."""
    m = counted_mentions(spark, sf_dir) if counted is None else counted
    place = F.row_number().over(Window.partitionBy("article_id").orderBy("name", "type"))
    n = F.length("name") + F.col("article_id")
    return m.select(
        (F.col("article_id") * 100000 + place).alias("id"), "article_id", "name", "type", "mentions_count",
        F.when(n % 4 == 0, "POS").when(n % 4 == 1, "NEG").when(n % 4 == 2, "NEU").alias("sentiment_toward"),
        F.when(n % 4 < 3, (n % 10) / 10.0).alias("sentiment_score"),
        F.when(n % 5 > 0, F.concat(F.lit("sobre "), "name")).alias("context"),
        (F.lit(1.0) - (n % 4) / 10.0).alias("extraction_confidence"),
    )


def canonical(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """A stored dimension: the mention names of even length."""
    names = (raw_mentions(spark, sf_dir) if counted is None else counted).select("name", "type").distinct().filter(F.length("name") % 2 == 0)
    # Ids in the order of (type, name) without one sorted task: places among the names of one beginning, shifted by the earlier beginnings' sizes.
    names = names.withColumn("_head", F.substring("name", 1, 3))
    before = F.sum("n").over(Window.orderBy("_type", "_of").rowsBetween(Window.unboundedPreceding, -1))
    shifts = names.groupBy(F.col("type").alias("_type"), F.col("_head").alias("_of")).agg(F.count(F.lit(1)).alias("n")).select("_type", "_of", F.coalesce(before, F.lit(0)).alias("shift"))
    placed = names.withColumn("place", F.row_number().over(Window.partitionBy("type", "_head").orderBy("name")))
    placed = placed.join(shifts, (F.col("type") == F.col("_type")) & (F.col("_head") == F.col("_of")))
    return placed.select((F.col("shift") + F.col("place")).cast("long").alias("id"), "name", "type")


def aliases(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> DataFrame:
    """The 50 most frequent single-word mentions as aliases of a longer name; every fifth is not active."""
    single = (counted_mentions(spark, sf_dir) if counted is None else counted).filter(~F.contains(F.col("name"), F.lit(" ")))
    single = single.groupBy("name", "type").agg(F.sum("mentions_count").alias("n")).withColumn("alias_key", norm_key(F.col("name")))
    top = single.groupBy("alias_key", "type").agg(F.sum("n").alias("n"), F.min("name").alias("alias")).orderBy(F.desc("n"), "alias_key", "type").limit(50)
    ranked = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "alias_key", "type")).cast("long"))
    return ranked.select("id", "alias", "alias_key", F.concat(F.lit("Casa "), "alias").alias("canonical_name"), "type", (F.col("id") % 5 != 0).alias("is_active"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysis jobs."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.when(kind == 0, "pending").when(kind == 1, "running").when(kind == 2, "done").otherwise("failed").alias("status"),
        at.alias("created_at"), F.timestamp_micros(F.unix_micros(at) + (F.col("value") * 1000000).cast("long")).alias("finished_at"),
        F.when(kind == 1, F.col("event_type")).alias("stage"), F.when(F.col("event_id") % 6 != 0, F.col("props")).alias("result_json"), F.when(kind == 3, F.col("event_type")).alias("error"), F.col("value").alias("seconds"),
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("source"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "value")


def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '\\s+', ' ', 'g'))"


def key_sql(c: str) -> str:
    return fold_sql(f"replace(replace({c}, '-', ' '), '.', '')")


PARTICLES_SQL = "['de','del','la','las','los','y','e','']"


def words_sql(key: str) -> str:
    return f"list_filter(string_split({key}, ' '), lambda w: NOT list_contains({PARTICLES_SQL}, w))"


#: DuckDB text of the views, in an order in which each may use the earlier ones.
SQL = {
    "articles": f"SELECT {_ARTICLE_DUCK} FROM documents",
    "raw_mentions": f"""SELECT article_id, name, CASE WHEN contains(name, ' ') OR length(name) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS type
      FROM (SELECT doc_id AS article_id, unnest(regexp_extract_all(text, '{NAME_RUN}')) AS name FROM documents)""",
    "mentions": """SELECT article_id * 100000 + row_number() OVER (PARTITION BY article_id ORDER BY name, type) AS id, article_id, name, type, mentions_count,
        CASE (length(name) + article_id) % 4 WHEN 0 THEN 'POS' WHEN 1 THEN 'NEG' WHEN 2 THEN 'NEU' END AS sentiment_toward,
        CASE WHEN (length(name) + article_id) % 4 < 3 THEN ((length(name) + article_id) % 10)::DOUBLE / 10.0::DOUBLE END AS sentiment_score,
        CASE WHEN (length(name) + article_id) % 5 > 0 THEN 'sobre ' || name END AS context,
        1.0::DOUBLE - ((length(name) + article_id) % 4)::DOUBLE / 10.0::DOUBLE AS extraction_confidence
      FROM (SELECT article_id, name, type, count(*) AS mentions_count FROM raw_mentions GROUP BY ALL)""",
    "canonical": """SELECT row_number() OVER (ORDER BY type, name) AS id, name, type
      FROM (SELECT DISTINCT name, type FROM raw_mentions WHERE length(name) % 2 = 0)""",
    "aliases": f"""SELECT id, alias, alias_key, 'Casa ' || alias AS canonical_name, type, id % 5 <> 0 AS is_active FROM (
        SELECT row_number() OVER (ORDER BY n DESC, alias_key, type) AS id, * FROM (
          SELECT {key_sql("name")} AS alias_key, type, count(*) AS n, min(name) AS alias FROM raw_mentions WHERE NOT contains(name, ' ') GROUP BY 1, 2)) WHERE id <= 50""",
    "jobs": """SELECT event_id AS id, 'u' || user_id AS url, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
        ts::TIMESTAMP AS created_at, make_timestamp(epoch_us(ts::TIMESTAMP) + trunc(value * 1000000)::BIGINT) AS finished_at,
        CASE WHEN event_id % 4 = 1 THEN event_type END AS stage, CASE WHEN event_id % 6 <> 0 THEN props END AS result_json, CASE WHEN event_id % 4 = 3 THEN event_type END AS error, value AS seconds FROM events""",
    "stage_events": "SELECT 's' || (user_id % 9) AS source, event_type AS stage, ts::TIMESTAMP AS at, event_id AS id, value FROM events",
}
_NEEDS = {"mentions": ["raw_mentions"], "canonical": ["raw_mentions"], "aliases": ["raw_mentions"]}


def _plain_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, sign in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&")):  # the old names count without their semicolon too
        out = f"regexp_replace({out}, '{name}', '{sign}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _without_sql(c: str) -> str:
    for name in ("script", "style", "nav", "aside", "footer", "form", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{name}\\b.*?</{name}\\s*>', ' ', 'g')"
    return f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"


#: read (page_id, url, title, body): what the markup reader finds in `pages`, where dropped elements and comments are closed.
READ_SQL = f"""read AS (SELECT page_id, url, coalesce(nullif({_plain_sql("regexp_extract(main, '(?is)<h1[^>]*>(.*?)</h1', 1)")}, ''), {_plain_sql("regexp_extract(main, '(?is)<title[^>]*>(.*?)</title', 1)")}) AS title,
    array_to_string(list_filter(list_transform(string_split_regex(main, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda x: {_plain_sql("regexp_extract(x, '(?is)^(.*?)(?:</?(?:p|div|article|body|html|h1|ul|table|section)\\b|$)', 1)")}), lambda t: t <> ''), chr(10)) AS body
  FROM (SELECT page_id, url, {_without_sql("html")} AS main FROM pages))"""


def with_views(names: list[str], rest: str) -> str:
    """SQL text with the named views in front; rest starts with further CTEs or with SELECT."""
    wanted = [v for v in SQL if v in names or any(v in _NEEDS.get(n, ()) for n in names)]
    ctes = ", ".join(f"{v} AS ({SQL[v]})" for v in wanted)
    return f"WITH {ctes}{'' if rest.lstrip().upper().startswith('SELECT') else ','} {rest}"
