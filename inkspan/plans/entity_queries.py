"""Queries over mentions, resolution, the dimension, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.functions.text import norm_key
from inkspan.operators import evaluate, filters, mentions, reports, resolve, sentiment, verify
from inkspan.plans import views
from inkspan.plans.press_queries import _WHOLE_SENTENCES
from inkspan.plans.views import fold_sql, key_sql, table, with_views, words_sql
from inkspan.sources.tables import once

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored dimension brought up to date with all mentions."""
    return resolve.upsert_canonical(views.mentions(spark, sf_dir), views.canonical(spark, sf_dir))


def linked(spark: SparkSession, sf_dir: str, canonical: DataFrame | None = None) -> DataFrame:
    c = views.canonical(spark, sf_dir) if canonical is None else canonical
    return resolve.link_mentions(views.mentions(spark, sf_dir), c)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, dimension and aliases from one pass over the documents."""
    counted = once(views.counted_mentions(spark, sf_dir))
    return tuple(view(spark, sf_dir, counted) for view in (views.mentions, views.canonical, views.aliases))


def surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.person_map(*stored(spark, sf_dir))


_LINKED = "linked AS (SELECT m.*, c.id AS canonical_entity_id FROM mentions m LEFT JOIN canonical c ON m.name = c.name AND m.type = c.type)"
ALL = ["mentions", "canonical", "aliases"]
_COUNTS = "counts AS (SELECT c.id, c.name, c.type, count(DISTINCT article_id) AS article_count, coalesce(sum(mentions_count), 0)::BIGINT AS mention_count FROM canonical c LEFT JOIN linked l ON l.canonical_entity_id = c.id GROUP BY ALL)"


@query(with_views(ALL, f"{_LINKED}, {_COUNTS} SELECT * FROM counts"))
def canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and mentions of every dimension entity."""
    m, c, _ = stored(spark, sf_dir)
    return reports.canonical_counts(resolve.link_mentions(m, c), c)


@query(with_views(ALL, f"{_LINKED}, {_COUNTS} SELECT * FROM counts WHERE type = 'PERSON' AND regexp_matches(lower(strip_accents(name)), 'ere') ORDER BY article_count DESC, name, id LIMIT 50 OFFSET 5"))
def canonical_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.canonical_counts(linked(spark, sf_dir), views.canonical(spark, sf_dir), kind="PERSON", name="eré")
    return filters.list_canonical(c, limit=50, offset=5)


@query(with_views(ALL, f"{_LINKED} SELECT name, type, count(*) AS n FROM linked GROUP BY ALL ORDER BY n DESC, name, type LIMIT 15"))
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_entities(linked(spark, sf_dir), views.canonical(spark, sf_dir))


@query(with_views(ALL, "SELECT name, type FROM canonical UNION SELECT name, type FROM mentions"))
def upserted_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension after taking in new names; ids are checked to be unique."""
    d = dimension(spark, sf_dir)
    return d.groupBy("id").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("name", "type")


_PERSONS = f"""names AS (SELECT name FROM mentions WHERE type = 'PERSON' UNION SELECT name FROM canonical WHERE type = 'PERSON' UNION SELECT canonical_name FROM aliases WHERE type = 'PERSON' AND is_active),
surnames AS (SELECT surname, min(name) AS full_name FROM (SELECT name, ws[-1] AS surname FROM (SELECT name, {words_sql(key_sql('name'))} AS ws FROM names) WHERE len(ws) >= 2) GROUP BY 1 HAVING count(*) = 1)"""


@query(with_views(ALL, f"{_PERSONS} SELECT * FROM surnames"))
def surname_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last names that belong to one full name only."""
    return surnames(spark, sf_dir)


_RESOLVED = f"""act AS (SELECT alias_key, arg_max(canonical_name, id) AS cn, arg_max(type, id) AS ct FROM aliases WHERE is_active GROUP BY 1),
al AS (SELECT m.* EXCLUDE (name, type), coalesce(cn, m.name) AS name, coalesce(ct, m.type) AS type, m.name AS old_name, m.type AS old_type FROM mentions m LEFT JOIN act ON act.alias_key = {key_sql('m.name')}),
sn AS (SELECT *, CASE WHEN type = 'PERSON' AND len(ws) = 1 THEN ws[1] END AS w FROM (SELECT *, {words_sql(key_sql('name'))} AS ws FROM al)),
res AS (SELECT sn.* EXCLUDE (name, ws, w), CASE WHEN full_name IS NOT NULL AND {key_sql('full_name')} <> {key_sql('name')} THEN full_name ELSE name END AS name FROM sn LEFT JOIN surnames ON surname = w)"""


@query(with_views(ALL, f"{_PERSONS}, {_RESOLVED} SELECT id, name, type FROM res"))
def resolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions after aliases and surnames."""
    m, c, a = stored(spark, sf_dir)
    return resolve.resolve_surnames(resolve.resolve_aliases(m, a), resolve.person_map(m, c, a)).select("id", "name", "type")


@query(with_views(ALL, f"""{_PERSONS}, {_RESOLVED}, k AS (SELECT *, {key_sql('name')} AS key FROM res),
t AS (SELECT *, arg_max(name, id) OVER (PARTITION BY article_id, key, type) AS target FROM k),
k2 AS (SELECT *, first_value(id) OVER (PARTITION BY article_id, key, type ORDER BY (old_name = target AND old_type = type) DESC, CASE WHEN old_name = target AND old_type = type THEN 0 ELSE mentions_count END DESC, id) AS keeper FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id, key, type ORDER BY id <> keeper, id) AS rk FROM k2)
SELECT min(keeper) AS id, article_id, min(target) AS name, type, min(CASE WHEN rk = 1 THEN old_name END) AS old_name, sum(mentions_count)::BIGINT AS mentions_count,
  arg_min(sentiment_toward, rk) FILTER (WHERE sentiment_toward IS NOT NULL) AS sentiment_toward,
  CASE WHEN count(sentiment_toward) > 0 THEN arg_min(sentiment_score, rk) FILTER (WHERE sentiment_toward IS NOT NULL) ELSE arg_max(sentiment_score, rk) END AS sentiment_score,
  arg_min(context, rk) FILTER (WHERE context IS NOT NULL) AS context, count(*) - 1 AS merged FROM r GROUP BY article_id, key, type"""))
def merged_stored_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retroactive merge of stored mentions."""
    m, c, a = stored(spark, sf_dir)
    return resolve.merge_stored_mentions(m, a, resolve.person_map(m, c, a))


def merged_sql(source: str, out: str) -> str:
    """CTEs that merge the variants of a name inside each article: rows from the longest key down meet the heads found so far."""
    return f"""{out}_p AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY name, type, mentions_count, sentiment_toward NULLS FIRST, sentiment_score NULLS FIRST, context NULLS FIRST, extraction_confidence) AS pos
  FROM (SELECT *, {key_sql('name')} AS key FROM {source}) WHERE key <> ''),
{out}_k AS (SELECT *, row_number() OVER (PARTITION BY article_id, type ORDER BY length(key) DESC, mentions_count DESC, pos) AS k, list_distinct({words_sql('key')}) AS ws FROM {out}_p),
{out}_r AS (SELECT article_id, type, k, k AS head, [{{'key': key, 'k': k, 'ws': ws}}] AS heads FROM {out}_k WHERE k = 1
  UNION ALL SELECT article_id, type, k, coalesce(hit, k), CASE WHEN hit IS NULL THEN list_append(heads, {{'key': key, 'k': k, 'ws': ws}}) ELSE heads END FROM (
    SELECT n.article_id, n.type, n.k, n.key, n.ws, r.heads, coalesce(list_filter(r.heads, lambda x: x.key = n.key)[1].k, list_filter(r.heads, lambda x: contains(' ' || x.key || ' ', ' ' || n.key || ' '))[1].k,
      CASE WHEN n.type = 'PERSON' AND len(n.ws) > 1 AND len(list_filter(r.heads, lambda x: list_has_all(x.ws, n.ws) AND len(x.ws) > len(n.ws))) = 1
        THEN list_filter(r.heads, lambda x: list_has_all(x.ws, n.ws) AND len(x.ws) > len(n.ws))[1].k END) AS hit
    FROM {out}_r r JOIN {out}_k n ON n.article_id = r.article_id AND n.type = r.type AND n.k = r.k + 1)),
{out} AS (SELECT article_id, arg_min(name, k) AS name, type, sum(mentions_count)::BIGINT AS mentions_count, arg_min(sentiment_toward, k) AS sentiment_toward,
  coalesce(arg_min({{'s': sentiment_score}}, k) FILTER (WHERE sentiment_toward IS NOT NULL), arg_min({{'s': sentiment_score}}, k)).s AS sentiment_score, arg_min(context, k) AS context, max(extraction_confidence) AS extraction_confidence
  FROM {out}_k JOIN (SELECT article_id, type, k, head FROM {out}_r) USING (article_id, type, k) GROUP BY article_id, type, head)"""


_FIRST = "split_part(name, ' ', 1)"
_CANONICAL = f"""titled AS (SELECT * REPLACE (CASE WHEN type = 'PERSON' AND contains(name, ' ') AND list_contains({text.TITLES}, lower(strip_accents({_FIRST}))) THEN substring(name, length({_FIRST}) + 2) ELSE name END AS name) FROM mentions),
act AS (SELECT alias_key, arg_max(canonical_name, id) AS cn, arg_max(type, id) AS ct FROM aliases WHERE is_active GROUP BY 1),
ali AS (SELECT m.* REPLACE (coalesce(cn, m.name) AS name, coalesce(ct, m.type) AS type) FROM titled m LEFT JOIN act ON act.alias_key = {key_sql('m.name')}),
{merged_sql('ali', 'once')}, sur AS (SELECT *, CASE WHEN type = 'PERSON' AND len(ws) = 1 THEN ws[1] END AS w FROM (SELECT *, {words_sql(key_sql('name'))} AS ws FROM once)),
nam AS (SELECT sur.* REPLACE (CASE WHEN full_name IS NOT NULL AND {key_sql('full_name')} <> {key_sql('name')} THEN full_name ELSE name END AS name) FROM sur LEFT JOIN surnames ON surname = w),
{merged_sql('nam', 'twice')}"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_views(ALL, f"{_PERSONS}, {_CANONICAL} SELECT * FROM twice")))
def canonicalized_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, aliases, merge, surnames, merge: greedy inside each article."""
    m, c, a = stored(spark, sf_dir)
    return resolve.canonicalize(m, a, resolve.person_map(m, c, a))


@query(with_views(ALL, "SELECT article_id, sum(mentions_count)::BIGINT AS mentions FROM mentions WHERE type = 'ORG' GROUP BY 1"))
def merged_org_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The in-article merge keeps every mention: sums by article before and after are equal."""
    m = resolve.merge_duplicates(views.mentions(spark, sf_dir).filter("type = 'ORG'"))
    return m.groupBy("article_id").agg(F.sum("mentions_count").alias("mentions"))


_PLACED = f"""placed AS (SELECT article_id, name, pos - 1 AS pos, CASE WHEN contains(name, ' ') OR length(name) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS type FROM (
  SELECT doc_id AS article_id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{views.NAME_RUN}') AS l FROM documents)))"""


_JOINED = f"""{_PLACED}, grp AS (SELECT article_id, {key_sql('name')} AS key, type, count(*) AS count, min(pos) AS ord FROM placed GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY article_id, type ORDER BY length(key) DESC, ord) AS k FROM grp WHERE key <> ''),
r AS (SELECT article_id, type, k, key AS head, [key] AS heads FROM n WHERE k = 1
  UNION ALL SELECT article_id, type, k, coalesce(hit, key), CASE WHEN hit IS NULL THEN list_append(heads, key) ELSE heads END FROM (SELECT n.article_id, n.type, n.k, n.key, r.heads, list_filter(r.heads, lambda x: contains(' ' || x || ' ', ' ' || n.key || ' ')
    OR (regexp_full_match(n.key, '\\p{{L}}{{2,6}}') AND n.key = array_to_string(list_transform({words_sql('x')}, lambda w: w[1]), '')))[1] AS hit FROM r JOIN n ON n.article_id = r.article_id AND n.type = r.type AND n.k = r.k + 1)),
joined AS (SELECT article_id, key, type, count, ord, head AS head_key FROM n JOIN r USING (article_id, type, k))"""


@query(f"""WITH RECURSIVE {_JOINED}, v AS (SELECT p.article_id, head_key AS key, p.type, name, count(*) AS n, min(pos) AS fp, list(pos) AS spots FROM placed p JOIN joined j ON j.article_id = p.article_id AND j.type = p.type AND j.key = {key_sql('name')} GROUP BY ALL)
SELECT article_id, key, type, arg_max(name, (len({words_sql(key_sql('name'))}) * 100000 + n) * 100000 - fp) AS name, sum(n)::BIGINT AS count, array_to_string(list_sort(flatten(list(spots))), ',') AS places FROM v GROUP BY ALL""")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of mentions after the merge: their names, counts and places."""
    g = resolve.merge_groups(mentions.group_mentions(_placed(spark, sf_dir)))
    return g.select("article_id", "key", "type", "name", "count", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


@query(f"WITH RECURSIVE {_JOINED} SELECT * FROM joined")
def merged_mention_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names and acronyms joined to the longer names of their article."""
    g = mentions.group_mentions(_placed(spark, sf_dir))
    return resolve.merge_mention_groups(g.select("article_id", "key", "type", "count", F.col("variants")[0]["first_pos"].alias("ord")))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.posexplode(F.regexp_extract_all("text", F.lit(views.NAME_RUN), F.lit(0))).alias("pos", "name"))
    person = F.contains(F.col("name"), F.lit(" ")) | (F.length("name") % 2 == 0)
    return runs.withColumn("type", F.when(person, "PERSON").otherwise("ORG"))


@query(f"""WITH {_PLACED}, v AS (SELECT article_id, {key_sql('name')} AS key, type, name, count(*) AS n, min(pos) AS fp FROM placed GROUP BY ALL)
SELECT article_id, key, type, arg_max(name, (len({words_sql(key_sql('name'))}) * 100000 + n) * 100000 - fp) AS name, sum(n)::BIGINT AS count FROM v GROUP BY ALL""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling shown for each group of mentions."""
    g = mentions.group_mentions(_placed(spark, sf_dir))
    v = g.select("article_id", "key", "type", F.explode("variants").alias("v")).select("article_id", "key", "type", "v.*")
    return mentions.display_name(v, "article_id", "key", "type")


@query(with_views(ALL, f"""act AS (SELECT alias_key AS a_key, canonical_name, type FROM aliases WHERE is_active), {_PLACED},
n AS (SELECT article_id, coalesce(canonical_name, name) AS name, p.type FROM placed p LEFT JOIN act ON a_key = {key_sql('name')} AND act.type = p.type)
SELECT article_id, {key_sql('name')} AS key, type, count(*) AS count FROM n GROUP BY ALL"""))
def grouped_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mentions by key with aliases applied."""
    return mentions.group_mentions(_placed(spark, sf_dir), views.aliases(spark, sf_dir)).select("article_id", "key", "type", "count")


@query(with_views(ALL, """SELECT id, row_number() OVER (PARTITION BY article_id ORDER BY mentions_count DESC, name, type) AS rank FROM mentions"""))
def ranked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.ranked_mentions(views.mentions(spark, sf_dir)).select("id", "rank")


@query(with_views(ALL, f"""SELECT article_id, name, CASE WHEN {key_sql('name')} IN ('the', 'les') THEN 'ORG' ELSE type END AS type FROM raw_mentions
WHERE length(name) >= 3 AND NOT ({key_sql('name')} IN ('foto', 'video', 'listín', 'listin', 'diario', 'libre')) AND NOT (type = 'PERSON' AND {key_sql('name')} IN ('der', 'erer')) AND NOT (type = 'ORG' AND {key_sql('name')} IN ('ist', 'eaoning'))
AND ({key_sql('name')} IN ('the', 'les') OR NOT list_contains({views.PARTICLES_SQL}, string_split({key_sql('name')}, ' ')[-1]))"""))
def clean_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mentions without the spans that are no names."""
    return filters.clean_mentions(views.raw_mentions(spark, sf_dir), provinces=["der", "erer"], generic=["ist", "eaoning"], brands=["the", "les"]).select("article_id", "name", "type")


@query(with_views(ALL, "SELECT id, extraction_confidence FROM mentions WHERE extraction_confidence < 0.9"))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.review_queue(views.mentions(spark, sf_dir)).select("id", "extraction_confidence")


@query(with_views(ALL, "SELECT id FROM mentions WHERE type = 'PERSON' AND len(list_intersect(list_transform(regexp_split_to_array(lower(strip_accents(context)), '\\s+'), lambda w: trim(w, '.,;:()\"''')), ['des', 'eran', 'con'])) > 0"))
def ambiguous_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.ambiguous_persons(views.mentions(spark, sf_dir), venue_words=["des", "eran", "con"]).select("id")


_ACTORS = "SELECT *, CASE WHEN id % 3 = 0 THEN id % 50 + 1 END AS dominant_actor_id, CASE WHEN id % 4 = 0 THEN id % 70 + 1 END AS blamed_actor_id, CASE WHEN id % 5 = 0 THEN id % 90 + 1 END AS credited_actor_id FROM articles"


def _with_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return views.articles(spark, sf_dir).withColumns({"dominant_actor_id": F.when(i % 3 == 0, i % 50 + 1), "blamed_actor_id": F.when(i % 4 == 0, i % 70 + 1), "credited_actor_id": F.when(i % 5 == 0, i % 90 + 1)})


@query(with_views(["articles", *ALL], f"""{_LINKED}, act AS ({_ACTORS}), b AS (SELECT 'article_url' AS rule, count(*) AS n FROM (SELECT url FROM articles GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'mention', count(*) FROM (SELECT 1 FROM raw_mentions GROUP BY article_id, name, type HAVING count(*) > 1)
UNION ALL SELECT 'canonical', count(*) FROM (SELECT 1 FROM canonical GROUP BY name, type HAVING count(*) > 1)
UNION ALL SELECT 'alias', count(*) FROM (SELECT 1 FROM aliases GROUP BY alias_key, type HAVING count(*) > 1)
UNION ALL SELECT 'orphan_mention', count(*) FROM raw_mentions WHERE article_id % 13 = 0
UNION ALL SELECT 'orphan_dominant_actor', count(*) FROM act LEFT JOIN canonical c ON c.id = dominant_actor_id WHERE dominant_actor_id IS NOT NULL AND c.id IS NULL
UNION ALL SELECT 'orphan_blamed_actor', count(*) FROM act LEFT JOIN canonical c ON c.id = blamed_actor_id WHERE blamed_actor_id IS NOT NULL AND c.id IS NULL
UNION ALL SELECT 'orphan_credited_actor', count(*) FROM act LEFT JOIN canonical c ON c.id = credited_actor_id WHERE credited_actor_id IS NOT NULL AND c.id IS NULL) SELECT * FROM b"""))
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken keys among raw mentions, and mentions of articles that are gone."""
    a = _with_actors(spark, sf_dir)
    out = filters.audit_constraints(a, views.raw_mentions(spark, sf_dir), views.canonical(spark, sf_dir), views.aliases(spark, sf_dir))
    orphans = filters.audit_constraints(a.filter("id % 13 <> 0"), views.raw_mentions(spark, sf_dir), views.canonical(spark, sf_dir), views.aliases(spark, sf_dir))
    return out.filter("rule <> 'orphan_mention'").unionByName(orphans.filter("rule = 'orphan_mention'"))


@query(with_views(["articles", *ALL], "SELECT article_id, source, title, name, type, sentiment_toward, sentiment_score FROM mentions JOIN articles ON articles.id = article_id WHERE contains(lower(name), 'tion')"))
def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.entity_report(views.mentions(spark, sf_dir), views.articles(spark, sf_dir), "Tion")


@query(with_views(["articles", *ALL], f"""act AS ({_ACTORS}), page AS (SELECT * FROM act ORDER BY published_at DESC NULLS FIRST, id DESC LIMIT 50)
SELECT p.id, d.name AS dominant_actor, b.name AS blamed_actor, c.name AS credited_actor, (SELECT count(*) FROM mentions m WHERE m.article_id = p.id) AS entity_count
FROM page p LEFT JOIN canonical d ON d.id = dominant_actor_id LEFT JOIN canonical b ON b.id = blamed_actor_id LEFT JOIN canonical c ON c.id = credited_actor_id"""))
def article_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of articles with actor names and mention counts."""
    page, _ = filters.list_articles(_with_actors(spark, sf_dir), limit=50)
    return reports.article_summary(page, views.canonical(spark, sf_dir), views.mentions(spark, sf_dir)).select("id", "dominant_actor", "blamed_actor", "credited_actor", "entity_count")


@query(with_views(["articles", *ALL], "SELECT a.id, count(m.id) AS entity_count FROM articles a LEFT JOIN mentions m ON m.article_id = a.id GROUP BY 1"))
def entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.entity_count(views.articles(spark, sf_dir), views.mentions(spark, sf_dir))


@query(with_views(["articles", *ALL], f"""{_LINKED}, j AS (SELECT DISTINCT canonical_entity_id, article_id AS id FROM linked WHERE canonical_entity_id IS NOT NULL)
SELECT canonical_entity_id, j.id, row_number() OVER (PARTITION BY canonical_entity_id ORDER BY published_at DESC NULLS FIRST, j.id DESC) AS rank FROM j JOIN articles a ON a.id = j.id QUALIFY rank <= 5"""))
def entity_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest articles of each entity."""
    return reports.entity_articles(linked(spark, sf_dir), views.articles(spark, sf_dir), n=5).select("canonical_entity_id", "id", "rank")


@query(with_views(ALL, f"""{_LINKED}, w AS (SELECT canonical_entity_id, sentiment_toward AS s, greatest(1, mentions_count) * coalesce(sentiment_score, 0.5) AS w FROM linked WHERE sentiment_toward IS NOT NULL AND canonical_entity_id IS NOT NULL),
g AS (SELECT canonical_entity_id, round(coalesce(sum(w) FILTER (WHERE s = 'POS'), 0), 9) AS pos, round(coalesce(sum(w) FILTER (WHERE s = 'NEG'), 0), 9) AS neg, round(coalesce(sum(w) FILTER (WHERE s = 'NEU'), 0), 9) AS neu, count(*) AS sample_size FROM w GROUP BY 1)
SELECT canonical_entity_id, CASE WHEN pos + neg + neu > 0 THEN round(100 * pos / (pos + neg + neu), 4) END AS pos_pct, CASE WHEN pos + neg + neu > 0 THEN round(100 * neg / (pos + neg + neu), 4) END AS neg_pct,
CASE WHEN pos + neg + neu > 0 THEN round(100 * neu / (pos + neg + neu), 4) END AS neu_pct, CASE WHEN pos + neg + neu > 0 THEN round((pos - neg) / (pos + neg + neu), 4) END AS score,
CASE WHEN pos + neg + neu > 0 THEN CASE WHEN pos >= neg AND pos >= neu THEN 'POS' WHEN neg >= neu THEN 'NEG' ELSE 'NEU' END END AS dominant, sample_size, sample_size < 5 AS low_sample FROM g"""))
def entity_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sentiment of each dimension entity."""
    return sentiment.entity_sentiment(linked(spark, sf_dir).filter("canonical_entity_id IS NOT NULL"), "canonical_entity_id")


@query(with_views(ALL, "SELECT id, alias, canonical_name FROM aliases WHERE regexp_matches(lower(strip_accents(alias)), 'e') OR regexp_matches(lower(strip_accents(canonical_name)), 'e') ORDER BY alias, id LIMIT 100"))
def alias_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.list_aliases(views.aliases(spark, sf_dir), q="é").select("id", "alias", "canonical_name")


@query(with_views(ALL, f"""s AS (SELECT {key_sql('name')} AS alias_key, min(name) AS alias FROM raw_mentions WHERE NOT contains(name, ' ') GROUP BY 1)
SELECT alias_key, alias FROM s WHERE alias_key NOT IN (SELECT alias_key FROM aliases)"""))
def seeded_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows whose key is new, the first of each key."""
    names = views.raw_mentions(spark, sf_dir).filter(~F.contains(F.col("name"), F.lit(" "))).select(F.col("name").alias("alias"), F.col("name").alias("ord"), F.concat(F.lit("C "), "name").alias("canonical_name"), "type").distinct()
    return resolve.seed_aliases(views.aliases(spark, sf_dir), names).select("alias_key", "alias")


def _actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each article the first word of its last mention."""
    m = views.mentions(spark, sf_dir).groupBy("article_id").agg(F.max("name").alias("name"))
    return m.select("article_id", F.lower(F.substring_index("name", " ", 1)).alias("actor"))


_ACTOR = "actors AS (SELECT article_id, lower(string_split(max(name), ' ')[1]) AS actor FROM mentions GROUP BY 1)"


@query(with_views(ALL, f"""{_ACTOR}, act AS (SELECT alias_key AS a_key, arg_max(canonical_name, id) AS cn FROM aliases WHERE is_active GROUP BY 1),
n AS (SELECT article_id, actor, coalesce(cn, actor) AS name FROM actors LEFT JOIN act ON a_key = {key_sql('actor')}),
h AS (SELECT n.article_id, n.actor, n.name, m.name AS hit, mentions_count FROM n LEFT JOIN mentions m ON m.article_id = n.article_id AND contains(' ' || {key_sql('m.name')} || ' ', ' ' || {key_sql('n.name')} || ' ')),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY mentions_count DESC NULLS LAST, hit) AS k FROM h) SELECT article_id, actor, coalesce(hit, name) AS matched FROM r WHERE k = 1"""))
def matched_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors re-pointed to the entities of their articles."""
    return resolve.match_actors(_actors(spark, sf_dir), views.mentions(spark, sf_dir), views.aliases(spark, sf_dir))


@query(with_views(ALL, f"{_LINKED}, actors AS (SELECT article_id, max(name) AS actor FROM mentions GROUP BY 1) SELECT a.article_id, a.actor, min(canonical_entity_id) AS canonical_entity_id FROM actors a LEFT JOIN linked l ON l.article_id = a.article_id AND l.name = a.actor GROUP BY 1, 2"))
def actor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.mentions(spark, sf_dir).groupBy("article_id").agg(F.max("name").alias("actor"))
    return resolve.resolve_actor_ids(a, linked(spark, sf_dir))


@query(with_views(ALL, f"""{_LINKED}, actors AS (SELECT article_id, max(name) || '.' AS actor FROM mentions GROUP BY 1),
r AS (SELECT a.article_id, a.actor, l.canonical_entity_id, row_number() OVER (PARTITION BY a.article_id ORDER BY l.id) AS k FROM actors a LEFT JOIN linked l ON l.article_id = a.article_id AND {key_sql('l.name')} = {key_sql('a.actor')})
SELECT article_id, actor, canonical_entity_id FROM r WHERE k = 1"""))
def rectified_actor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors that people typed, by key."""
    a = views.mentions(spark, sf_dir).groupBy("article_id").agg(F.concat(F.max("name"), F.lit(".")).alias("actor"))
    return resolve.rectify_actor_ids(a, linked(spark, sf_dir), views.canonical(spark, sf_dir))


def matched_sql(actors: str, source: str, out: str) -> str:
    """CTE of (article_id, actor, matched): actors by the aliases act, then the first mention of source whose key is or holds theirs."""
    return f"""{out} AS (SELECT article_id, actor, coalesce(hit, name) AS matched FROM (SELECT *, row_number() OVER (PARTITION BY article_id, actor ORDER BY mentions_count DESC NULLS LAST, hit) AS place FROM (
  SELECT a.article_id, a.actor, a.name, m.name AS hit, m.mentions_count FROM (SELECT article_id, actor, coalesce(cn, actor) AS name FROM {actors} LEFT JOIN act ON act.alias_key = {key_sql('actor')}) a
  LEFT JOIN {source} m ON m.article_id = a.article_id AND contains(' ' || {key_sql('m.name')} || ' ', ' ' || {key_sql('a.name')} || ' '))) WHERE place = 1)"""


@query(recursive(with_views(ALL, f"""{_PERSONS}, {_CANONICAL}, named AS (SELECT article_id, max(name) AS dom, min(string_split(name, ' ')[1]) AS bla FROM mentions GROUP BY 1),
each_actor AS (SELECT article_id, dom AS actor FROM named UNION SELECT article_id, bla FROM named), {matched_sql('each_actor', 'twice', 'hits')}
SELECT n.article_id, d.matched AS dominant_actor, b.matched AS blamed_actor, NULL::VARCHAR AS credited_actor FROM named n JOIN hits d ON d.article_id = n.article_id AND d.actor = dom JOIN hits b ON b.article_id = n.article_id AND b.actor = bla""")))
def canonicalized_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actors of whole analyses, re-pointed to the canonical mentions of their articles."""
    m, c, a = stored(spark, sf_dir)
    named = m.groupBy("article_id").agg(F.max("name").alias("dominant_actor"), F.min(F.substring_index("name", " ", 1)).alias("blamed_actor"), F.lit(None).cast("string").alias("credited_actor"))
    return resolve.canonicalize_result(named, m, a, resolve.person_map(m, c, a))[1]


_PAIRS = "pairs AS (SELECT id AS source_id, CASE id % 4 WHEN 0 THEN id WHEN 1 THEN id + 1 WHEN 2 THEN -id ELSE (SELECT max(id) FROM canonical) - id + 1 END AS target_id FROM canonical), kinds AS (SELECT p.*, s.type AS st, t.type AS tt FROM pairs p LEFT JOIN canonical s ON s.id = source_id LEFT JOIN canonical t ON t.id = target_id), judged AS (SELECT *, CASE WHEN source_id = target_id THEN 'self' WHEN st IS NULL OR tt IS NULL THEN 'missing' WHEN st <> tt THEN 'type' END AS reason FROM kinds)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.canonical(spark, sf_dir)
    top = c.agg(F.max("id").alias("top"))
    i = F.col("id")
    target = F.when(i % 4 == 0, i).when(i % 4 == 1, i + 1).when(i % 4 == 2, -i).otherwise(F.col("top") - i + 1)
    return c.crossJoin(F.broadcast(top)).select(i.alias("source_id"), target.alias("target_id"))


@query(with_views(ALL, f"{_LINKED}, {_PAIRS} SELECT l.id, coalesce(j.target_id, l.canonical_entity_id) AS canonical_entity_id FROM linked l LEFT JOIN judged j ON j.source_id = l.canonical_entity_id AND j.reason IS NULL"))
def merged_dimension_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions after dimension rows were merged."""
    m, _, _ = resolve.merge_canonical(linked(spark, sf_dir), views.canonical(spark, sf_dir), _pairs(spark, sf_dir))
    return m.select("id", "canonical_entity_id")


@query(with_views(ALL, f"{_PAIRS} SELECT source_id, target_id, reason FROM judged WHERE reason IS NOT NULL"))
def rejected_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_canonical(linked(spark, sf_dir), views.canonical(spark, sf_dir), _pairs(spark, sf_dir))[2]


_CATALOGUE = f"catalogue AS (SELECT alias_key, canonical_name AS name, type FROM aliases UNION ALL SELECT {key_sql('name')}, name, type FROM canonical)"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias catalogue and the names of the dimension."""
    c = views.canonical(spark, sf_dir)
    return views.aliases(spark, sf_dir).select("alias_key", "canonical_name", "type").union(c.select(norm_key(F.col("name")), "name", "type"))


@query(with_views(["articles", "aliases", "canonical"], f"""{_WHOLE_SENTENCES}, {_CATALOGUE},
w AS (SELECT article_id, idx, string_split({key_sql("regexp_replace(text, '[^\\p{L}\\p{N}\\s.\\-]', ' ', 'g')")}, ' ') AS w FROM sentences),
lengths AS (SELECT DISTINCT len(string_split(alias_key, ' ')) AS n FROM catalogue WHERE alias_key <> ''),
runs AS (SELECT article_id, idx, p AS word_pos, array_to_string(w[p:p + n - 1], ' ') AS alias_key FROM (SELECT article_id, idx, w, unnest(range(1, len(w) + 1)) AS p FROM w), lengths WHERE p + n - 1 <= len(w))
SELECT article_id, idx, word_pos::INT AS word_pos, name, type FROM runs JOIN catalogue USING (alias_key) WHERE alias_key <> ''"""))
def dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue names of any number of words, found in all sentences of every article."""
    s = sentiment.sentences(views.articles(spark, sf_dir), most=None, chars=None)
    return mentions.dictionary_mentions(s, _catalogue(spark, sf_dir), most_words=None)


def _llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as an engine would return them: every fifth name is altered."""
    m = views.mentions(spark, sf_dir)
    return m.withColumn("name", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit(" Zzyx"))).when(F.col("id") % 5 == 1, F.concat(F.lit("Zzyx"), "name")).otherwise(F.col("name")))


_TRACES = f"""llm AS (SELECT * EXCLUDE (name), CASE id % 5 WHEN 0 THEN name || ' Zzyx' WHEN 1 THEN 'Zzyx' || name ELSE name END AS name FROM mentions),
txt AS (SELECT id AS article_id, ' ' || regexp_replace({fold_sql("title || '. ' || body")}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]', '  ', 'g') || ' ' AS t FROM articles),
tr AS (SELECT llm.*, (length(t) - length(replace(t, ' ' || replace({fold_sql('llm.name')}, ' ', '  ') || ' ', ''))) / (length({fold_sql('llm.name')}) + len(string_split({fold_sql('llm.name')}, ' ')) + 1) AS whole,
  list_filter(string_split({fold_sql('llm.name')}, ' '), lambda w: NOT list_contains({views.PARTICLES_SQL}, w)) AS ws, t FROM llm JOIN txt USING (article_id)),
ok AS (SELECT *, len(list_filter(ws, lambda w: contains(t, ' ' || w || ' '))) > 0 AS traced FROM tr WHERE len(ws) > 0)"""


@query(with_views(["articles", *ALL], f"{_TRACES} SELECT id, round(CASE WHEN whole > 0 THEN extraction_confidence ELSE least(extraction_confidence, 0.6) END, 4) AS extraction_confidence FROM ok WHERE whole > 0 OR traced"))
def verified_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with a trace in their text."""
    out = verify.verify_entities(_llm(spark, sf_dir), views.articles(spark, sf_dir))
    return out.select("id", F.round("extraction_confidence", 4).alias("extraction_confidence"))


_RECOUNTED = """rc AS (SELECT *, CASE WHEN len(ws) > 0 AND c > 0 THEN c::BIGINT ELSE mentions_count END AS counted FROM (SELECT *, CASE WHEN type = 'PERSON' AND len(ws) >= 2 THEN last ELSE whole END AS c
  FROM (SELECT *, (length(t) - length(replace(t, ' ' || ws[-1] || ' ', ''))) / (length(ws[-1]) + 2) AS last FROM tr)))"""


@query(with_views(["articles", *ALL], f"{_TRACES}, {_RECOUNTED} SELECT id, counted AS mentions_count FROM rc"))
def recounted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention counts taken from the text."""
    return verify.recount_mentions(_llm(spark, sf_dir), views.articles(spark, sf_dir)).select("id", "mentions_count")


_MAPPED = """mapped AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY mentions_count DESC, name, type) AS rank FROM (
SELECT article_id, name, type, counted AS mentions_count, coalesce(sentiment_toward, 'NEU') AS sentiment_toward, round(coalesce(sentiment_score, 0.0), 2) AS sentiment_score,
coalesce(context, '') || ' [ok]' AS context, round(CASE WHEN whole > 0 THEN extraction_confidence ELSE least(extraction_confidence, 0.6) END, 2) AS extraction_confidence
FROM rc WHERE len(ws) > 0 AND (whole > 0 OR len(list_filter(ws, lambda w: contains(t, ' ' || w || ' '))) > 0)))"""


def _engine_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, entities) as an engine would return them, in the order of the names."""
    entity = F.struct("name", "type", F.col("mentions_count").cast("int").alias("mentions_count"), F.lower("sentiment_toward").alias("sentiment_toward"), F.col("sentiment_score").alias("sentiment_confidence"), "context", F.col("extraction_confidence").alias("confidence"), F.lit("ok").alias("confidence_reason"))
    return _llm(spark, sf_dir).groupBy("article_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))


@query(with_views(["articles", *ALL], f"{_TRACES}, {_RECOUNTED}, {_MAPPED} SELECT * FROM mapped"))
def mapped_llm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine output in JSON to mention rows, ranked by mentions."""
    js = _engine_entities(spark, sf_dir).select("article_id", F.to_json(F.struct("entities")).alias("result_json"))
    return verify.map_llm_results(js, views.articles(spark, sf_dir))


def _engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole results in JSON; those of every thirteenth article are cut off."""
    a, i = views.articles(spark, sf_dir), F.col("id")
    blank = lambda c: F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    fields = a.select(
        i.alias("article_id"), blank("main_topic").alias("main_topic"), F.array(F.lit(" "), F.col("source"), F.lit(" x ")).alias("topic_keywords"), F.lower("overall_sentiment").alias("overall_sentiment"),
        "framing", "has_hard_data", blank("section").alias("dominant_actor"), F.lit("neutral").alias("quoted_sentiment"), F.array(F.lit("b"), F.col("source"), F.lit("b"), F.lit("a")).alias("content_flags"),
    )
    j = fields.join(_engine_entities(spark, sf_dir), "article_id", "left")
    whole = F.to_json(F.struct(*[c for c in j.columns if c != "article_id"]))
    return j.select("article_id", F.when(F.col("article_id") % 13 == 5, F.substring(whole, 1, 30)).otherwise(whole).alias("result_json"))


@query(with_views(["articles", *ALL], f"""{_TRACES}, {_RECOUNTED}, {_MAPPED}, e AS (SELECT article_id, string_agg(name || ':' || mentions_count, ';' ORDER BY rank) AS listed FROM mapped GROUP BY 1)
SELECT id AS article_id, main_topic, nullif(section, '') AS dominant_actor, coalesce(overall_sentiment, 'NEU') AS overall_sentiment, 'NEU' AS quoted_sentiment, framing, has_hard_data, source || ',x' AS keywords, 'b,' || source || ',a' AS flags, coalesce(listed, '') AS listed
FROM articles LEFT JOIN e ON e.article_id = id WHERE id % 13 <> 5"""))
def whole_llm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine results with all their fields, and entities in the order of their mentions."""
    w = verify.whole_results(_engine_results(spark, sf_dir), views.articles(spark, sf_dir))
    listed = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["name"], x["mentions_count"].cast("string"))), ";")
    return w.select("article_id", "main_topic", "dominant_actor", "overall_sentiment", "quoted_sentiment", "framing", "has_hard_data", F.array_join("topic_keywords", ",").alias("keywords"), F.array_join("content_flags", ",").alias("flags"), listed.alias("listed"))


@query(with_views(["articles"], "SELECT id AS article_id, true AS cut_off FROM articles WHERE id % 13 = 5"))
def broken_llm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that cannot be read, kept apart."""
    return verify.broken_results(_engine_results(spark, sf_dir)).select("article_id", (F.length("result_json") == 30).alias("cut_off"))


@query(with_views(ALL, "SELECT id FROM mentions WHERE NOT (id % 7 = 3 AND (id // 7) % 2 = 1)"))
def judged_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that the last verdict keeps; those without one stay."""
    m = views.mentions(spark, sf_dir)
    v = m.filter("id % 7 IN (2, 3)").select(F.col("id").alias("mention_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).withColumn("keep", F.when(F.col("ord") == 1, F.col("mention_id") % 2 == 0).otherwise((F.col("mention_id") % 7 == 2) | (F.floor(F.col("mention_id") / 7) % 2 == 0)))
    return verify.apply_verdicts(m, v).select("id")


@query(with_views(["articles"], "SELECT id AS article_id, CASE WHEN id % 4 = 0 THEN 'small' WHEN id % 3 = 0 THEN 'middle' ELSE 'large' END AS analyzer_name FROM articles"))
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine with a result."""
    a = views.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "overall_sentiment")
    return verify.coalesce_engines([("small", a.filter("article_id % 4 = 0")), ("middle", a.filter("article_id % 3 = 0")), ("large", a)]).select("article_id", "analyzer_name")


@query(with_views(["articles"], "SELECT id AS article_id, main_topic, topic_keywords, framing FROM articles"))
def hybrid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.articles(spark, sf_dir).withColumn("article_id", F.col("id"))
    rest = a.select("article_id", F.lit("x").alias("main_topic"), F.lit("y").alias("topic_keywords"), "framing")
    return verify.hybrid_result(a, rest).select("article_id", "main_topic", "topic_keywords", "framing")


def _gold_and_pred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mentions of labelled documents as gold; a deterministic change of them as predictions."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"))
    m = views.mentions(spark, sf_dir).join(ids, "article_id", "left_semi").withColumn("ord", F.col("id"))
    pred = m.filter("id % 9 <> 0").withColumn("name", F.when(F.col("id") % 11 == 0, F.concat("name", F.lit(" Extra"))).when(F.col("id") % 13 == 0, F.concat("name", F.lit("zzq"))).otherwise(F.col("name")))
    return m, pred.withColumn("sentiment_toward", F.when(F.col("id") % 4 == 0, "NEU").otherwise(F.col("sentiment_toward")))


_GOLD = f"""gold AS (SELECT *, {key_sql('name')} AS key, row_number() OVER (PARTITION BY article_id ORDER BY id) AS k FROM mentions WHERE article_id IN (SELECT doc_id FROM labels)),
pred AS (SELECT id, article_id, type, {key_sql("CASE WHEN id % 11 = 0 THEN name || ' Extra' WHEN id % 13 = 0 THEN name || 'zzq' ELSE name END")} AS key, CASE WHEN id % 4 = 0 THEN 'NEU' ELSE sentiment_toward END AS s FROM gold WHERE id % 9 <> 0),
fits AS (SELECT g.article_id, g.k, coalesce(list(p.id ORDER BY p.id) FILTER (WHERE p.id IS NOT NULL), []) AS can FROM gold g LEFT JOIN pred p ON p.article_id = g.article_id AND p.type = g.type AND p.key <> '' AND g.key <> ''
  AND (contains(' ' || p.key || ' ', ' ' || g.key || ' ') OR contains(' ' || g.key || ' ', ' ' || p.key || ' ')) GROUP BY ALL),
greedy AS (SELECT article_id, k, can[1] AS hit, [can[1]] AS used FROM fits WHERE k = 1
  UNION ALL SELECT f.article_id, f.k, list_filter(f.can, lambda x: NOT list_contains(r.used, x))[1], list_append(r.used, list_filter(f.can, lambda x: NOT list_contains(r.used, x))[1]) FROM greedy r JOIN fits f ON f.article_id = r.article_id AND f.k = r.k + 1),
pairs AS (SELECT g.article_id, g.type, g.sentiment_toward AS gs, p.s AS ps, p.id IS NOT NULL AS tp, p.id IS NULL AS fn, false AS fp FROM gold g JOIN greedy USING (article_id, k) LEFT JOIN pred p ON p.id = hit
  UNION ALL SELECT article_id, type, NULL, s, false, false, true FROM pred WHERE id NOT IN (SELECT hit FROM greedy WHERE hit IS NOT NULL)),
whole AS (SELECT DISTINCT doc_id AS article_id, quality = 1 AS exhaustive FROM labels),
counted AS (SELECT type, grouping(type) = 1 AS overall, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE fp AND coalesce(exhaustive, true)) AS fp, count(*) FILTER (WHERE fn) AS fn,
  count(*) FILTER (WHERE tp AND gs IS NOT NULL AND ps = gs) AS sentiment_correct, count(*) FILTER (WHERE tp AND gs IS NOT NULL) AS sentiment_total FROM pairs LEFT JOIN whole USING (article_id) GROUP BY ROLLUP (type)),
ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM counted)"""


@query(with_views(["mentions"], f"""{_GOLD} SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1,
CASE WHEN sentiment_total > 0 THEN round(sentiment_correct / sentiment_total, 4) END AS sentiment_accuracy FROM ratios""").replace("WITH ", "WITH RECURSIVE ", 1))
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and sentiment accuracy by kind and overall."""
    gold, pred = _gold_and_pred(spark, sf_dir)
    full = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("entities_exhaustive")).distinct()
    return evaluate.entity_metrics(evaluate.match_predictions(pred, gold), full)


_JUDGED = "j AS (SELECT CASE WHEN toxic = 1 THEN 'NEG' WHEN quality = 1 THEN 'POS' ELSE 'NEU' END AS gold, CASE doc_id % 5 WHEN 0 THEN 'NEG' WHEN 1 THEN 'POS' WHEN 2 THEN 'NEU' WHEN 3 THEN 'odd' END AS pred FROM labels)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    return table(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 1, "NEG").when(F.col("quality") == 1, "POS").otherwise("NEU").alias("gold"), F.when(k == 0, "NEG").when(k == 1, "POS").when(k == 2, "NEU").when(k == 3, "odd").alias("pred")
    )


_GRID = "g AS (SELECT a.c AS gold, b.c AS pred FROM (SELECT unnest(['POS', 'NEG', 'NEU']) AS c) a, (SELECT unnest(['POS', 'NEG', 'NEU']) AS c) b), n AS (SELECT gold, CASE WHEN pred IN ('POS', 'NEG', 'NEU') THEN pred ELSE 'NEU' END AS pred, count(*) AS n FROM j GROUP BY 1, 2), m AS (SELECT gold, pred, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (gold, pred))"


@query(f"WITH {_JUDGED}, {_GRID} SELECT * FROM m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf_dir), "gold", "pred", ["POS", "NEG", "NEU"], "NEU")


@query(f"WITH {_JUDGED}, {_GRID} SELECT sum(n) FILTER (WHERE gold = pred)::BIGINT AS correct, sum(n)::BIGINT AS total, round(sum(n) FILTER (WHERE gold = pred) / sum(n), 4) AS accuracy FROM m")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(evaluate.confusion(_judged(spark, sf_dir), "gold", "pred", ["POS", "NEG", "NEU"], "NEU"))


@query("""WITH f AS (SELECT CASE WHEN doc_id % 6 > 0 THEN list_distinct([lang, source]) END AS g, list_distinct([lang, 'src' || (doc_id % 20), 'x']) AS p FROM documents),
c AS (SELECT sum(len(list_intersect(p, g))) AS tp, sum(len(list_filter(p, lambda x: NOT list_contains(g, x)))) AS fp, sum(len(list_filter(g, lambda x: NOT list_contains(p, x)))) AS fn FROM f WHERE g IS NOT NULL),
r AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, precision, recall, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM r""")
def flag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    g = F.when(F.col("doc_id") % 6 > 0, F.array("lang", "source")).alias("gold")
    p = F.array("lang", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")), F.lit("x")).alias("pred")
    return evaluate.flag_metrics(d.select(g, p), "gold", "pred")


@query("""WITH c AS (SELECT source, count(*) FILTER (WHERE doc_id % 5 < 3) AS tp, count(*) FILTER (WHERE doc_id % 5 = 3) AS fp, count(*) FILTER (WHERE doc_id % 5 = 4) AS fn FROM documents GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM c)
SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM r""")
def source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from counts, for each source."""
    k = F.col("doc_id") % 5
    n = lambda c: F.count(F.when(c, 1))
    return evaluate.rates(table(spark, sf_dir, "documents").groupBy("source").agg(n(k < 3).alias("tp"), n(k == 3).alias("fp"), n(k == 4).alias("fn")))


@query(with_views(["raw_mentions"], f"""k AS (SELECT DISTINCT {key_sql('name')} AS key FROM raw_mentions)
SELECT key, {key_sql("key || '. S.A.'")} AS again, contains(' ' || key || ' s a ', ' ' || key || ' ') AS inside FROM k WHERE key <> ''"""))
def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name matches a longer one that holds it."""
    k = views.raw_mentions(spark, sf_dir).select(text.norm_key(F.col("name")).alias("key")).distinct().filter("key <> ''")
    return k.select("key", text.norm_key(F.concat("key", F.lit(". S.A."))).alias("again"), text.names_match(F.col("key"), F.concat("key", F.lit(" S A"))).alias("inside"))


@query(with_views(["mentions", "raw_mentions"], "SELECT id, name AS stripped FROM mentions"))
def stripped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courtesy titles put before every name and taken off again."""
    m = views.mentions(spark, sf_dir)
    titled = F.concat(F.element_at(F.array(*[F.lit(t) for t in text.TITLES]), (F.col("id") % len(text.TITLES) + 1).cast("int")), F.lit(" "), "name")
    return m.select("id", text.strip_title(titled).alias("stripped"))



def _fields(n, of) -> list:
    """Deterministic categories of every field by a number."""
    return [of(values, n + k).alias(f) for k, (f, values) in enumerate((f, v[0]) for f, v in evaluate.CATEGORIES.items())]


def _nth_sql(values: list[str], n: str) -> str:
    return f"{[*values, 'odd']}[(({n}) % {len(values) + 1} + 1)::INT]"


def _rates_sql(field: str, gold: str, pred: str, rule: tuple[list[str], str]) -> str:
    """Labelled rows and accuracy of one field; `odd` is no category."""
    known = f"list_contains({rule[0]}, {gold})"
    return f"count(*) FILTER (WHERE {known}) AS {field}_n, round(count(*) FILTER (WHERE {known} AND {gold} = CASE WHEN list_contains({rule[0]}, {pred}) THEN {pred} ELSE '{rule[1]}' END) / count(*) FILTER (WHERE {known}), 4) AS {field}_accuracy"


_RATED = ", ".join(_rates_sql(f, _nth_sql(v[0], f"doc_id + {k}"), _nth_sql(v[0], f"n_chars + {k}"), v) for k, (f, v) in enumerate(evaluate.CATEGORIES.items()))


@query(f"SELECT count(*) AS n_articles, {_RATED}, count(*) FILTER (WHERE doc_id % 4 = 0 AND n_chars % 4 IN (2, 3)) AS pos_as_neutral FROM documents")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row report of a labelled set; the mentions of every article are its gold and its predictions."""
    nth = lambda values, n: F.get(F.array(*[F.lit(v) for v in [*values, "odd"]]), (n % (len(values) + 1)).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("article_id", F.col("doc_id"))
    side = lambda n: d.select("article_id", nth(evaluate.SENTIMENTS, n).alias("overall_sentiment"), *_fields(n, lambda v, m: nth(v, m)), F.array("lang").alias("content_flags"), F.lit(True).alias("entities_exhaustive"))
    m = views.mentions(spark, sf_dir).withColumn("ord", F.col("id"))
    report, _ = evaluate.evaluate(side(F.col("n_chars")), side(F.col("doc_id")), m, m)
    rated = [c for f in evaluate.CATEGORIES for c in (F.col(f"category_matrices.{f}.n_labeled").alias(f"{f}_n"), F.col(f"category_matrices.{f}.accuracy").alias(f"{f}_accuracy"))]
    return report.select("n_articles", *rated, F.col("overall_sentiment.confusion_matrix")["POS->NEU"].alias("pos_as_neutral"))


@query(with_views(["mentions"], "SELECT id, contains(name, ' ') AND id % 6 < 5 AS nickname FROM mentions WHERE id % 6 < 5 OR NOT contains(name, '-')"))
def nicknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several words with a segment in each kind of marks after the first, as a nickname is written; names of one word end in it, and that is none."""
    first, rest, kind = F.substring_index("name", " ", 1), F.expr("substr(name, instr(name, ' '))"), F.col("id") % 6
    mark = F.when(kind == 0, ' "Nano"').when(kind == 1, " (el Nano)").when(kind == 2, " «Nano»").when(kind == 3, " “Nano”").when(kind == 4, " -Nano-").otherwise("")
    several = F.contains(F.col("name"), F.lit(" "))
    m = views.mentions(spark, sf_dir).select("id", F.when(several, F.concat(first, mark, rest)).otherwise(F.concat("name", mark)).alias("name"))
    return m.select("id", text.has_nickname(F.col("name")).alias("nickname"))
