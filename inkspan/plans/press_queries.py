"""Queries over text, addresses, dates, lexicons, filters, listings and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import dates, lexicon, text, urls
from inkspan.operators import filters, mentions, reports, sentiment
from inkspan.plans import views
from inkspan.plans.views import fold_sql, key_sql, table, with_views, words_sql
from inkspan.sources import pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Words that the prose of the tables is full of stand in for the Spanish lists.
TERMS = ["the", "que", "und", "les", "of the", "that", "with", "para"]
NEG, POS = ["that", "que la", "und", "with"], ["for", "les", "die", "para"]
DENIALS = ["is", "en", "de la", "der"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _re(terms: list[str], longest: bool = True) -> str:
    return lexicon.any_of(terms, longest)


# DuckDB takes only ASCII letters as part of a word; one letter has no accent to lose.
PLAIN = "replace(lower(strip_accents({})), 'ß', 'z')"


@query(with_views(["raw_mentions"], f"SELECT DISTINCT name, {key_sql('name')} AS name_key, array_to_string({words_sql(key_sql('name'))}, ' ') AS words, array_to_string(list_transform({words_sql(key_sql('name'))}, lambda w: w[1]), '') AS initials FROM raw_mentions"))
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison keys, significant words and initials of every mentioned name."""
    n = views.raw_mentions(spark, sf_dir).select("name").distinct()
    key = text.norm_key(F.col("name"))
    return n.select("name", key.alias("name_key"), F.array_join(text.key_words(key), " ").alias("words"), text.initials(key).alias("initials"))


@query(f"SELECT doc_id, sha256(strip_accents(text)) AS bare, sha256(lower(strip_accents(text))) AS folded, sha256({fold_sql('text')}) AS squeezed FROM documents")
def folded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent folding of whole documents."""
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", F.sha2(text.strip_accents(t), 256).alias("bare"), F.sha2(text.fold(t), 256).alias("folded"), F.sha2(text.folded_text(t), 256).alias("squeezed"))


@query(with_views(["raw_mentions"], "SELECT name, type, n, round(greatest(1.0::DOUBLE - CASE WHEN n = 1 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN type = 'PERSON' AND len(" + words_sql(key_sql("name")) + ") <= 1 THEN 0.1::DOUBLE ELSE 0 END, 0.1), 2) AS extraction_confidence FROM (SELECT name, type, count(*) AS n FROM raw_mentions GROUP BY ALL)"))
def name_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the extraction of each name is."""
    n = views.raw_mentions(spark, sf_dir).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("name", "type", "n", text.extraction_confidence(F.col("name"), F.col("type"), F.col("n")).alias("extraction_confidence"))


_TRACK = "[" + ",".join(f"'{t}'" for t in urls.TRACKING) + "]"
_QUERY = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({{u}}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({_TRACK}, lower(string_split(p, '=')[1])))), '&')"


def canonical_url_sql(u: str) -> str:
    q = _QUERY.format(u=u)
    path = f"regexp_replace(regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"lower(regexp_extract({u}, '^([^:]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[^:]+://([^/?#]*)', 1)) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"


@query(with_views(["articles"], f"SELECT id, {canonical_url_sql('url')} AS canonical, nullif(lower(regexp_extract(url, '^[^:]+://[^/?#]*/+([^/?#]+)', 1)), '') AS first_segment FROM articles"))
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form and section of every article address."""
    a = views.articles(spark, sf_dir)
    return a.select("id", urls.canonical_url(F.col("url")).alias("canonical"), urls.url_section(F.col("url")).alias("first_segment"))


@query(f"SELECT {canonical_url_sql('url')} AS canonical, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages collapsed to their canonical addresses."""
    return pages.canonical_pages(table(spark, sf_dir, "pages"))


@query("""SELECT page_id, CASE WHEN length(url) > 60 THEN 'too_long' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme'
  WHEN NOT regexp_matches(lower(regexp_extract(url, '^[^:]+://([^/:?#]*)', 1)), '(^|\\.)(site1|site2|site3)\\.example(\\.com|\\.org)?$') THEN 'domain' END AS reason FROM pages""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why page addresses are not admitted."""
    domains = [f"{s}.{t}" for s in ("site1", "site2", "site3") for t in ("example", "example.com", "example.org")]
    return table(spark, sf_dir, "pages").select("page_id", urls.url_reject(F.col("url"), domains, most_chars=60).alias("reason"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts::TIMESTAMP WHEN 1 THEN date_trunc('second', ts::TIMESTAMP) + INTERVAL 4 HOUR
  WHEN 2 THEN date_trunc('day', ts::TIMESTAMP) + INTERVAL 4 HOUR WHEN 3 THEN date_trunc('day', ts::TIMESTAMP) + INTERVAL 4 HOUR WHEN 4 THEN date_trunc('second', ts::TIMESTAMP) - INTERVAL 2 HOUR END AS parsed FROM events""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date texts in all spellings back to UTC."""
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 6
    written = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd")).when(k == 3, F.date_format(ts, "d/M/yyyy")).when(k == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("soon")
    )
    return table(spark, sf_dir, "events").select("event_id", dates.parse_date(written).alias("parsed"))


@query("SELECT event_id, day(ts) || ' ' || ['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'][month(ts)] || ' ' || strftime(ts, '%y') AS shown FROM events")
def short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.short_date(F.col("ts").cast("timestamp")).alias("shown"))


def label_sql(c: str, neg: list[str], pos: list[str]) -> str:
    t = PLAIN.format(c)
    n, p = f"regexp_matches({t}, '{_re(neg)}')", f"regexp_matches({t}, '{_re(pos)}')"
    return f"CASE WHEN {n} AND NOT {p} THEN 'NEG' WHEN {p} AND NOT {n} THEN 'POS' END"


_PARTS = """list_filter(list_transform(
    regexp_split_to_array(regexp_replace(title || '.' || chr(10) || chr(10) || coalesce(body, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '')"""
_SENTENCES = f"""sentences AS (SELECT article_id, idx - 1 AS idx, rtrim(substring(text, 1, 500)) AS text FROM (
  SELECT id AS article_id, unnest(s) AS text, generate_subscripts(s, 1) AS idx FROM (SELECT id, list_slice({_PARTS}, 1, 400) AS s FROM articles)))"""
#: All sentences, whole.
_WHOLE_SENTENCES = f"""sentences AS (SELECT article_id, idx - 1 AS idx, text FROM (
  SELECT id AS article_id, unnest(s) AS text, generate_subscripts(s, 1) AS idx FROM (SELECT id, {_PARTS} AS s FROM articles)))"""


@query(with_views(["articles"], f"{_SENTENCES} SELECT article_id, count(*) AS n, sum(length(text)) AS chars, sha256(string_agg(text, chr(10) ORDER BY idx)) AS all_text FROM sentences GROUP BY 1"))
def article_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of title and body: how many, how long, and their text."""
    s = sentiment.sentences(views.articles(spark, sf_dir))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    return s.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sha2(joined, 256).alias("all_text"))


@query(with_views(["articles"], f"{_SENTENCES} SELECT {label_sql('text', NEG, POS)} AS label, regexp_matches({PLAIN.format('text')}, '{_re(DENIALS)}') AS negated, count(*) AS n FROM sentences GROUP BY 1, 2"))
def sentence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon labels and denials over all sentences."""
    s = sentiment.sentences(views.articles(spark, sf_dir))
    return s.groupBy(lexicon.lexicon_label(F.col("text"), NEG, POS).alias("label"), lexicon.has_negation(F.col("text"), DENIALS).alias("negated")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({PLAIN.format('text')}, '{_re(NEG)}'))), '|') AS neg_terms, array_to_string(list_sort(list_distinct(regexp_extract_all({PLAIN.format('text')}, '{_re(POS)}'))), '|') AS pos_terms FROM documents")
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lexicon terms of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", lexicon.lexicon_matches(F.col("text"), {"NEG": NEG, "POS": POS}).alias("m"))
    return d.select("doc_id", F.array_join("m.NEG", "|").alias("neg_terms"), F.array_join("m.POS", "|").alias("pos_terms"))


_SCORED = f"""{_SENTENCES},
b AS (SELECT article_id, idx, text, {label_sql('text', NEG, POS)} AS label, regexp_matches({PLAIN.format('text')}, '{_re(DENIALS)}') AS negated FROM sentences),
c AS (SELECT *, CASE label WHEN 'NEG' THEN 0.42::DOUBLE / 1.12 WHEN 'POS' THEN 0.3::DOUBLE / 1.12 ELSE 0.3::DOUBLE END AS n0, CASE WHEN label IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE / 1.12 END AS u0,
  CASE label WHEN 'POS' THEN 0.42::DOUBLE / 1.12 WHEN 'NEG' THEN 0.3::DOUBLE / 1.12 ELSE 0.3::DOUBLE END AS p0 FROM b),
e AS (SELECT *, u0 + (n0 - u0) / 2 AS n1, u0 + (p0 - u0) / 2 AS p1 FROM c),
scored AS (SELECT article_id, idx, text, CASE WHEN negated THEN n1 / (n1 + u0 + p1) ELSE n0 END AS p_neg, CASE WHEN negated THEN u0 / (n1 + u0 + p1) ELSE u0 END AS p_neu, CASE WHEN negated THEN p1 / (n1 + u0 + p1) ELSE p0 END AS p_pos FROM e)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.score_sentences(sentiment.sentences(views.articles(spark, sf_dir)), lexicon={"negative": NEG, "positive": POS}, cues=DENIALS)


@query(with_views(["articles"], f"""{_SCORED}, g AS (SELECT article_id, round(sum(p_neg), 9) AS n, round(sum(p_neu), 9) AS u, round(sum(p_pos), 9) AS p, count(*) AS k FROM scored GROUP BY 1)
SELECT id, CASE WHEN k IS NULL THEN 'NEU' WHEN n >= u AND n >= p THEN 'NEG' WHEN u >= p THEN 'NEU' ELSE 'POS' END AS label, coalesce(round(round(greatest(n, u, p) / k, 9)::DECIMAL(18, 9), 4)::DOUBLE, 0.0)::DOUBLE AS score FROM articles LEFT JOIN g ON id = article_id"""))
def article_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of each article from its sentences, each distinct sentence scored once."""
    return sentiment.article_sentiment(views.articles(spark, sf_dir), _scored(spark, sf_dir))


def sentence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, idx, pos, key): capital runs of each sentence with their place."""
    s = sentiment.sentences(views.articles(spark, sf_dir))
    m = s.select("article_id", "idx", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(views.NAME_RUN), F.lit(0)))).alias("name"))
    return m.select("article_id", "idx", (F.expr("instr(text, name)") - 1).alias("pos"), text.norm_key(F.col("name")).alias("key"))


_PLACES = f"""places AS (SELECT article_id, idx, instr(text, name) - 1 AS pos, {key_sql('name')} AS key FROM (SELECT article_id, idx, text, unnest(list_distinct(regexp_extract_all(text, '{views.NAME_RUN}'))) AS name FROM sentences))"""
_HITS = f"""hit_words AS (SELECT article_id, idx, unnest(regexp_extract_all({PLAIN.format('text')}, '\\w+|[^\\w]')) AS w, generate_subscripts(regexp_extract_all({PLAIN.format('text')}, '\\w+|[^\\w]'), 1) AS k FROM sentences),
hit_at AS (SELECT article_id, idx, w, k, sum(length(w)) OVER (PARTITION BY article_id, idx ORDER BY k) - length(w) AS pos FROM hit_words),
hits AS (SELECT article_id, idx, pos, CASE WHEN w IN ('that', 'und', 'with') THEN 'NEG' ELSE 'POS' END AS label FROM hit_at WHERE w IN ('that', 'und', 'with', 'for', 'les', 'die', 'para'))"""
REL_NEG, REL_POS = ["that", "und", "with"], ["for", "les", "die", "para"]


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentiment.sentences(views.articles(spark, sf_dir))
    return s.select("article_id", "idx", F.explode(lexicon.relation_hits(F.col("text"), REL_NEG, REL_POS)).alias("h")).select("article_id", "idx", "h.*")


_NEAR = """near AS (SELECT h.article_id, h.idx, h.label, p.key FROM hits h ASOF JOIN (SELECT article_id, idx, pos, max(key) AS key FROM places GROUP BY ALL) p ON h.article_id = p.article_id AND h.idx = p.idx AND h.pos > p.pos),
attributed AS (SELECT article_id, idx, key, CASE WHEN min(label) = max(label) THEN min(label) END AS label FROM near GROUP BY ALL)"""


@query(with_views(["articles"], f"{_SENTENCES}, {_HITS} SELECT article_id, idx, pos, label FROM hits"))
def relation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and label of each relational phrase in each sentence."""
    return _hits(spark, sf_dir)


@query(with_views(["articles"], f"{_SENTENCES} SELECT article_id, idx, {label_sql('text', REL_NEG, REL_POS)} AS label FROM sentences"))
def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each sentence by relational phrases; both kinds, or none, give none."""
    s = sentiment.sentences(views.articles(spark, sf_dir))
    return s.select("article_id", "idx", lexicon.relation_label(F.col("text"), REL_NEG, REL_POS).alias("label"))


@query(with_views(["articles"], f"{_SENTENCES}, {_PLACES}, {_HITS}, {_NEAR} SELECT * FROM attributed"))
def relation_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relational phrase goes to the nearest mention before it."""
    return sentiment.attribute_relations(_hits(spark, sf_dir), sentence_mentions(spark, sf_dir))


@query(with_views(["articles"], f"""{_SCORED}, {_PLACES}, {_HITS}, {_NEAR},
j AS (SELECT p.article_id, p.idx, p.key, s.text, p_neg + CASE a.label WHEN 'NEG' THEN 0.12 ELSE 0 END AS n, p_neu AS u, p_pos + CASE a.label WHEN 'POS' THEN 0.12 ELSE 0 END AS p
  FROM (SELECT DISTINCT article_id, idx, key FROM places) p LEFT JOIN scored s USING (article_id, idx) LEFT JOIN attributed a USING (article_id, idx, key)),
g AS (SELECT article_id, key, round(sum(n / (n + u + p)), 9) AS n, round(sum(u / (n + u + p)), 9) AS u, round(sum(p / (n + u + p)), 9) AS p, count(n) AS k, arg_min(text, idx) AS context FROM j GROUP BY 1, 2)
SELECT article_id, key, CASE WHEN k = 0 THEN NULL WHEN n >= u AND n >= p THEN 'NEG' WHEN u >= p THEN 'NEU' ELSE 'POS' END AS label, CASE WHEN k > 0 THEN round(round(greatest(n, u, p) / k, 9)::DECIMAL(18, 9), 4)::DOUBLE END AS score, context FROM g"""))
def mention_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of each mention over the sentences that name it."""
    places = sentiment.scored_places(_scored(spark, sf_dir), F.regexp_extract_all("text", F.lit(views.NAME_RUN), F.lit(0)))
    return sentiment.mention_sentiment(places, None, sentiment.attribute_relations(_hits(spark, sf_dir), sentence_mentions(spark, sf_dir)))


@query(with_views(["articles", "mentions"], """SELECT id, title, url FROM articles WHERE source IN ('src0', 'src3', 'src5') AND has_hard_data = true
  AND published_at >= TIMESTAMP '2026-01-02 04:00:00' AND published_at < TIMESTAMP '2026-01-20 04:00:00' AND (regexp_matches(lower(strip_accents(title)), 'er') OR regexp_matches(lower(strip_accents(coalesce(main_topic, ''))), 'er') OR regexp_matches(topic_keywords, 'er'))"""))
def filtered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, hard data, local days and free text together."""
    a = filters.filter_articles(views.articles(spark, sf_dir), source=["src0", "src3", "src5"], has_hard_data=True, date_from="2026-01-02", date_to="2026-01-19", q="ÉR")
    return a.select("id", "title", "url")


@query(with_views(["articles", "mentions"], "SELECT id, framing FROM articles WHERE framing = 'conflict' AND id IN (SELECT article_id FROM mentions WHERE regexp_matches(lower(strip_accents(name)), 'ere'))"))
def entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of one framing that mention a matching name."""
    return filters.filter_articles(views.articles(spark, sf_dir), views.mentions(spark, sf_dir), entity="ere", framing="conflict").select("id", "framing")


@query(with_views(["articles"], "SELECT id, source, published_at FROM articles WHERE overall_sentiment = 'NEG' ORDER BY published_at DESC NULLS FIRST, id DESC LIMIT 20 OFFSET 10"))
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing, newest first."""
    page, _ = filters.list_articles(views.articles(spark, sf_dir), overall_sentiment="NEG", limit=20, offset=10)
    return page.select("id", "source", "published_at")


@query(with_views(["articles"], "SELECT count(*) AS total FROM articles WHERE overall_sentiment = 'NEG'"))
def listing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.list_articles(views.articles(spark, sf_dir), overall_sentiment="NEG")[1]


_TOPIC = f"""coalesce(section_of NOT IN ('fr'), true) AND (regexp_matches({PLAIN.format('title')}, '{_re(TERMS, False)}') OR len(list_distinct(regexp_extract_all({PLAIN.format('body')}, '{_re(TERMS, False)}'))) >= 2)"""
_SECTIONED = "s AS (SELECT *, nullif(lower(regexp_extract(url, '^[^:]+://[^/?#]*/+([^/?#]+)', 1)), '') AS section_of FROM articles)"


def _on_topic():
    return filters.is_topic(F.col("url"), F.col("title"), F.col("body"), TERMS, blocked=["fr"])


@query(with_views(["articles"], f"{_SECTIONED} SELECT id, {_TOPIC} AS on_topic FROM s"))
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which articles are on the topic, by section, title and body."""
    return views.articles(spark, sf_dir).select("id", _on_topic().alias("on_topic"))


@query(with_views(["articles"], f"{_SECTIONED} SELECT source, sum(CASE WHEN {_TOPIC} THEN 1 ELSE 0 END)::BIGINT AS n, grouping(source) = 1 AS is_total FROM s GROUP BY ROLLUP (source)"))
def topic_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.articles(spark, sf_dir)
    return reports.topic_yield(a, _on_topic(), a.select("source"))


@query(with_views(["articles"], "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at NULLS LAST, id) AS k FROM articles) SELECT id, source FROM r WHERE k <= 7 ORDER BY published_at NULLS LAST, id LIMIT 100"))
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 7 articles of a source and 100 in all."""
    return reports.quota_sample(views.articles(spark, sf_dir), 100, 7).select("id", "source")


@query(with_views(["articles"], "SELECT source, count(*) AS n, grouping(source) = 1 AS is_total FROM articles GROUP BY ROLLUP (source)"))
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_source(views.articles(spark, sf_dir))


@query(with_views(["articles"], "SELECT coalesce(overall_sentiment, '-') AS sentiment, count(*) AS n FROM articles GROUP BY 1"))
def count_by_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_sentiment(views.articles(spark, sf_dir))


@query(with_views(["articles"], "SELECT 'source' AS facet, source AS value FROM articles WHERE source <> '' UNION SELECT 'section', section FROM articles WHERE section <> ''"))
def article_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.article_facets(views.articles(spark, sf_dir))


@query(with_views(["articles"], "SELECT id FROM articles WHERE analyzer_version IS DISTINCT FROM '7' OR analysis_schema_version IS NULL OR analysis_schema_version < 2"))
def needs_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.needs_backfill(views.articles(spark, sf_dir), "7").select("id")


_TOKENS = """tok AS (SELECT id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT id, regexp_extract_all(lower(strip_accents(body)), '[\\p{L}]+') AS t FROM articles)),
kw AS (SELECT * FROM (SELECT id, word, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS rank FROM (SELECT id, word, count(*) AS n, min(pos) AS f FROM tok WHERE length(word) > 3 AND word NOT IN ('with', 'that', 'dans') GROUP BY 1, 2)) WHERE rank <= 8)"""
STOP = ["with", "that", "dans"]


@query(with_views(["articles"], f"{_TOKENS} SELECT id, word, n, rank FROM kw"))
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent words of each article."""
    return mentions.keywords(views.articles(spark, sf_dir), STOP)


@query(with_views(["articles"], f"""{_TOKENS}, g AS (SELECT id, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY id ORDER BY pos)),
p AS (SELECT id, pos * 4 + 2 AS place, word || ' ' || w2 AS phrase FROM g WHERE w2 IS NOT NULL UNION ALL SELECT id, pos * 4 + 3, word || ' ' || w2 || ' ' || w3 FROM g WHERE w3 IS NOT NULL),
c AS (SELECT p.id, phrase, count(*) AS n, min(place) AS place FROM p JOIN kw ON p.id = kw.id AND kw.rank = 1 WHERE contains(' ' || phrase || ' ', ' ' || kw.word || ' ') GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT id, phrase FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, place) = 1)
SELECT kw.id, coalesce(phrase, word) AS main_topic FROM kw LEFT JOIN b USING (id) WHERE rank = 1"""))
def main_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase that stands for each article."""
    a = views.articles(spark, sf_dir)
    return mentions.main_topic(a, mentions.keywords(a, STOP))


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each group of pages; some are cut short, some are an index."""
    p = table(spark, sf_dir, "pages").withColumn("source", F.concat(F.lit("m"), (F.col("page_id") % 9).cast("string"))).withColumn("part", F.floor(F.col("page_id") / 50).cast("int"))
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    g = p.groupBy("source", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("inner"))
    body = F.when(F.col("part") % 7 == 6, F.concat(F.lit("<sitemapindex>"), F.lit("<sitemap><loc>x</loc></sitemap></sitemapindex>"))).when(F.col("part") % 5 == 4, F.concat(F.lit("<urlset><url><loc>"), "inner")).otherwise(F.concat(F.lit("<urlset>"), "inner", F.lit("</urlset>")))
    return g.select("source", "part", body.alias("xml"))


_PAGE_PARTS = "p AS (SELECT *, 'm' || (page_id % 9) AS source, (page_id // 50)::INT AS part FROM pages)"


@query(f"WITH {_PAGE_PARTS} SELECT source, part, (row_number() OVER (PARTITION BY source, part ORDER BY page_id) - 1)::INT AS ord, trim(url) AS url FROM p WHERE part % 7 <> 6 AND part % 5 <> 4 AND trim(url) <> ''")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from sitemaps; broken ones and indexes give none."""
    return pages.sitemap_urls(_sitemaps(spark, sf_dir)).select("source", "part", "ord", "url")


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("source", F.concat(F.lit("m"), (F.col("page_id") % 9).cast("string")))
    entry = F.concat(F.lit("<item><title>t</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    g = p.groupBy("source", F.floor(F.col("page_id") / 40).cast("int").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("inner"))
    return g.select("source", "part", F.concat(F.lit("<rss><channel><title>t</title>"), "inner", F.lit("</channel></rss>")).alias("xml"))


@query("SELECT 'm' || (page_id % 9) AS source, (page_id // 40)::INT AS part, (row_number() OVER (PARTITION BY page_id % 9, page_id // 40 ORDER BY page_id) - 1)::INT AS ord, trim(url) AS url FROM pages")
def feed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from RSS feeds."""
    return pages.feed_urls(_feeds(spark, sf_dir)).select("source", "part", "ord", "url")


@query(f"""WITH {_PAGE_PARTS},
s AS (SELECT source, trim(url) AS url, 0 AS kind, part * 1000 + row_number() OVER (PARTITION BY source, part ORDER BY page_id) - 1 AS ord FROM p WHERE part % 7 <> 6 AND part % 5 <> 4),
f AS (SELECT source, trim(url) AS url, 1 AS kind, (page_id // 40) * 1000 + row_number() OVER (PARTITION BY source, page_id // 40 ORDER BY page_id) - 1 AS ord FROM p),
u AS (SELECT source, url, min(kind * 1000000000 + ord) AS o FROM (SELECT * FROM s UNION ALL SELECT * FROM f) GROUP BY 1, 2)
SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY o, url) AS ord FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, url) <= 40""")
def discovered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps then feeds, each address once, 40 of a source."""
    place = F.col("part") * 1000 + F.col("ord")
    s, f = (x.withColumn("ord", place) for x in (sitemap_urls(spark, sf_dir), feed_urls(spark, sf_dir)))
    return pages.discover_urls(s, f, limit=40)


@query("""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS ord, url FROM (SELECT page_id, url, min(place) AS place FROM (
  SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, 'href="[^"]+"') AS l FROM pages)) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY place) <= 5""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different links of each page."""
    return pages.page_links(table(spark, sf_dir, "pages"), "page_id", r'href="[^"]+"', limit=5)


@query("SELECT page_id, sha256(html) AS decoded FROM pages")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes in UTF-8 and Latin-1, declared or not, and back."""
    latin = (F.col("page_id") % 2 == 1) & ~F.col("html").rlike("[^\\x00-\\xFF]")
    p = table(spark, sf_dir, "pages").withColumn("latin", latin)
    data = F.when(F.col("latin"), F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    kind = F.when(F.col("latin"), "text/html; charset=ISO-8859-1").when(F.col("page_id") % 4 == 0, "text/html; charset=utf-8").otherwise("text/html")
    return p.select("page_id", F.sha2(pages.decode_page(data, kind), 256).alias("decoded"))


@query(f"WITH {views.READ_SQL} SELECT *, NULL::VARCHAR AS section, NULL::VARCHAR AS authors, NULL::TIMESTAMP AS published_at FROM read WHERE title <> '' AND body <> ''")
def extracted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles out of raw pages."""
    return pages.extract_articles(table(spark, sf_dir, "pages"))
