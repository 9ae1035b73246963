"""Sentences, their scores, and sentiment of articles, mentions and entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions.lexicon import boost, dampen, has_negation, lexicon_label
from inkspan.functions.text import norm_key
from inkspan.sources.store import Store
from inkspan.sources.tables import once

MOST_SENTENCES = 400
MOST_CHARS = 500
#: Probabilities of the default scorer.
PRIOR = (0.3, 0.4, 0.3)
LOW_SAMPLE = 5

Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]


def sentences(articles: DataFrame, most: int | None = MOST_SENTENCES, chars: int | None = MOST_CHARS) -> DataFrame:
    """(article_id, idx, text): the first sentences of title and body, trimmed and cut for the sentiment model; with None all of them, whole."""
    whole = F.concat(F.col("title"), F.lit(".\n\n"), F.coalesce(F.col("body"), F.lit("")))
    parts = F.filter(F.transform(F.split(F.regexp_replace(whole, r"([.!?])\s+", "$1\n"), r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
    s = articles.select(F.col("id").alias("article_id"), F.posexplode(parts if most is None else F.slice(parts, 1, most)).alias("idx", "text"))
    return s if chars is None else s.select("article_id", "idx", F.rtrim(F.substring("text", 1, chars)).alias("text"))


def prior_scores(distinct: DataFrame) -> DataFrame:
    neg, neu, pos = PRIOR
    return distinct.select("text", F.lit(neg).alias("p_neg"), F.lit(neu).alias("p_neu"), F.lit(pos).alias("p_pos"))


def model_scores(scorer: Scorer, partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scoring step from a model: an iterator of text batches to frames with p_neg, p_neu, p_pos.

    The iterator form lets the model load once in each worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.Series] = []

        def texts() -> Iterator[pd.Series]:
            for f in frames:
                waiting.append(f["text"])
                yield f["text"]

        for out in scorer(texts()):
            yield pd.DataFrame({"text": waiting.pop(0).values, **{p: out[p].values for p in ("p_neg", "p_neu", "p_pos")}})

    def score(distinct: DataFrame) -> DataFrame:
        dealt = distinct.repartition(partitions) if partitions else distinct
        return dealt.select("text").mapInPandas(run, "text string, p_neg double, p_neu double, p_pos double")

    return score


SCORES = ("p_neg double, p_neu double, p_pos double", ["min(p_neg) AS p_neg", "min(p_neu) AS p_neu", "min(p_pos) AS p_pos"])


def score_store(spark: SparkSession, path: str) -> Store:
    """Where the scores of sentences are kept from run to run, by the md5 of the sentence."""
    return Store(spark, path, {}, {"scores": SCORES})


def kept_scores(score: Callable[[DataFrame], DataFrame], store: Store, run: str) -> Callable[[DataFrame], DataFrame]:
    """A scoring step that gives only sentences to score which the store lacks, and adds theirs; run names the writer."""

    def step(distinct: DataFrame) -> DataFrame:
        keyed = once(distinct.select(F.md5(F.col("text").cast("binary")).alias("key"), "text"))
        known = once(store.lookup("scores", keyed, store.snapshot()))
        new = once(score(keyed.join(known.select("key"), "key", "left_anti").select("text")).select(F.md5(F.col("text").cast("binary")).alias("key"), "text", "p_neg", "p_neu", "p_pos"))
        n = new.count()
        if n:
            store.transact(run, store.snapshot().streams.get(run, -1) + 1, lambda now: ({}, {"scores": (new.drop("text"), n)}, {}))
        return new.drop("key").unionByName(keyed.join(known, "key").drop("key"))

    return step


def score_sentences(s: DataFrame, score: Callable[[DataFrame], DataFrame] = prior_scores, lexicon: dict | None = None, cues: list[str] | None = None) -> DataFrame:
    """Add p_neg, p_neu, p_pos, moved by lexicon and denial.

    A model scores each distinct sentence once; its scores come back by the
    sentence's md5.  The constant prior needs neither.
    """
    if score is prior_scores:
        scored = s.withColumns({p: F.lit(v) for p, v in zip(("p_neg", "p_neu", "p_pos"), PRIOR, strict=True)})
    else:
        keyed = s.withColumn("_key", F.md5(F.col("text").cast("binary")))
        found = score(keyed.dropDuplicates(["_key"]).select("text"))
        scored = keyed.join(found.select(F.md5(F.col("text").cast("binary")).alias("_key"), "p_neg", "p_neu", "p_pos"), "_key").drop("_key")
    label = lexicon_label(F.col("text"), **(lexicon or {}))
    scored = scored.withColumn("b", boost(F.col("p_neg"), F.col("p_neu"), F.col("p_pos"), label)).select(*s.columns, "b.*")
    negated = has_negation(F.col("text"), cues) if cues else has_negation(F.col("text"))
    return scored.withColumn("d", dampen(F.col("p_neg"), F.col("p_neu"), F.col("p_pos"), negated)).select(*s.columns, "d.*")


def top_label(neg: Column, neu: Column, pos: Column) -> Column:
    """The label of the largest sum; ties in the order NEG, NEU, POS."""
    return F.when((neg >= neu) & (neg >= pos), "NEG").when(neu >= pos, "NEU").otherwise("POS")


def _summed(df: DataFrame, *keys: str, **more: Column) -> DataFrame:
    # Sums to 9 places, and so labels and scores, do not hang on the order of the sentences.
    g = df.groupBy(*keys).agg(*[F.round(F.sum(p), 9).alias(p) for p in ("p_neg", "p_neu", "p_pos")], F.count("p_neg").alias("n"), *[c.alias(k) for k, c in more.items()])
    label = top_label(F.col("p_neg"), F.col("p_neu"), F.col("p_pos"))
    return g.select(*keys, *more, F.when(F.col("n") > 0, label).alias("label"), F.when(F.col("n") > 0, F.round(F.round(F.greatest("p_neg", "p_neu", "p_pos") / F.col("n"), 9), 4)).alias("score"))


def article_sentiment(articles: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, label, score) from sentence sums; an article without a sentence is NEU, 0.0."""
    summed = _summed(scored.filter(F.trim("text") != ""), "article_id")
    j = articles.select("id").join(summed, F.col("id") == F.col("article_id"), "left")
    return j.select("id", F.coalesce("label", F.lit("NEU")).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def attribute_relations(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """(article_id, idx, key, label): each hit goes to the nearest mention before it in its sentence.

    hits: article_id, idx, pos, label; mentions: article_id, idx, pos, key.
    Hits of both labels on one mention cancel each other.
    """
    h = hits.select("article_id", "idx", "pos", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"), "label")
    m = mentions.select("article_id", "idx", "pos", F.lit(1).alias("kind"), "key", F.lit(None).cast("string").alias("label"))
    before = Window.partitionBy("article_id", "idx").orderBy("pos", "kind", "key").rowsBetween(Window.unboundedPreceding, -1)
    near = h.unionByName(m).withColumn("to", F.last("key", ignorenulls=True).over(before)).filter("kind = 0 AND to IS NOT NULL")
    g = near.groupBy("article_id", "idx", F.col("to").alias("key")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return g.select("article_id", "idx", "key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"))


def scored_places(scored: DataFrame, names: Column) -> DataFrame:
    """Scored sentences once for each different key of the names (an array) that stand in them; no shuffle, since a sentence is one row."""
    keys = F.array_distinct(F.transform(names, norm_key))
    return scored.select(*scored.columns, F.explode(keys).alias("key"))


def mention_sentiment(places: DataFrame, scored: DataFrame | None, attributed: DataFrame) -> DataFrame:
    """(article_id, key, label, score, context) over the sentences that name each key.

    places: article_id, idx, key.  Relation labels raise the sentence's share
    before the sums; without a scored sentence label and score are NULL.
    Without scored, places are those of `scored_places`.
    """
    j = places if scored is None else places.select("article_id", "idx", "key").distinct().join(scored, ["article_id", "idx"], "left")
    j = j.join(attributed, ["article_id", "idx", "key"], "left")
    j = j.withColumn("b", boost(F.col("p_neg"), F.col("p_neu"), F.col("p_pos"), F.col("label"))).select("article_id", "idx", "key", "text", "b.*")
    return _summed(j, "article_id", "key", context=F.min_by("text", "idx")).select("article_id", "key", "label", "score", "context")


def entity_sentiment(mentions: DataFrame, *keys: str, n: int | None = None, newest: str = "id") -> DataFrame:
    """Weighted sentiment of each entity: shares of weight, score from -1 to 1, dominant label, sample size.

    A mention weighs max(1, mentions_count) * (score or 0.5).  With n only the
    newest n mentions of each entity count.
    """
    m = mentions.filter(F.col("sentiment_toward").isin("POS", "NEG", "NEU"))
    if n is not None:
        m = m.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest)))).filter(F.col("_r") <= n).drop("_r")
    w = F.greatest(F.lit(1), F.col("mentions_count")) * F.coalesce("sentiment_score", F.lit(0.5))
    part = lambda label: F.round(F.sum(F.when(F.col("sentiment_toward") == label, w).otherwise(0.0)), 9)
    g = m.groupBy(*keys).agg(part("POS").alias("pos"), part("NEG").alias("neg"), part("NEU").alias("neu"), F.count(F.lit(1)).alias("sample_size")).withColumn("total", F.col("pos") + F.col("neg") + F.col("neu"))
    used = F.col("total") > 0
    share = lambda c: F.when(used, F.round(100 * F.col(c) / F.col("total"), 4))
    top = F.when((F.col("pos") >= F.col("neg")) & (F.col("pos") >= F.col("neu")), "POS").when(F.col("neg") >= F.col("neu"), "NEG").otherwise("NEU")
    return g.select(*keys, share("pos").alias("pos_pct"), share("neg").alias("neg_pct"), share("neu").alias("neu_pct"), F.when(used, F.round((F.col("pos") - F.col("neg")) / F.col("total"), 4)).alias("score"), F.when(used, top).alias("dominant"), "sample_size", (F.col("sample_size") < LOW_SAMPLE).alias("low_sample"))
