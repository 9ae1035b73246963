"""Checks and merges of analyses that came from elsewhere."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import clamp01, folded_text, key_words, norm_sentiment

PARTIAL_CONFIDENCE = 0.6

#: What an engine returns for an article; a text that is no such object is kept in _broken.
RESULT = """main_topic string, topic_keywords array<string>, overall_sentiment string, framing string, headline_intent string, lead_orientation string,
dominant_actor string, source_quality string, has_hard_data boolean, blamed_actor string, credited_actor string, sentiment_basis string, facts_sentiment string,
quoted_sentiment string, media_stance string, media_stance_evidence string, overall_sentiment_reason string, content_flags array<string>,
entities array<struct<name:string,type:string,mentions_count:int,sentiment_toward:string,sentiment_confidence:double,context:string,confidence:double,confidence_reason:string>>, _broken string"""

_PIECE = regex.compile(r"\w+|\W")
_TRACE = "array<struct<whole:long,last:long,traced:boolean>>"


class TextIndex:
    """Where each word of a text stands; a phrase is looked up by its first piece."""

    def __init__(self, text: str):
        self.text, self.pieces, self.places = text, _PIECE.findall(text), {}
        for k, piece in enumerate(self.pieces):
            self.places.setdefault(piece, []).append(k)

    def count(self, phrase: str) -> int:
        """How often a phrase stands as whole words, one after the other."""
        if not phrase:
            return 0
        wanted = _PIECE.findall(phrase)
        if not (_PIECE.match(phrase)[0].isalnum() and wanted[-1].isalnum()):  # its borders are no words
            return len(regex.findall(rf"(?<!\w){regex.escape(phrase)}(?!\w)", self.text))
        n, free = 0, 0
        for k in self.places.get(wanted[0], ()):
            if k >= free and (len(wanted) == 1 or self.pieces[k : k + len(wanted)] == wanted):
                n, free = n + 1, k + len(wanted)
        return n


def _traces(text: pd.Series, names: pd.Series, words: pd.Series) -> pd.Series:
    out = []
    for t, of, parts in zip(text, names, words, strict=True):
        index = TextIndex(t or "")
        out.append([{"whole": index.count(n), "last": index.count(w[-1]) if len(w) else 0, "traced": any(index.count(x) for x in w)} for n, w in zip(of, parts, strict=True)])
    return pd.Series(out, dtype=object)


def with_traces(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Join each entity of an article with its text: how often the whole name and its last word stand there, and if any word does.

    All entities of an article meet its text in one row, and are looked up in
    one index of its words; no entity's row carries the text.
    """
    text = articles.select(F.col("id").alias("article_id"), folded_text(F.concat_ws(". ", "title", "body")).alias("_text"))
    row = F.struct(*[F.col(f"`{c}`") for c in entities.columns]).alias("row")
    e = entities.filter("name IS NOT NULL").select("article_id", row, folded_text(F.col("name")).alias("name")).withColumn("words", key_words(F.col("name")))
    e = e.groupBy("article_id").agg(F.collect_list(F.struct("row", "name", "words")).alias("e"))
    traces = F.pandas_udf(_traces, _TRACE)(F.col("_text"), F.col("e.name"), F.col("e.words"))
    z = e.join(text, "article_id").select("e", traces.alias("t")).select(F.explode(F.arrays_zip("e", "t")).alias("z"))
    return z.select("z.e.row.*", F.col("z.e.words").alias("_words"), F.col("z.t.whole").alias("_whole"), F.col("z.t.last").alias("_last"), F.col("z.t.traced").alias("_traced"))


def verify_entities(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Drop entities without a trace in their text; a partial trace caps the confidence at 0.6."""
    return _verified(with_traces(entities, articles)).select(*entities.columns)


def _verified(t: DataFrame) -> DataFrame:
    kept = t.filter((F.size("_words") > 0) & ((F.col("_whole") > 0) | F.col("_traced")))
    return kept.withColumn("extraction_confidence", F.when(F.col("_whole") > 0, F.col("extraction_confidence")).otherwise(F.least("extraction_confidence", F.lit(PARTIAL_CONFIDENCE))))


def _recounted(t: DataFrame) -> DataFrame:
    counted = F.when((F.col("type") == "PERSON") & (F.size("_words") >= 2), F.col("_last")).otherwise(F.col("_whole"))
    return t.withColumn("mentions_count", F.when((F.size("_words") > 0) & (counted > 0), counted).otherwise(F.col("mentions_count")))


def recount_mentions(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Counts from the text: persons of two or more words by their last one, others by the whole name; 0 keeps the estimate."""
    return _recounted(with_traces(entities, articles)).select(*entities.columns)


def parsed_results(results: DataFrame) -> DataFrame:
    """(article_id, r): results read as far as they go; r._broken holds a text that is no result."""
    return results.select("article_id", F.from_json("result_json", RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))


def broken_results(results: DataFrame) -> DataFrame:
    """(article_id, result_json) of the results that cannot be read."""
    return parsed_results(results).filter("r._broken IS NOT NULL").select("article_id", F.col("r._broken").alias("result_json"))


def map_llm_results(results: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, result_json) to mention rows: cleaned, verified, recounted, and ranked in their article by mentions, then as the engine had them."""
    e = parsed_results(results).filter("r._broken IS NULL").select("article_id", F.posexplode("r.entities").alias("pos", "e")).select("article_id", "pos", "e.*")
    context, reason = F.trim(F.coalesce("context", F.lit(""))), F.trim(F.coalesce("confidence_reason", F.lit("")))
    rows = e.select(
        "article_id", F.trim("name").alias("name"), F.when(F.col("type") == "ORG", "ORG").otherwise("PERSON").alias("type"),
        F.greatest(F.lit(1), F.coalesce("mentions_count", F.lit(1))).alias("mentions_count"), norm_sentiment(F.coalesce("sentiment_toward", F.lit(""))).alias("sentiment_toward"),
        clamp01(F.col("sentiment_confidence")).alias("sentiment_score"),
        F.when(reason != "", F.concat(context, F.lit(" ["), reason, F.lit("]"))).otherwise(F.nullif(context, F.lit(""))).alias("context"),
        clamp01(F.col("confidence")).alias("extraction_confidence"), "pos",
    )
    out = _recounted(_verified(with_traces(rows, articles))).select(*rows.columns)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("mentions_count"), "pos"))).drop("pos")


#: Fields that are texts, blank for NULL; labels of a sentiment; and what is taken as it is.
_TEXTS = ("main_topic", "dominant_actor", "blamed_actor", "credited_actor", "media_stance_evidence", "overall_sentiment_reason")
_SENTIMENTS = ("overall_sentiment", "facts_sentiment", "quoted_sentiment")
_PLAIN = ("framing", "headline_intent", "lead_orientation", "source_quality", "has_hard_data", "sentiment_basis", "media_stance")


def map_llm_articles(results: DataFrame) -> DataFrame:
    """One row for each readable result: its article fields, blanks to NULL, keywords trimmed, flags once each in their order."""
    r = parsed_results(results).filter("r._broken IS NULL").select("article_id", "r.*")
    return r.select(
        "article_id", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in _TEXTS], *[norm_sentiment(F.coalesce(c, F.lit(""))).alias(c) for c in _SENTIMENTS], *_PLAIN,
        F.filter(F.transform("topic_keywords", lambda k: F.trim(k)), lambda k: k != "").alias("topic_keywords"), F.array_distinct("content_flags").alias("content_flags"),
    )


def whole_results(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Article fields with entities, an array in the order of their rank; empty without any that is traced."""
    m = map_llm_results(results, articles)
    fields = [c for c in m.columns if c not in ("article_id", "rank")]
    e = m.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_e"))
    out = map_llm_articles(results).join(e, "article_id", "left")
    kind = m.select(F.array(F.struct(*fields)).alias("e")).dtypes[0][1]
    return out.withColumn("entities", F.coalesce(F.transform("_e", lambda x: F.struct(*[x[c].alias(c) for c in fields])), F.array().cast(kind))).drop("_e")


def apply_verdicts(mentions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Keep mentions unless their last verdict (mention_id, ord, keep) says no."""
    last = verdicts.groupBy(F.col("mention_id").alias("id")).agg(F.max_by("keep", "ord").alias("keep"))
    return mentions.join(last, "id", "left").filter(F.coalesce("keep", F.lit(True))).drop("keep")


def coalesce_engines(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each article the result of the first engine, in the given order, that has one; adds analyzer_name."""
    parts = [df.withColumn("analyzer_name", F.lit(name)).withColumn("_p", F.lit(k)) for k, (name, df) in enumerate(results)]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy("article_id").orderBy("_p"))).filter("_r = 1").drop("_r", "_p")


def hybrid_result(topics: DataFrame, rest: DataFrame) -> DataFrame:
    """Topic and keywords from one engine, everything else from the other."""
    taken = ["main_topic", "topic_keywords"]
    return rest.drop(*taken).join(topics.select("article_id", *taken), "article_id")


def fallback_reasons(errors: DataFrame, column: str = "error") -> DataFrame:
    """(reason, n) of error texts: truncated, rate_limit (a full or spent quota), timeout or other."""
    e = F.lower(F.col(column))
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(e, F.lit(x)) for x in parts])
    reason = F.when(has("truncat"), "truncated").when(has("saturado", "límite diario", "rate"), "rate_limit").when(has("timeout", "timed out"), "timeout").otherwise("other")
    return errors.filter(F.col(column).isNotNull()).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
