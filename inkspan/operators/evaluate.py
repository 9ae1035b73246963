"""Scoring predictions against labelled articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions.text import norm_key

# The categories of each labelled field, and the one that any other prediction counts as.
SENTIMENTS = ["POS", "NEG", "NEU"]
CATEGORIES = {
    "framing": (["crisis_conflicto", "logro_institucional", "negligencia", "crecimiento", "denuncia", "neutro_informativo"], "neutro_informativo"),
    "sentiment_basis": (["hechos_reportados", "discurso_citado", "mixto"], "mixto"),
    "facts_sentiment": (SENTIMENTS, "NEU"),
    "quoted_sentiment": (SENTIMENTS, "NEU"),
    "media_stance": (["neutra_transmisiva", "critica", "favorable", "editorializante"], "neutra_transmisiva"),
}
_SIDE = "array<struct<ord:bigint,name:string,type:string,sentiment_toward:string,key:string>>"


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _partners(pred_keys: pd.Series, pred_types: pd.Series, gold_keys: pd.Series, gold_types: pd.Series) -> pd.Series:
    """For the gold entities of each article, in order, the place of the first free prediction that matches."""

    def pair(pk, pt, gk, gt) -> list[int | None]:
        free = [(k, f" {key} ", kind) for k, (key, kind) in enumerate(zip(pk, pt, strict=True)) if key]
        out = []
        for key, kind in zip(gk, gt, strict=True):
            fits = [f for f in free if key and f[2] == kind and (f" {key} " in f[1] or f[1] in f" {key} ")]
            out.append(fits[0][0] if fits else None)
            if fits:
                free.remove(fits[0])
        return out

    return pd.Series([pair(*row) for row in zip(pred_keys, pred_types, gold_keys, gold_types, strict=True)])


def match_predictions(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs of predicted and gold entities of each article; a side without a partner is NULL.

    Both sides have article_id, ord, name, type, sentiment_toward.  An article
    is one row with both sides as arrays, so Python decides on many at a time.
    """
    fields = [F.col("ord").cast("long").alias("ord"), "name", "type", "sentiment_toward", norm_key(F.col("name")).alias("key")]
    p, g = (df.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(side)) for df, side in ((pred, "p"), (gold, "g")))
    j = p.join(g, "article_id", "full").withColumns({c: F.coalesce(c, F.array().cast(_SIDE)) for c in ("p", "g")})
    j = j.withColumn("to", _partners("p.key", "p.type", "g.key", "g.type"))
    row = lambda kind, x, y: F.struct(kind.alias("type"), x["name"].alias("pred_name"), y["name"].alias("gold_name"), x["sentiment_toward"].alias("pred_sentiment"), y["sentiment_toward"].alias("gold_sentiment"))
    none = F.lit(None).cast(T.StructType.fromDDL("ord long, name string, type string, sentiment_toward string, key string"))
    of_gold = F.transform(F.arrays_zip("g", "to"), lambda z: row(z["g"]["type"], F.get("p", z["to"]), z["g"]))
    free = F.filter(F.transform("p", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: ~F.coalesce(F.array_contains("to", z["i"]), F.lit(False)))
    return j.select("article_id", F.explode(F.concat(of_gold, F.transform(free, lambda z: row(z["x"]["type"], z["x"], none)))).alias("r")).select("article_id", "r.*")


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))


def rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1 to tp, fp, fn; both ratios are rounded before f1, which is NULL if either is NULL or 0."""
    c = counts.withColumn("_p", F.col("tp") + F.col("fp")).withColumn("_r", F.col("tp") + F.col("fn")).withColumn("precision", _ratio("tp", "_p")).withColumn("recall", _ratio("tp", "_r"))
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4))
    return c.withColumn("f1", f1).drop("_p", "_r")


def entity_metrics(pairs: DataFrame, exhaustive: DataFrame | None = None) -> DataFrame:
    """Counts and rates for each type and overall; false positives only of articles that are labelled in full.

    exhaustive: article_id, entities_exhaustive.
    """
    p = pairs if exhaustive is None else pairs.join(exhaustive, "article_id", "left")
    full = F.lit(True) if exhaustive is None else F.coalesce("entities_exhaustive", F.lit(True))
    both = F.col("pred_name").isNotNull() & F.col("gold_name").isNotNull()
    judged = both & F.col("gold_sentiment").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    g = p.rollup("type").agg(
        (F.grouping("type") == 1).alias("overall"), n(both).alias("tp"), n(F.col("gold_name").isNull() & full).alias("fp"), n(F.col("pred_name").isNull()).alias("fn"),
        n(judged & (F.col("pred_sentiment") == F.col("gold_sentiment"))).alias("sentiment_correct"), n(judged).alias("sentiment_total"),
    )
    return rates(g).withColumn("sentiment_accuracy", _ratio("sentiment_correct", "sentiment_total"))


def confusion(df: DataFrame, gold: str, pred: str, categories: list[str], fallback: str) -> DataFrame:
    """(gold, pred, n) for every pair of categories; unknown predictions count as the fallback, unlabelled rows not at all."""
    p = F.when(F.col(pred).isin(*categories), F.col(pred)).otherwise(fallback)
    seen = df.filter(F.col(gold).isin(*categories)).groupBy(F.col(gold).alias("gold"), p.alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in categories])).alias("gold")).withColumn("pred", F.explode(F.array(*[F.lit(c) for c in categories])))
    return grid.join(seen, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    g = matrix.agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("correct"), F.sum("n").alias("total"))
    return g.withColumn("accuracy", _ratio("correct", "total"))


def flag_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """tp, fp, fn of sets of flags over labelled rows, with rates."""
    p = F.array_distinct(F.coalesce(F.col(pred), F.array().cast("array<string>")))
    g = F.array_distinct(F.col(gold))
    d = df.filter(F.col(gold).isNotNull()).select(F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))
    return rates(d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def _field(gold: Column, pred: Column, categories: list[str], fallback: str) -> Column:
    """Accuracy, labelled rows and confusion counts of one field, as one aggregate."""
    shown = F.when(pred.isin(*categories), pred).otherwise(fallback)
    n = lambda c: F.count(F.when(c, 1))
    labelled = n(gold.isin(*categories))
    cells = [x for g in categories for p in categories for x in (F.lit(f"{g}->{p}"), n((gold == g) & (shown == p)))]
    accuracy = F.when(labelled > 0, F.round(n(gold.isin(*categories) & (gold == shown)) / labelled, 4))
    return F.struct(accuracy.alias("accuracy"), labelled.alias("n_labeled"), F.create_map(*cells).alias("confusion_matrix"))


def evaluate(pred: DataFrame, gold: DataFrame, pred_entities: DataFrame, gold_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, by article): everything that a labelled set says of an analyzer, in one row and for each article.

    pred and gold have article_id, overall_sentiment, the fields of CATEGORIES
    and content_flags; gold also entities_exhaustive.  An article without a
    prediction counts as predicted with the fallbacks.
    """
    fields = ["overall_sentiment", *CATEGORIES, "content_flags"]
    j = gold.join(pred.select("article_id", *[F.col(f).alias(f"_{f}") for f in fields]), "article_id", "left")
    matrices = [_field(F.col(f), F.col(f"_{f}"), *rule).alias(f) for f, rule in CATEGORIES.items()]
    head = j.agg(F.count(F.lit(1)).alias("n_articles"), _field(F.col("overall_sentiment"), F.col("_overall_sentiment"), SENTIMENTS, "NEU").alias("overall_sentiment"), F.struct(*matrices).alias("category_matrices"))
    pairs = match_predictions(pred_entities, gold_entities)
    metrics = entity_metrics(pairs, gold.select("article_id", "entities_exhaustive"))
    rest = F.struct(*[c for c in metrics.columns if c not in ("type", "overall")])
    by_type = F.map_from_entries(F.filter(F.collect_list(F.when(~F.col("overall"), F.struct("type", rest.alias("m")))), lambda e: e["type"].isNotNull()))
    entities = metrics.agg(F.struct(F.first(F.when(F.col("overall"), rest), ignorenulls=True).alias("overall"), by_type.alias("by_type")).alias("entities"))
    flags = flag_metrics(j, "content_flags", "_content_flags")
    report = head.crossJoin(F.broadcast(entities)).crossJoin(F.broadcast(flags.select(F.struct(*flags.columns).alias("content_flags"))))  # one row each
    n = pairs.groupBy("article_id").agg(F.count(F.lit(1)).alias("entity_pairs"))
    each = j.join(n, "article_id", "left").select("article_id", F.col("overall_sentiment").alias("gold"), F.col("_overall_sentiment").alias("predicted"), "entities_exhaustive", F.coalesce("entity_pairs", F.lit(0)).alias("entity_pairs"))
    return report, each


def report_json(metrics: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"))
