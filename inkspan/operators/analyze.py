"""Analyzers of whole articles, as a pluggable step."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkspan.operators.filters import SCHEMA_VERSION

#: What an analysis gives: the stored fields of an article, its mentions and the names of its actors.
RESULT = """main_topic string, topic_keywords array<string>, overall_sentiment string, sentiment_score double, framing string, headline_intent string,
lead_orientation string, source_quality string, has_hard_data boolean, sentiment_basis string, facts_sentiment string, quoted_sentiment string,
media_stance string, media_stance_evidence string, overall_sentiment_reason string, content_flags array<string>,
dominant_actor string, blamed_actor string, credited_actor string,
entities array<struct<name:string,type:string,mentions_count:int,sentiment_toward:string,sentiment_score:double,context:string,extraction_confidence:double>>"""

#: Analyses held as Python objects at a time; the rest of a batch is in Arrow's form.
SOME = 100

Analyze = Callable[[str, str], dict]
AnalyzeMany = Callable[[list[tuple[str, str]]], list[dict]]


def analysis(analyze: Analyze, many: AnalyzeMany | None = None, result: str = RESULT) -> Callable[[Column, Column], Column]:
    """A column function of (title, body): struct of result and error.

    analyze gets one article and returns a dict by the fields of result.  many,
    if given, gets all articles of an Arrow batch; where it fails, each article
    is tried alone.  An article that fails, or whose dict does not fit, has its
    error and no result; the others go on.
    """
    kind = T.StructType().add("result", T.StructType.fromDDL(result)).add("error", "string")
    arrow = to_arrow_type(kind)

    def alone(text: tuple[str, str]) -> dict:
        try:
            row = {"result": analyze(*text), "error": None}
            pa.array([row], type=arrow)
            return row
        except Exception as e:  # whatever an analyzer raises belongs to its article
            return {"result": None, "error": f"{type(e).__name__}: {e}"}

    def run(title: pa.Array, body: pa.Array) -> pa.Array:
        texts = [(t or "", b or "") for t, b in zip(title.to_pylist(), body.to_pylist(), strict=True)]
        try:
            found = many(texts) if many else None
            if found is not None and len(found) == len(texts):
                return pa.array([{"result": r, "error": None} for r in found], type=arrow)
        except Exception:  # the batch as a whole; each article is tried below
            pass
        return pa.concat_arrays([pa.array([alone(t) for t in texts[k : k + SOME]], type=arrow) for k in range(0, max(len(texts), 1), SOME)])

    run.__annotations__ = {"title": pa.Array, "body": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def analyze_articles(articles: DataFrame, analyzed: Callable[[Column, Column], Column], name: str, model: str, version: str, schema: int = SCHEMA_VERSION) -> DataFrame:
    """Articles with result, analysis_error and, where there is a result, what made it and when.

    analyzed maps title and body to a struct of result and error: `analysis`, or any Column expression.
    """
    a = articles.withColumn("_a", analyzed(F.col("title"), F.col("body")))
    done = {"analyzer_name": F.lit(name), "analyzer_model": F.lit(model), "analyzer_version": F.lit(version), "analysis_schema_version": F.lit(schema), "analyzed_at": F.current_timestamp()}
    a = a.select(*articles.columns, F.col("_a.result").alias("result"), F.col("_a.error").alias("analysis_error"))
    return a.withColumns({c: F.when(F.col("analysis_error").isNull(), v) for c, v in done.items()})
