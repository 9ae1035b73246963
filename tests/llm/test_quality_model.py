"""The ordinal quality classifier."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import quality_model
from inkspan.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_grades_held_out(spark):
    """On the larger tables: the smaller ones hold out about ten documents of low quality."""
    out = QUERIES["op7_quality_model"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = {x["quality"]: x for x in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("grade")).collect()}
    assert r[1]["kept"] > 0.98 and r[0]["kept"] < 0.4 and r[1]["grade"] > r[0]["grade"] + 1


def test_thresholds_stay_in_order_and_separate_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(rng.integers(0, 3))
        buckets = np.unique(rng.integers(0, 50, 20) + 100 * y)
        rows.append((y, buckets, np.ones(len(buckets), np.int64), np.arange(6) * quality_model.CLASSES))
    model = quality_model.train(rows)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([model.text[b].mean() + model.counts[c].sum() for _, b, _, c in rows])
    grade = model.upper(score).sum(axis=1)
    y = np.array([r[0] for r in rows])
    assert (np.abs(grade - y) < 0.5).mean() > 0.95


def test_gradient_points_uphill():
    """One grade only in reach of each text: likelihood rises with training."""
    rows = [(y, np.array([y * 7 + 1]), np.array([3]), np.arange(6) * quality_model.CLASSES) for y in (0, 1, 2)] * 20

    def likelihood(model):
        u = model.upper(np.array([model.text[b].mean() + model.counts[c].sum() for _, b, _, c in rows]))
        p = np.column_stack((1 - u[:, 0], u[:, 0] - u[:, 1], u[:, 1]))
        return np.log(p[np.arange(len(rows)), [r[0] for r in rows]]).mean()

    assert likelihood(quality_model.train(rows, epochs=30)) > likelihood(quality_model.train(rows, epochs=1)) > np.log(1 / 9)


def test_odd_rows(spark, odd, documents):
    ratings = spark.createDataFrame([(k, k % 3) for k in range(8)] + [(None, 1), (3, None)], "doc_id long, grade int")
    out = quality_model.rate_documents(odd, ratings, F.col("doc_id") >= 0).collect()
    assert len(out) == 9 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)
    assert quality_model.rate_documents(documents([]), ratings.limit(0), F.lit(True)).count() == 0
    assert all(r["kept"] for r in quality_model.rate_documents(odd, ratings.limit(0), F.lit(True)).collect())
