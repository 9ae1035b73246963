"""Quality by an ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(s - t_k)): one score s from shared weights over hashed
text, and ordered thresholds t_k.  The text's features are its hashed byte
trigrams, with case and punctuation, as shares, and the classes of a few counts
over the whole text (length, repeated words and lines, symbols, capitals).
Weights and thresholds are fitted together by stochastic gradient descent in
numpy on a bounded sample of rated rows.  The result is the expected grade and
the tail probability of the upper grades, by which documents are selected.

The rating of a labelled document is 0 for low quality, 1 for good but toxic, 2
for good.  A document is kept unless it probably is of low quality.

Defined results: null text is empty, and an empty text is scored by its counts;
rows whose rating is null are not learnt from; without ratings of two grades all
expected grades and tail probabilities are 0 and everything is kept; repeated
rows are scored alike; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fold, owners, passes, read, tune
from inkspan.llm.langid import bounded_sample
from inkspan.llm.quality_rules import measure

#: Bound of the training sample, for each grade: rated rows with the smallest hash.
SAMPLE_ROWS = 2500
GRADES = 3
BUCKETS = 1 << 16
CLASSES = 16
EPOCHS = 12
RATE = 0.3
#: Kept if the probability of any grade above the lowest is at least this.
KEEP = 0.2

_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram of each text, its closing newline counted in."""
    if len(buf) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = buf.astype(np.uint32)
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    row = owners(np.arange(len(three)), offsets)
    inside = np.arange(len(three)) + 3 <= offsets[1:][row]
    return row[inside], (((three * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64))[inside]


def count_classes(buf: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """For each text the classes of its counts, as places in one table of weights."""
    n_words, chars, symbols, lines, again = measure(buf, offsets, n)
    capitals = np.bincount(owners(np.flatnonzero(_UPPER[buf]), offsets), minlength=n)
    words = np.maximum(n_words, 1)
    tenths = lambda x: np.minimum((10 * x).astype(np.int64), CLASSES - 1)
    columns = [
        np.minimum(np.log2(n_words + 1).astype(np.int64), CLASSES - 1), tenths(again / words), np.minimum(lines, CLASSES - 1),
        tenths(symbols / words), tenths(2 * capitals / np.maximum(chars, 1)), np.minimum((chars / words).astype(np.int64), CLASSES - 1),
    ]
    return np.stack([c + k * CLASSES for k, c in enumerate(columns)], axis=1)


def _features(batches):
    for b in batches:
        ids, counts, classes = [], [], []
        for _, n, buf, off in passes(b.column("text")):
            row, bucket = trigrams(buf, off)
            key, c = np.unique(row * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
            for k in range(n):
                ids.append((key[ends[k] : ends[k + 1]] % BUCKETS).astype(np.int32))
                counts.append(c[ends[k] : ends[k + 1]].astype(np.int32))
            classes += list(count_classes(buf, off, n).astype(np.int32))
        lists = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(ids, lists), pa.array(counts, lists), pa.array(classes, lists)], names=["grade", "buckets", "counts", "classes"])


class Model:
    """Weights of trigrams and of count classes, and the ordered thresholds."""

    def __init__(self, text: np.ndarray, counts: np.ndarray, thresholds: np.ndarray):
        self.text, self.counts, self.thresholds = text, counts, thresholds

    def upper(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -30, 30)))

    def scores(self, buf: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        row, bucket = trigrams(buf, offsets)
        many = np.maximum(np.bincount(row, minlength=n), 1)
        return np.bincount(row, weights=self.text[bucket], minlength=n) / many + self.counts[count_classes(buf, offsets, n)].sum(axis=1)


def train(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], grades: int = GRADES, epochs: int = EPOCHS, seed: int = 3) -> Model | None:
    """Maximum likelihood by stochastic gradient ascent (AdaGrad) over (grade, buckets, counts, classes)."""
    if len({r[0] for r in rows}) < 2:
        return None
    rng = np.random.default_rng(seed)
    text, counts = np.zeros(BUCKETS), np.zeros(6 * CLASSES)
    seen_text, seen_counts = np.full(BUCKETS, 1e-4), np.full(6 * CLASSES, 1e-2)
    # The first threshold, and the logarithms of the steps to the next: they stay in order.
    low, steps = -1.0, np.zeros(grades - 2)
    seen = np.full(grades - 1, 1e-2)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            y, buckets, c, classes = rows[k]
            share = c / max(c.sum(), 1)
            s = share @ text[buckets] + counts[classes].sum()
            t = low + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
            below = 1 / (1 + np.exp(np.clip(s - t, -30, 30)))
            a = below[y] if y < grades - 1 else 1.0
            b = below[y - 1] if y else 0.0
            p = max(a - b, 1e-9)
            move = a + b - 1  # of log p by s
            gt, gc = move * share - 1e-5 * text[buckets], move - 1e-4 * counts[classes]
            seen_text[buckets] += gt**2
            seen_counts[classes] += gc**2
            text[buckets] += rate * gt / np.sqrt(seen_text[buckets])
            counts[classes] += rate * gc / np.sqrt(seen_counts[classes])
            by_t = np.zeros(grades - 1)
            if y < grades - 1:
                by_t[y] += a * (1 - a) / p
            if y:
                by_t[y - 1] -= b * (1 - b) / p
            by = np.concatenate(([by_t.sum()], [by_t[j + 1 :].sum() * np.exp(steps[j]) for j in range(grades - 2)]))
            seen += by**2
            step = rate * by / np.sqrt(seen)
            low += step[0]
            steps = np.clip(steps + step[1:], -6, 4)
    return Model(text, counts, low + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


def _grade(shared, keep: float):
    def run(batches):
        model = shared.value
        for b in batches:
            s = [model.scores(buf, off, n) for _, n, buf, off in passes(b.column("text"))]
            upper = model.upper(np.concatenate(s) if s else np.empty(0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(upper.sum(axis=1)), pa.array(upper[:, -1]), pa.array(upper[:, 0] >= keep)], names=["doc_id", "held_out", "expected_grade", "tail_probability", "kept"])

    return run


def rate_documents(docs: DataFrame, ratings: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, tail_probability, kept.

    ratings: doc_id, grade; learn_from is a condition over doc_id.
    """
    spark = docs.sparkSession
    tune(spark)
    known = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL").filter(learn_from)
    known = known.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    mark = F.xxhash64("doc_id", F.lit(7))
    parts = [bounded_sample(known.filter(F.col("grade") == g), mark, sample_rows) for g in range(GRADES)]
    # At most sample_rows of each grade, so small enough to broadcast whatever the table's size.
    chosen = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learn_from).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    found = d.join(F.broadcast(chosen), "doc_id").select("grade", "text").mapInArrow(_features, "grade int, buckets array<int>, counts array<int>, classes array<int>").toArrow()
    cols = [found["grade"].to_pylist(), *([np.array(x, np.int64) for x in found[c].to_pylist()] for c in ("buckets", "counts", "classes"))]
    model = train(sorted(zip(*cols, strict=True), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))
    if model is None:
        return d.select("doc_id", "held_out", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(model)
    return d.mapInArrow(_grade(shared, keep), "doc_id long, held_out boolean, expected_grade double, tail_probability double, kept boolean")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return rate_documents(read(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")), fold("doc_id", 5) != 0)
