"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, of toxic and of ordinary text.  Each takes a discount off its
counts and hands the freed mass to the level below:

    P_c(w | h) = max(n_c(h w) - D(h w), 0) / n_c(h) + l_c(h) * P_c(w)
    P_c(w)     = max(n_c(w) - D(w), 0) / n_c       + l_c    * P(w)
    P(w)       = N(. w) / N(. .)

n_c counts contexts, not occurrences: in how many labelled documents of the class
a word, or a word after another, stands.  l is the discounted share, so each
distribution sums to 1.  P, shared by both classes, is the continuation
distribution over the whole corpus: N(. w) is how many different words stand
before w anywhere in the documents.  The discount D is the count that both classes
together lead one to expect, and `DISCOUNT` roots of one more.  So a class keeps
mass of its own only for what it holds beyond chance, and rare expressions fall
through to the shared level and weigh alike in both.  A text's evidence is the
difference of its two log-likelihoods over its length, and a logistic curve,
fitted on labelled rows that the models have not seen, turns it into a score.

The vocabulary is every word with more than `DISCOUNT` documents in some class;
all other words are one unknown word, which counts as a history but is itself
passed over.  Bigrams that no class has in more documents have no mass of their
own, so leaving them out of the table changes nothing.

Defined results: null and empty texts have no evidence and get the score of the
curve's base rate; without labelled rows of both classes every score is 0;
several labels of one document count as toxic if one is; labelled rows alike in
text and label are learnt from once; rows alike in text are scored alike; a very long text is read whole, in passes of its words; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import cut, fold, owners, passes, read, runs, span_hash, tune
from inkspan.llm.langid import bounded_sample, letters

#: Bound of the training sample, for each class: labelled rows with the smallest hash.
SAMPLE_ROWS = 5000
#: In roots of the expected count and one.
DISCOUNT = 3.0
THRESHOLD = 0.7
OTHER = 0  # the word id of all words outside the vocabulary
#: Bigrams that a task gathers before it hands them on.
GATHER = 1 << 20


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of letters, lower-cased."""
    low = letters(buf)
    starts, ends = runs(low != 0x20)
    return span_hash(low, starts, ends), owners(starts, offsets)


def _distinct(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each row's keys, once each."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    return key[np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))] if len(key) else key


def _word_rows(batches):
    """Per batch and class: in how many documents each word stands."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        found = [[], []]
        for lo, _, buf, off in passes(b.column("text")):
            h, row = word_hashes(buf, off)
            for c in (0, 1):
                mine = toxic[lo + row] == c
                found[c].append(_distinct(row[mine], h[mine]))
        for c in (0, 1):
            if found[c]:
                word, n = np.unique(np.concatenate(found[c]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), c)), pa.array(word.view(np.int64)), pa.array(n)], names=["toxic", "word", "n"])


def word_ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + place in the sorted vocabulary, or OTHER."""
    if not len(vocabulary):
        return np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at + 1, OTHER)


def histories(ids: np.ndarray, row: np.ndarray, start_id: int) -> np.ndarray:
    """The word before each word; start_id at the head of a document."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    if len(ids):
        before[0] = start_id
        before[1:][row[1:] != row[:-1]] = start_id
    return before


def _bigram_rows(shared):
    def run(batches):
        vocabulary = shared.value
        start = len(vocabulary) + 1
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = []
            for lo, _, buf, off in passes(b.column("text")):
                h, row = word_hashes(buf, off)
                ids = word_ids(h, vocabulary)
                keys.append(_distinct(row, (toxic[lo + row] << 60) | (histories(ids, row, start) << 30) | ids))
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 60), pa.array((key >> 30) & ((1 << 30) - 1)), pa.array(key & ((1 << 30) - 1)), pa.array(n)], names=["toxic", "hist", "word", "n"])

    return run


def _pair_rows(shared):
    """The different bigrams (history, word) of all documents, once a task as far as GATHER goes."""

    def run(batches):
        vocabulary = shared.value
        found, many = [np.empty(0, np.int64)], 0
        for b in batches:
            for _, _, buf, off in passes(b.column("text")):
                h, row = word_hashes(buf, off)
                ids = word_ids(h, vocabulary)
                known = ids != OTHER
                found.append(np.unique((histories(ids, row, len(vocabulary) + 1)[known] << 30) | ids[known]))
                many += len(found[-1])
                if many > 2 * GATHER:
                    found = [np.unique(np.concatenate(found))]
                    many = len(found[0])
                    if many > GATHER:
                        yield pa.RecordBatch.from_arrays(found, names=["pair"])
                        found, many = [found[0][:0]], 0
        yield pa.RecordBatch.from_arrays([np.unique(np.concatenate(found))], names=["pair"])

    return run


def excess(n: np.ndarray, expected: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """What the discount leaves of a count: the part that neither the level below nor chance explains."""
    return np.maximum(n - expected - discount * np.sqrt(1 + expected), 0)


class Model:
    """Both models over a sorted vocabulary.

    words: by class and word id, the documents that hold the word; before: by
    word id, how many different words stand before it in the corpus; pairs, by_pair:
    the kept bigrams as history << 30 | word and, by class, the documents that
    hold each; by_hist: by class and word id, the sum of the counts of all bigrams
    after it.
    """

    def __init__(self, vocabulary, words, before, pairs, by_pair, by_hist, discount: float = DISCOUNT):
        self.vocabulary, self.pairs = vocabulary, pairs
        shared = before / max(before.sum(), 1)
        total = np.maximum(words.sum(axis=1, keepdims=True), 1)
        together = words.sum(axis=0) / total.sum()
        left = excess(words, total * together, discount)
        self.by_word = left / total + (1 - left.sum(axis=1, keepdims=True) / total) * shared
        hist, word = pairs >> 30, pairs & ((1 << 30) - 1)
        total = np.maximum(by_hist[:, hist], 1)
        together = by_pair.sum(axis=0) / np.maximum(by_hist.sum(axis=0)[hist], 1)
        left = excess(by_pair, total * together, discount)
        # After a history, what the discounts free is dealt out by the level below.
        taken = np.stack([np.bincount(hist, weights=x, minlength=by_hist.shape[1]) for x in left])
        self.share = 1 - taken / np.maximum(by_hist, 1)
        self.by_pair = left / total + self.share[:, hist] * self.by_word[:, word]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.word_ratio = np.nan_to_num(np.log(self.by_word[1] / self.by_word[0]))
            self.pair_ratio = np.log(self.by_pair[1] / self.by_pair[0])
            self.share_ratio = np.log(self.share[1] / self.share[0])

    def probability(self, c: int, hist: int, word: int) -> float:
        at = np.searchsorted(self.pairs, (hist << 30) | word)
        if at < len(self.pairs) and self.pairs[at] == (hist << 30) | word:
            return float(self.by_pair[c, at])
        return float(self.share[c, hist] * self.by_word[c, word])

    def evidence(self, buf: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        """Per text: the log-likelihood of toxic text less that of ordinary text, over its words."""
        h, row = word_hashes(buf, offsets)
        ids = word_ids(h, self.vocabulary)
        hist = histories(ids, row, len(self.vocabulary) + 1)
        ratio = self.word_ratio[ids] + self.share_ratio[hist]
        if len(self.pairs) and len(ids):
            key = (hist << 30) | ids
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ratio = np.where(self.pairs[at] == key, self.pair_ratio[at], ratio)
        ratio[ids == OTHER] = 0
        return np.bincount(row, weights=ratio, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the constant) and scale of the columns, by Newton's method."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(w)) / 100
        move = np.linalg.solve(hessian, a.T @ (y - p) - ridge * len(x) / 100 * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w, scale


def _score(shared, curve):
    def run(batches):
        model = shared.value
        for b in batches:
            x = [model.evidence(buf, off, n) for _, n, buf, off in passes(b.column("text"))]
            x = np.concatenate(x) if x else np.empty(0)
            if curve is not None:
                w, scale = curve
                x = 1 / (1 + np.exp(-np.clip(x / scale[0] * w[0] + w[1], -30, 30)))
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(x)], names=[*rest, "score"])

    return run


class Scorer:
    """A fitted model; `score` adds a score to rows that have a text column."""

    def __init__(self, shared, curve):
        self.shared, self.curve = shared, curve

    def score(self, rows: DataFrame) -> DataFrame:
        """Replace the column text by the column score."""
        keep = [f"{name} {kind}" for name, kind in rows.dtypes if name != "text"]
        if self.curve is None:
            return rows.drop("text").withColumn("score", F.lit(0.0))
        return rows.mapInArrow(_score(self.shared, self.curve), ", ".join([*keep, "score double"]))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Train on the labelled documents for which learn_from (over doc_id) holds."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(learn_from)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark = F.xxhash64("doc_id", F.lit(4))
    # At most sample_rows of each class, so small enough to broadcast whatever the table's size.
    chosen = cut(bounded_sample(known.filter("toxic = 1"), mark, sample_rows).unionByName(bounded_sample(known.filter("toxic <> 1"), mark, sample_rows)))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    # Which rows fit the models and which the curve.
    # Copies of a text count once, and all go to the same part.
    copies = d.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    sample = cut(copies.dropDuplicates(["toxic", "h"]).withColumn("part", F.pmod(F.xxhash64("h", F.lit(9)), F.lit(3))))
    sizes = {(bool(r["m"]), r["toxic"]): r["n"] for r in sample.groupBy((F.col("part") != 0).alias("m"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(sizes.get((m, c)) for m in (True, False) for c in (0, 1)):
        return Scorer(None, None)
    for_model = sample.filter("part <> 0")
    for_curve = sample.filter("part = 0")
    by_class = [F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)]
    seen = for_model.select("toxic", "text").mapInArrow(_word_rows, "toxic long, word long, n long").groupBy("word").agg(*by_class)
    # What the sample's bound bounds comes to the driver: its words of several documents, and below their bigrams.
    top = seen.filter((F.col("n0") > DISCOUNT) | (F.col("n1") > DISCOUNT)).toArrow()
    vocabulary = top["word"].to_numpy().view(np.uint64)
    by_word = np.argsort(vocabulary)
    vocabulary = vocabulary[by_word]
    known_words = spark.sparkContext.broadcast(vocabulary)
    counts = cut(for_model.select("toxic", "text").mapInArrow(_bigram_rows(known_words), "toxic long, hist long, word long, n long").groupBy("hist", "word").agg(*by_class).filter(F.col("word") != OTHER))
    sums = counts.groupBy("hist").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)]).toArrow()
    words, by_hist = np.zeros((2, 2, len(vocabulary) + 2))
    for c in (0, 1):
        by_hist[c, sums["hist"].to_numpy()] = sums[f"n{c}"].to_numpy()
        words[c, 1:-1] = top[f"n{c}"].to_numpy()[by_word]
    kept = counts.filter((F.col("n0") > DISCOUNT) | (F.col("n1") > DISCOUNT)).select((F.shiftleft("hist", 30) + F.col("word")).alias("pair"), "n0", "n1").toArrow()
    pairs = kept["pair"].to_numpy()
    order = np.argsort(pairs)
    by_pair = np.stack([kept[f"n{c}"].to_numpy().astype(float)[order] for c in (0, 1)])
    # The shared level is counted over all documents; a number for each word of the vocabulary comes back.
    after = d.select("text").mapInArrow(_pair_rows(known_words), "pair long").distinct().withColumn("word", F.col("pair").bitwiseAND(F.lit((1 << 30) - 1)))
    after = after.groupBy("word").agg(F.count(F.lit(1)).alias("n")).toArrow()
    before = np.zeros(words.shape[1])
    before[after["word"].to_numpy()] = after["n"].to_numpy()
    shared = spark.sparkContext.broadcast(Model(vocabulary, words, before, pairs[order], by_pair, by_hist))
    found = for_curve.select("toxic", "text").mapInArrow(_score(shared, None), "toxic int, score double").toArrow()
    x, y = found["score"].to_numpy(), found["toxic"].to_numpy().astype(float)
    order = np.lexsort((y, x))
    return Scorer(shared, fit_logistic(x[order, None], y[order]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held_out = fold("doc_id", 3) == 1
    scorer = fit(docs, labels, ~held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return scorer.score(rows).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
