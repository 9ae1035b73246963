"""Language identification by averaged subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed subwords (byte trigrams and
four-grams inside words, with the word's borders); a linear layer and a softmax
give the language.  Both layers are trained together by stochastic gradient
descent on a bounded sample of labelled rows.  Once trained, embedding and
linear layer fold into one table of scores per subword, so predicting is a
look-up and a sum.  A part of the sample is held back to set the temperature of
the softmax and the score under which a prediction is rejected (`accepted`).

Defined results: null text or text without a letter is `und` with score 0; with
no labelled row to learn from everything is `und`; an empty table gives an empty
result; repeated rows are scored alike, and learnt from once; ties of the sample's
hash go by a hash of the row; a very long text is read whole, in passes; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import fold, owners, passes, read, tune

#: Bound of the training sample: labelled rows with the smallest hash of their identifier.
SAMPLE_ROWS = 5000
BUCKETS = 1 << 16
DIM = 16
EPOCHS = 8
RATE = 0.5
ACCURACY_WHEN_ACCEPTED = 0.99
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def letters(buf: np.ndarray) -> np.ndarray:
    """Lower-case letters; every other ASCII byte becomes a space."""
    out = _FOLD[buf]
    latin = np.flatnonzero(buf[:-1] == 0xC3) + 1
    latin = latin[(out[latin] >= 0x80) & (out[latin] <= 0x9E) & (out[latin] != 0x97)]
    out[latin] += 0x20
    return out


def subwords(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of the byte trigrams and four-grams that have a letter in the middle."""
    b = letters(buf).astype(np.uint32)
    if len(b) < 4:
        b = np.concatenate((b, np.full(4, 0x20, np.uint32)))
    three = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16))
    four = three | (b[3:] << np.uint32(24))
    at = np.flatnonzero((b[1:-2] != 0x20))
    inner = at[(b[at + 2] != 0x20)]
    h3 = (three[at] * np.uint32(0x9E3779B1)) >> np.uint32(17)
    h4 = ((four[inner] * np.uint32(0x85EBCA77)) >> np.uint32(17)) + np.uint32(1 << 15)
    return np.concatenate((at, inner)), np.concatenate((h3, h4)).astype(np.int32)


def _features(batches):
    """Bucket and count lists of each text."""
    for b in batches:
        ids, counts = [], []
        for _, n, buf, off in passes(b.column("text")):
            at, bucket = subwords(buf)
            key, c = np.unique(owners(at, off) * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(key, np.arange(n + 1) * BUCKETS)
            for k in range(n):
                ids.append((key[ends[k] : ends[k + 1]] % BUCKETS).astype(np.int32))
                counts.append(c[ends[k] : ends[k + 1]].astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "buckets", "counts"])


def bounded_sample(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """The rows with the `most` smallest values of a hash, at most so many: ties go by a hash of the row, and of equal rows one is taken."""
    keyed = rows.withColumn("_by", F.struct(by.alias("a"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("b")))
    border = keyed.select("_by").distinct().orderBy("_by").limit(most).agg(F.max("_by")).first()[0]
    if border is None:
        return rows.limit(0)
    return keyed.filter(F.col("_by") <= F.struct(F.lit(border["a"]).cast("long"), F.lit(border["b"]).cast("long"))).dropDuplicates(["_by"]).drop("_by")


class Model:
    """langs, one score per subword and language, bias, temperature, least accepted score."""

    def __init__(self, langs, table, bias, temperature=1.0, least=0.0):
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table, bias, temperature, least


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Stochastic gradient descent over (lang, buckets, counts)."""
    samples = [s for s in samples if len(s[1])]
    langs = sorted({s[0] for s in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    known = {lang: k for k, lang in enumerate(langs)}
    held = [s for k, s in enumerate(samples) if k % 5 == 4] or samples
    used = [s for k, s in enumerate(samples) if k % 5 != 4]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    linear, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    step, total = 0, epochs * len(used)
    for _ in range(epochs):
        for k in rng.permutation(len(used)):
            lang, buckets, counts = used[k]
            rate = RATE * (1 - step / total)
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ embed[buckets]
            z = hidden @ linear + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[known[lang]] -= 1
            back = linear @ p
            linear -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            embed[buckets] -= (rate * len(buckets) ** 0.5) * share[:, None] * back
            step += 1
    model = Model(langs, embed @ linear, bias)
    z = np.array([(c / c.sum()) @ model.table[b] + bias for _, b, c in held])
    y = np.array([known[lang] for lang, _, _ in held])

    def probabilities(t):
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 40)
    model.temperature = float(min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean()))
    p = probabilities(model.temperature)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum(p.argmax(axis=1)[order] == y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= ACCURACY_WHEN_ACCEPTED)
    model.least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def _predict(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            lang, score = [], []
            for _, n, buf, off in passes(b.column("text")):
                at, bucket = subwords(buf)
                row = owners(at, off)
                many = np.maximum(np.bincount(row, minlength=n), 1)
                z = np.stack([np.bincount(row, weights=model.table[bucket, k], minlength=n) / many for k in range(len(model.langs))], axis=1) + model.bias
                e = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
                p = e / e.sum(axis=1, keepdims=True)
                lang.append(p.argmax(axis=1))
                score.append(p.max(axis=1))
            best = np.concatenate(lang) if lang else np.empty(0, np.int64)
            top = np.concatenate(score) if score else np.empty(0)
            lettered = b.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            names = np.array([*model.langs, UNKNOWN], dtype=object)[np.where(lettered, best, len(model.langs))]
            top = np.where(lettered, top, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(lettered & (top >= model.least))], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted."""
    spark = docs.sparkSession
    tune(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held_out = fold("doc_id", 5) == 0
    labelled = d.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(labelled, F.xxhash64("doc_id"), sample_rows).select("lang", "text")
    found = sample.mapInArrow(_features, "lang string, buckets array<int>, counts array<int>").toArrow()
    rows = sorted(zip(found["lang"].to_pylist(), (np.array(x, np.int64) for x in found["buckets"].to_pylist()), (np.array(x) for x in found["counts"].to_pylist()), strict=True), key=lambda s: (s[0], len(s[1]), s[1].tobytes()))
    order = np.random.default_rng(11).permutation(len(rows))
    model = train([rows[k] for k in order])
    scored = d.select("doc_id", held_out.alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return scored.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = spark.sparkContext.broadcast(model)
    return scored.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))
