"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

Words are counted over all training documents.  The `OWN_WORDS` most frequent ones and
the end of a text are classes of their own; every other word belongs to a class by
its last two bytes.  The model gives the next class from the two before it:

    s(c | a, b) = (C1 * r_a + C2 * r_b) . t_c + bias_c
    P(c | a, b) = exp s(c | a, b) / sum over classes of exp s

and a word has its class's probability times its share in the class, by its count with
0.1 added, one more share standing for all unknown words of the class.  So each
text's probability is normalised over all words and texts.

Training is by noise-contrastive estimation: each target is told from `NOISE` classes
drawn from the unigram distribution and shared by a mini-batch, so a step is a few
matrix products and needs no normaliser.  All training documents take part, in
`ROUNDS`: each task starts from the round's model, takes its steps over its own
documents of that round, and the tasks' models are averaged by their steps, in two
levels.  Every word and end of a document is a target once in a sweep, in an order drawn
anew; a small corpus is swept several times.  What tasks send grows with the corpus; the model and
the averages have one size.

Scoring normalises exactly.  There are no more normalisers than pairs of classes; they
are made by matrix products when first met and kept by the worker.  Counts of the
`MOST_BROADCAST` most frequent words go to the tasks by broadcast; all rarer words of
each document meet theirs in a join.

Defined results: null and empty texts have one token, the end; without training
documents all counts are 0 and classes alike; repeated rows count each; words as
frequent as the last own or broadcast one are taken in byte order, which changes no
base score; a very long text is read whole, in slices; words over `LONGEST` bytes are
never own or broadcast and always meet their count in the join; identifiers only pass
through, null included, and a null one is crc32 of ''; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import MOST_BROADCAST, cut, fold, lower_ascii, owners, passes, read, same_spans, span_hash, tune, words
from inkspan.llm.packing import distinct

OWN_WORDS, ENDINGS, DIM = 512, 511, 32
CLASSES = 1 + OWN_WORDS + ENDINGS
END, START = 0, CLASSES  # START stands for what is before a text, and is only looked back at
NOISE, BATCH, RATE = 64, 1024, 0.1
LEAST_TARGETS, MOST_SWEEPS = 2_000_000, 64
#: Eighths of the documents in each round.
ROUNDS = (1, 3, 4)
ADDED = 0.1
LONGEST = 64
CACHE_WORDS = 500_000
SLICE = 1 << 15
SLICES_SENT, SALTS = 16, 1024


# Classes


def endings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word by its last two bytes."""
    last = buf[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    mixed = ((before << np.uint64(8)) | last) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (1 + OWN_WORDS + (mixed % np.uint64(ENDINGS))).astype(np.int64)


class WordTable:
    """Words by their bytes, looked up by hash and held to their bytes."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        h = span_hash(self.buf, self.start, self.start + self.size) if texts else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.keys = h[self.order]

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each span, or -1."""
        out = np.full(len(h), -1)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        number = self.order[at[hit]]
        n = ends[hit] - starts[hit]
        joined = np.concatenate((buf, self.buf))
        good = (n == self.size[number]) & same_spans(joined, starts[hit], len(buf) + self.start[number], np.minimum(n, self.size[number]))
        out[hit[good]] = number[good]
        return out


def with_ends(values: np.ndarray, starts: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of the words of each text and its end, place of each text's first)."""
    stops = np.searchsorted(starts, offsets[1:])
    seq = np.insert(values, stops, end)
    return seq, np.concatenate(([0], stops[:-1] + np.arange(1, len(stops)))) if len(stops) else np.zeros(0, np.int64)


def contexts(seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each."""
    one = np.roll(seq, 1)
    one[first] = START
    two = np.roll(one, 1)
    two[first] = START
    return one, two


# Model


class Model:
    """r, t, bias, C and the sums of squared steps of each of their rows, as views of one array."""

    SHAPES = ((CLASSES + 1, DIM), (CLASSES, DIM), (CLASSES,), (2, DIM), (CLASSES + 1,), (CLASSES,), (CLASSES,), (2, DIM))

    def __init__(self, flat: np.ndarray):
        self.flat, at, views = flat, 0, []
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            views.append(flat[at : at + n].reshape(shape))
            at += n
        self.r, self.t, self.bias, self.c, self.r2, self.t2, self.bias2, self.c2 = views

    @classmethod
    def fresh(cls, unigram: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        model = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES), np.float32))
        model.r[:], model.t[:] = rng.normal(0, 0.1, model.r.shape), rng.normal(0, 0.1, model.t.shape)
        model.bias[:], model.c[:] = np.log(unigram), 0.7
        model.r2[:], model.t2[:], model.bias2[:], model.c2[:] = 0.01, 0.01, 0.01, 0.1
        return model

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One step of noise-contrastive estimation over a mini-batch; log_noise: of NOISE times the unigram probability of each class."""
        r_one, r_two = self.r[one], self.r[two]
        q = self.c[0] * r_one + self.c[1] * r_two
        t_target, t_noise = self.t[target], self.t[noise]
        s_target = np.einsum("ij,ij->i", q, t_target) + self.bias[target] - log_noise[target]
        s_noise = q @ t_noise.T + (self.bias[noise] - log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(s_target, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-s_noise, -30, 30)))
        back = up[:, None] * t_target + down @ t_noise
        rows = np.concatenate((target, noise))
        i, g = _by_row(rows, np.concatenate((up[:, None] * q, down.T @ q)))
        self.t2[i] += np.square(g).mean(axis=1)
        self.t[i] += RATE * g / np.sqrt(self.t2[i])[:, None]
        g = np.bincount(rows, weights=np.concatenate((up, down.sum(axis=0))), minlength=CLASSES).astype(np.float32)
        self.bias2 += g * g
        self.bias += 0.3 * RATE * g / np.sqrt(self.bias2)
        i, g = _by_row(np.concatenate((one, two)), np.concatenate((back * self.c[0], back * self.c[1])))
        self.r2[i] += np.square(g).mean(axis=1)
        self.r[i] += RATE * g / np.sqrt(self.r2[i])[:, None]
        g = np.stack(((back * r_one).sum(axis=0), (back * r_two).sum(axis=0)))
        self.c2 += g * g
        self.c += 0.3 * RATE * g / np.sqrt(self.c2)


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows, sums of their values)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Normalisers:
    """log of the sum over classes, for each pair of classes before, made when first met."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.full((CLASSES + 1) ** 2, np.nan, np.float32)

    def log_probability(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each target class."""
        m, pair, out = self.model, one * (CLASSES + 1) + two, np.empty(len(target))
        new = np.unique(pair[np.isnan(self.table[pair])])
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            s = (m.c[0] * m.r[part // (CLASSES + 1)] + m.c[1] * m.r[part % (CLASSES + 1)]) @ m.t.T + m.bias
            top = s.max(axis=1, keepdims=True)
            self.table[part] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        for lo in range(0, len(target), SLICE):
            at = slice(lo, lo + SLICE)
            q = m.c[0] * m.r[one[at]] + m.c[1] * m.r[two[at]]
            out[at] = np.einsum("ij,ij->i", q, m.t[target[at]]) + m.bias[target[at]] - self.table[pair[at]]
        return out


# Tasks


def _count(batches):
    """Words with their ending class and count, added up in each task."""
    known: Counter = Counter()

    def sent():
        texts = list(known)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        cls = endings(np.frombuffer(b"".join(texts), np.uint8), ends - size, ends) if texts else np.zeros(0, np.int64)
        for lo in range(0, len(texts), 50_000):
            part = texts[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(cls[lo : lo + 50_000], pa.int32()), pa.array([known[t] for t in part], pa.int64())], names=["word", "ending", "n"])
        known.clear()

    for b in batches:
        for _, _, buf, _ in passes(b.column("text")):
            buf = lower_ascii(buf)
            starts, ends = words(buf)
            first, inverse = distinct(buf, starts, ends)
            raw, n = buf.tobytes(), np.bincount(inverse, minlength=len(first)).tolist()
            for i, j, k in zip(starts[first].tolist(), ends[first].tolist(), n, strict=True):
                known[raw[i:j]] += k
        if len(known) > CACHE_WORDS:
            yield from sent()
    yield from sent()


def _train(shared, sweeps: int):
    def run(batches):
        flat, own, unigram = shared.value
        model, table, rng = Model(flat.copy()), WordTable(own), np.random.default_rng(TaskContext.get().partitionId())
        cumulated, log_noise = np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)
        trained = 0
        for b in batches:
            for _, _, buf, offsets in passes(b.column("text")):
                buf = lower_ascii(buf)
                starts, ends = words(buf)
                found = table.find(buf, starts, ends, span_hash(buf, starts, ends))
                seq, first = with_ends(np.where(found >= 0, 1 + found, endings(buf, starts, ends)), starts, offsets, END)
                one, two = contexts(seq, first)
                for _ in range(sweeps):
                    order = rng.permutation(len(seq))
                    for lo in range(0, len(order), BATCH):
                        at = order[lo : lo + BATCH]
                        noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), CLASSES - 1)
                        model.step(seq[at], one[at], two[at], noise, log_noise)
                        trained += len(at)
        if trained:
            parts = np.array_split(model.flat.astype(np.float64) * trained, SLICES_SENT)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES_SENT), pa.int32()), pa.array([salt] * SLICES_SENT, pa.int32()), pa.array([trained] * SLICES_SENT, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "salt", "trained", "flat"])

    return run


_PART = "slice int, salt int, trained long, flat binary"


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(f, np.float64) for f in sorted(pdf["flat"]))
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "salt": 0, "trained": pdf["trained"].sum(), "flat": [total.tobytes()]})


def average(parts: DataFrame) -> np.ndarray | None:
    """The tasks' models averaged by their steps; only the average comes to the driver."""
    summed = parts.groupBy("slice", "salt").applyInPandas(_add_up, _PART).groupBy("slice").applyInPandas(_add_up, _PART)
    got = summed.orderBy("slice").collect()
    if not got:
        return None
    return np.concatenate([np.frombuffer(r["flat"], np.float64) / r["trained"] for r in got]).astype(np.float32)


_TOLD = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, rare_n array<int>"
_kept: dict[str, tuple] = {}  # tables and normalisers of the last broadcast, for each worker process


def _score(shared):
    def run(batches):
        name, flat, own, common, common_n, *_ = shared.value
        if name not in _kept:
            _kept.clear()
            _kept[name] = WordTable(common), np.append(np.log10(common_n + ADDED), 0.0), np.append(common_n > 0, False), WordTable(own), Normalisers(Model(flat))
        table, logs, seen, own, model = _kept[name]
        *_, end_log, log_n, class_log = shared.value
        made = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, n, buf, offsets in passes(b.column("text")):
                buf = lower_ascii(buf)
                starts, ends = words(buf)
                first, inverse = distinct(buf, starts, ends)
                i, j = starts[first], ends[first]
                h = span_hash(buf, i, j)
                number, mine = table.find(buf, i, j, h), own.find(buf, i, j, h)
                cls = np.where(mine >= 0, 1 + mine, endings(buf, i, j))
                row, many = owners(starts, offsets), np.bincount(owners(starts, offsets), minlength=n)
                token_log = logs[number][inverse]
                token_cls = cls[inverse]
                # Inside an own class a word is sure; in the others it has its share.
                inner = np.where(token_cls > OWN_WORDS, token_log - class_log[token_cls], 0.0)
                seq, at = with_ends(token_cls, starts, offsets, END)
                neural = model.log_probability(seq, *contexts(seq, at)) / np.log(10)
                base = np.bincount(row, weights=token_log, minlength=n) + end_log - (many + 1) * log_n
                score = np.bincount(row, weights=inner, minlength=n) + np.add.reduceat(neural, at)
                known = np.bincount(row, weights=seen[number][inverse], minlength=n).astype(np.int64) + (end_log > np.log10(ADDED))
                rare = number[inverse] < 0
                key, times = np.unique(row[rare] * len(first) + inverse[rare], return_counts=True)
                raw, which = buf.tobytes(), key % max(len(first), 1)
                texts = [raw[x:y] for x, y in zip(i[which].tolist(), j[which].tolist(), strict=True)]
                stops = pa.array(np.searchsorted(key, np.arange(n + 1) * len(first)) if len(first) else np.zeros(n + 1), pa.int32())
                cols = [pa.array(made + np.arange(n), pa.int64()), b.column("doc_id").slice(lo, n), b.column("held_out").slice(lo, n), pa.array(many + 1, pa.int64()), pa.array(known, pa.int64())]
                cols += [pa.array(x, pa.float64()) for x in (base, score)]
                cols += [pa.ListArray.from_arrays(stops, pa.array(texts, pa.binary())), pa.ListArray.from_arrays(stops, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _TOLD.split(", ")])
                made += n

    return run


# The operator


class Scorer:
    """What training gives: counts of all words as a stored table, the model, and what tasks need of the counts."""

    def __init__(self, counts: DataFrame, flat, own, unigram, tokens: int, words_: int, ends: int, class_tokens, class_words, most_broadcast: int):
        self.counts, self.flat, self.own, self.unigram, self.tokens, self.words = counts, flat, own, unigram, tokens, words_
        frequent = counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(max(most_broadcast, OWN_WORDS)).select("word", "n").toArrow()
        self.common, self.common_n = [bytes(x) for x in frequent["word"].to_pylist()], np.array(frequent["n"].to_pylist(), np.int64)
        self.log_n = float(np.log10(tokens + ADDED * (words_ + 1)))
        self.end_log = float(np.log10(ends + ADDED))
        self.class_log = np.log10(class_tokens + ADDED * (class_words + 1))

    def score(self, docs: DataFrame) -> DataFrame:
        """docs: doc_id, text, held_out.  Adds n_tokens, n_known, train_tokens, base_score, score."""
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, self.flat, self.own, self.common, self.common_n, self.end_log, self.log_n, self.class_log))
        told = cut(docs.select("doc_id", "text", "held_out").mapInArrow(_score(shared), _TOLD))
        rare = told.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
        met = rare.join(self.counts.select("word", "n"), "word", "left")
        more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
        out = told.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
        added = F.coalesce("more", F.lit(0.0))
        return out.select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(self.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + added).alias("base_score"), (F.col("score") + added).alias("score"),
        )


def fit(training: DataFrame, most_broadcast: int = MOST_BROADCAST) -> Scorer:
    """Count and train on all rows of training, a table with a column text."""
    spark = training.sparkSession
    tune(spark)
    text = training.select(F.col("text").cast("string").alias("text"))
    counts = cut(text.mapInArrow(_count, "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n")))
    ends = training.count()
    own = [bytes(r["word"]) for r in counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(OWN_WORDS).collect()]
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    class_tokens[END] = ends
    total = 0
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # one row for each class
        class_tokens[r["ending"]], class_words[r["ending"]] = r["n"], r["words"]
        total += r["n"]
    size = np.fromiter(map(len, own), np.int64, len(own))
    stops = np.cumsum(size)
    found = counts.filter(F.col("word").isin([F.lit(w) for w in own])).select("word", "n").collect() if own else []
    n_own = {bytes(r["word"]): r["n"] for r in found}
    for k, (word, cls) in enumerate(zip(own, endings(np.frombuffer(b"".join(own), np.uint8), stops - size, stops).tolist() if own else [], strict=True)):
        class_tokens[1 + k] = n_own[word]
        class_tokens[cls] -= n_own[word]
        class_words[cls] -= 1
    words_ = counts.count() + (ends > 0)
    unigram = (class_tokens + 1) / (class_tokens + 1).sum()
    flat, tokens = Model.fresh(unigram).flat, total + ends
    sweeps = min(MOST_SWEEPS, max(1, -(-LEAST_TARGETS // max(tokens, 1))))
    eighth, lo = F.pmod(F.xxhash64("text", F.lit("round")), F.lit(8)), 0
    for many in ROUNDS:
        shared = spark.sparkContext.broadcast((flat, own, unigram))
        part = text.filter((eighth >= lo) & (eighth < lo + many))
        got = average(part.mapInArrow(_train(shared, sweeps), _PART))
        flat, lo = flat if got is None else got, lo + many
    return Scorer(counts, flat, own, unigram, tokens, int(words_), ends, class_tokens, class_words, most_broadcast)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; held-out documents are not learnt from."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", fold("doc_id", 10) == 0)
    return fit(d.filter("NOT held_out").select("text"), most_broadcast).score(d)


def op11_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
