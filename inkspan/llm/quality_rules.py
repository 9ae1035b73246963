"""Quality rules with host verdicts.

Every document is measured by counts over its whole text.  Rule failures are
then summed by host, each host's failure rate is shrunk towards the others by a
beta prior fitted to all hosts (method of moments), and a host whose shrunk rate
passes `HOST_LIMIT` for some rule fails with all its documents.  A host with few
documents so needs more evidence than a host with many.

Defined results: null text has no words; a null host is a host of its own;
repeated rows count each; an empty table gives an empty result; other columns of
the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import cut, mix, owners, passes, read, span_hash, tune, words

LEAST_WORDS = 50
HOST_LIMIT = 0.5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: A document fails a host rule when the condition holds.
HOST_RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "dup_lines": "n_dup_lines >= 10",
}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    equal = np.zeros(len(s) + 1, dtype=bool)
    equal[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), dtype=bool)
    out[order] = equal[:-1] | equal[1:]
    return out


def measure(buf: np.ndarray, offsets: np.ndarray, rows: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a pass."""
    starts, ends = words(buf)
    row = owners(starts, offsets)
    n_words = np.bincount(row, minlength=rows)
    heads = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    word_chars = np.bincount(row, weights=heads[ends] - heads[starts], minlength=rows).astype(np.int64)
    n_symbols = np.bincount(owners(np.flatnonzero(_SYMBOL[buf]), offsets), minlength=rows)

    line_ends = np.flatnonzero(buf == 0x0A)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1)) if len(line_ends) else line_ends
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_row = owners(line_starts, offsets)
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
    _, first = np.unique(span_hash(buf, line_starts, line_ends) ^ salt[line_row], return_index=True)
    n_dup = np.bincount(line_row, minlength=rows) - np.bincount(line_row[first], minlength=rows)

    h = span_hash(buf, starts, ends)
    hit = np.zeros(len(h), dtype=bool)
    if len(h) > 2:
        three = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) ^ salt[row[:-2]]
        whole = np.flatnonzero(row[:-2] == row[2:])
        again = whole[_repeated(three[whole])]
        for k in range(3):
            hit[again + k] = True
    n_repeat = np.bincount(row[hit], minlength=rows)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


def _measure_batches(batches):
    for b in batches:
        parts = [measure(buf, off, n) for _, n, buf, off in passes(b.column("text"))]
        counts = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *counts], names=["doc_id", "host", *_COUNTS])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    tune(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_measure_batches, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))


def host_rates(stats: DataFrame, rules: dict[str, str] = HOST_RULES) -> DataFrame:
    """One row per host: host, n, and for each rule its shrunk failure rate."""
    fails = [F.sum(F.expr(c).cast("long")).alias(f"f_{r}") for r, c in rules.items()]
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)
    # What holds for all hosts is one row, by sums that are combined before they meet.
    means = hosts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), *[(F.sum(f"f_{r}") / F.sum("n")).alias(f"m_{r}") for r in rules])
    hosts = hosts.crossJoin(F.broadcast(means))
    spreads = hosts.agg(*[(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.col(f"m_{r}"), 2)) / F.max("total")).alias(f"v_{r}") for r in rules])
    hosts = hosts.crossJoin(F.broadcast(spreads))
    for r in rules:
        mean = F.col(f"m_{r}")
        between = F.greatest(F.col(f"v_{r}") - mean * (1 - mean) * F.col("k") / F.col("total"), F.lit(1e-6))
        weight = F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(1000.0))
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight))
    return hosts.select("host", "n", *[f"rate_{r}" for r in rules])


def judged(docs: DataFrame, host_limit: float = HOST_LIMIT, **columns) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, host_failed."""
    stats = cut(measured(docs, **columns))
    rates = host_rates(stats)
    worst = F.greatest(*[F.col(f"rate_{r}") for r in HOST_RULES], F.lit(0.0))
    verdicts = rates.select(F.col("host").alias("of"), (worst > host_limit).alias("host_failed"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    j = stats.join(verdicts, F.col("host").eqNullSafe(F.col("of")))
    return j.select("doc_id", *_COUNTS, base.alias("base_failed"), (~base & ~F.col("host_failed")).alias("kept"), "host_failed")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))


_RATES = ", ".join(f"sum(({c})::INT) AS f_{r}" for r, c in HOST_RULES.items())
_SHRUNK = ", ".join(
    f"(f_{r} + m_{r} * least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * k / total, 1e-6) - 1, 1.0), 1000.0))"
    f" / (n + least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * k / total, 1e-6) - 1, 1.0), 1000.0)) AS rate_{r}"
    for r in HOST_RULES
)
_MEANS = ", ".join(f"sum(f_{r}) OVER () / sum(n) OVER () AS m_{r}" for r in HOST_RULES)
_SPREADS = ", ".join(f"sum(n * (f_{r} / n - m_{r}) ** 2) OVER () / total AS v_{r}" for r in HOST_RULES)

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS c FROM g WHERE w3 IS NOT NULL) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM h) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
s AS (SELECT doc_id, host, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN n USING (r)),
h0 AS (SELECT host, count(*) AS n, {_RATES} FROM s GROUP BY host),
h1 AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k, {_MEANS} FROM h0),
h2 AS (SELECT *, {_SPREADS} FROM h1),
h3 AS (SELECT host, {_SHRUNK} FROM h2),
h4 AS (SELECT host, greatest({", ".join(f"rate_{r}" for r in HOST_RULES)}) > {HOST_LIMIT} AS host_failed FROM h3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept, host_failed
FROM s JOIN h4 ON s.host IS NOT DISTINCT FROM h4.host
"""
