"""Exact deduplication by a content sort.

Rows are range-partitioned by content with sampled splitters, sorted inside
each partition (Spark's external sort), and compared with their neighbour in
full.  The sort key starts with the leading bytes, then a fingerprint of the
whole text, then the text itself, then the identifier.  Splitters hold only the
first two and the identifier, so what sampling sends to the driver is bounded
however long the texts are, and a large group of copies is spread over several
partitions by its identifiers.  Groups that cross a partition border are
stitched by comparing, in full, the last text of one partition with the first
of the next.

Defined results: null text is the empty text; null identifiers sort first, so
they stay only if the whole group has none; of repeated rows with the same text
and identifier exactly one stays; an empty table gives an empty result; columns
of the input beyond identifier and text are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm.common import ascii_lower, cut, read, shuffle_partitions, tune

LEAD = 48

_ROWS = "id long, part int, run long, sha string, last_of_id boolean, first_text string, last_text string, final boolean"
_OUT = pa.schema(
    [("id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("sha", pa.string()), ("last_of_id", pa.bool_()), ("first_text", pa.string()), ("last_text", pa.string()), ("final", pa.bool_())]
)


def _mark_runs(batches):
    """Number the runs of equal neighbours in one sorted partition.

    One row is held back, since whether it ends its identifier, and whether it
    is the last of the partition, shows only with the next one.
    """
    held = None  # (id, part, run, sha, text, first_text)

    def emit(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _OUT]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _OUT, strict=True)], schema=_OUT)

    for b in batches:
        if not b.num_rows:
            continue
        text, ids, part = b.column("norm"), b.column("id").to_pylist(), b.column("part")[0].as_py()
        same = [False] + pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_pylist()
        rows = []
        for k, i in enumerate(ids):
            if held is not None:
                equal = same[k] if k else held[4] == text[0].as_py()
                rows.append((held[0], held[1], held[2], held[3], not (equal and held[0] == i), held[5], None, False))
            else:
                equal = False
            if equal:
                run, sha = held[2], held[3]
            else:
                run = held[2] + 1 if held is not None else 0
                sha = hashlib.sha256(text[k].as_buffer()).hexdigest()
            at_end = k == len(ids) - 1
            held = (i, part, run, sha, text[k].as_py() if at_end else None, text[k].as_py() if held is None else None)
        yield emit(rows)
    if held is not None:
        yield emit([(held[0], held[1], held[2], held[3], True, held[5], held[4], True)])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    tune(spark)
    norm = docs.select(F.col(id_col).cast("long").alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    keys = norm.select("id", "norm", F.substring("norm", 1, LEAD).alias("lead"), F.xxhash64("norm").alias("mark"))
    dealt = keys.repartitionByRange(shuffle_partitions(spark), F.asc("lead"), F.asc("mark"), F.asc_nulls_first("id"))
    ordered = dealt.sortWithinPartitions(F.asc("lead"), F.asc("mark"), F.asc("norm"), F.asc_nulls_first("id"))
    rows = cut(ordered.select("id", "norm", F.spark_partition_id().alias("part")).mapInArrow(_mark_runs, _ROWS))

    # One row per partition that has rows: its first and last text and its last run.
    borders = rows.filter(F.col("first_text").isNotNull() | F.col("final")).groupBy("part").agg(
        F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max(F.when(F.col("final"), F.col("run"))).alias("last_run")
    )
    line = Window.orderBy("part")
    ranked = borders.select("part", "last_run").withColumn("before", F.lag("part").over(line))
    joined = ranked.join(borders.select("part", "first_text"), "part").join(
        borders.select(F.col("part").alias("before"), F.col("last_text").alias("text_before")), "before", "left"
    )
    linked = joined.select("part", "last_run", F.coalesce(F.col("first_text") == F.col("text_before"), F.lit(False)).alias("goes_on"))
    own = F.when((F.col("last_run") > 0) | ~F.col("goes_on"), F.struct("part", F.col("last_run").alias("run")))
    anchored = linked.withColumn("anchor_last", F.last(own, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    anchors = anchored.withColumn("anchor", F.lag("anchor_last").over(line)).filter("goes_on").select("part", F.lit(0).cast("long").alias("run"), "anchor")

    per_run = rows.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    per_run = per_run.join(F.broadcast(anchors), ["part", "run"], "left").withColumn("anchor", F.coalesce("anchor", F.struct("part", "run")))
    per_group = per_run.groupBy("anchor").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"))
    runs = per_run.select("part", "run", "anchor").join(per_group, "anchor").drop("anchor")
    out = rows.select("id", "part", "run", "sha", "last_of_id").join(runs, ["part", "run"])
    return out.select(
        "id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("last_of_id") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
