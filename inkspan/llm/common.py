"""Helpers shared by the operators of this package.

Text enters the Python side as Arrow batches.  A batch is looked at as one
byte buffer, so splitting, hashing and counting run as numpy passes over bytes
instead of loops over words.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
PASS_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER = np.frombuffer(UPPER_TO_LOWER, dtype=np.uint8)

#: Spans longer than this are hashed one by one.
LONG_SPAN = 512
_ROUND = np.uint64(0x9E3779B97F4A7C15)
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(buf: np.ndarray) -> np.ndarray:
    """For each place of a buffer, and the one after it, the eight bytes from there; zeros follow the end."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span.

    Spans are read in steps of eight bytes, all together, and each step is
    multiplied and shifted into the state, so no algebra over the bytes holds
    (a polynomial modulo 2**64 takes some different texts for equal).  Long
    spans go through blake2b.
    """
    at, n = starts.astype(np.int64), (ends - starts).astype(np.int64)
    h = mix(n.astype(np.uint64) + _ROUND)
    chunk = eights(buf)
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at_, n_, state = at[live], n[live], h[live]
    while len(live):
        state = (state ^ (chunk[at_] & _TAILS[np.minimum(n_, 8)])) * _ROUND
        state ^= state >> np.uint64(32)
        h[live] = state
        on = np.flatnonzero(n_ > 8)
        live, at_, n_, state = live[on], at_[on] + 8, n_[on] - 8, state[on]
    h = mix(h)
    for k in np.flatnonzero(n > LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[at[k] : at[k] + n[k]], digest_size=8).digest(), "little")
    return h


def same_spans(buf: np.ndarray, one: np.ndarray, other: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from each place of one are those from the same place of other."""
    chunk = eights(buf)
    out = np.ones(len(n), dtype=bool)
    live = np.flatnonzero((one != other) & (n > 0))
    a, b, left = one[live], other[live], n[live]
    while len(live):
        bad = (chunk[a] ^ chunk[b]) & _TAILS[np.minimum(left, 8)] != 0
        out[live[bad]] = False
        on = np.flatnonzero(~bad & (left > 8))
        live, a, b, left = live[on], a[on] + 8, b[on] + 8, left[on] - 8
    return out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches where flag holds."""
    padded = np.zeros(len(flag) + 2, dtype=bool)
    padded[1:-1] = flag
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def passes(texts: pa.Array):
    """Cut a text column into (first row, rows, bytes, offsets) of about PASS_BYTES.

    Each text is followed by a newline, so no word or line runs into the next
    document.  Null counts as empty.  offsets has one entry more than rows.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + PASS_BYTES, side="right")))
        part = pc.fill_null(texts.slice(lo, hi - lo).cast(pa.large_binary()), b"")
        ended = pc.binary_join_element_wise(part, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        _, off, data = ended.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[ended.offset : ended.offset + hi - lo + 1]
        buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        yield lo, hi - lo, buf, offsets - offsets[0]
        lo = hi


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words `[^\\x20\\x09-\\x0D]+`."""
    return runs(~WHITE[buf])


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each span."""
    return np.searchsorted(offsets, starts, side="right") - 1


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, since one row may be a very long text; workers find this package where the driver did."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in (paths := environment.get("PYTHONPATH", "")).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, root)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on one machine, as in tests, a fresh one if none is named."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that it is computed once.

    Lost executors then cost a read of that folder, not a new computation.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame):
    """df as a Parquet table in the shared folder, for as long as the block lasts."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # hashes do not repeat
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of two or three numbers that may be broadcast: some 20 MB in memory.
MOST_BROADCAST = 250_000


def is_small(df: DataFrame) -> bool:
    """Whether a stored table of numbers is proven small enough to be broadcast."""
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: str, mod: int) -> Column:
    """crc32 of the identifier as text, modulo mod; a null identifier is the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
