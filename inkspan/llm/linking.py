"""Connected components over a table of links, and filters of bounded size over identifiers."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, is_small

#: Bits of an identifier filter: 8 MB, whatever the number of identifiers.  Beyond some tens of millions of them it
#: lets most rows through: what follows it compares identifiers, so results stay right and more texts are read.
FILTER_BITS = 26


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b); the component is its smallest id.

    Large-star and small-star steps in turn: every node hands its larger
    neighbours, then its smaller ones, to the smallest.  The graph shrinks to
    stars in a number of rounds that grows with the logarithm of its size.
    Minima are combined before the shuffle and written.  If they are few they
    are broadcast, and no link moves; if not, links and minima meet in a join of
    two plain shuffles, in which adaptive execution splits the links of a node
    that has very many.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        nodes = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        tangled = nodes.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 OR (c = 1 AND r = 1)")
        if tangled.isEmpty():
            break
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = cut(both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")))
        small = is_small(least)
        e = both.join(F.broadcast(least) if small else least, "n").filter("x > n").select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = e if small else cut(e)
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        moved = e.join(F.broadcast(least) if small else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")  # no more nodes than before
        e = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def id_filter(ids: DataFrame, column: str) -> Broadcast:
    """A bitmap that holds every id of a column, and some others; at most 2**20 words of 64 bits come to the driver."""
    bits = ids.select((F.xxhash64(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))).alias("bit"))
    words = bits.select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, int(bit % 64))").alias("mask"))
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[found["word"].to_numpy()] = found["mask"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_long(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long, for arrays."""
    h = np.full(x.shape, np.uint64(42) + _P5 + np.uint64(8), dtype=np.uint64)
    h ^= _rotate(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
    h = _rotate(h, 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def may_hold(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = xxhash64_long(ids) & np.uint64((1 << FILTER_BITS) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
