"""Fuzzy line deduplication by MinHash over character shingles.

A line's normal form is its text lower-cased (A-Z) without white space at the
ends; lines without a word are left alone.  Lines of one normal form are equal.
Different lines are near duplicates when the Jaccard similarity of their sets of
8-byte shingles is at least 0.8.  Signatures of 24 minima in 8 bands of 3 propose
pairs (a pair at the threshold is proposed with probability 0.997, one at 0.9
with 0.99996), every proposed pair is verified on the texts, and the
components of verified links keep one line: the first by (doc_id, line number).

Equal lines are collapsed before anything is compared, and pairs are compared in
two rounds.  In the first every line meets the first line of each run of lines
that share a band key.  Most runs are then one component; what is left open is
compared in full: lines of different components in pairs if the run holds at
most `ALL_PAIRS`, in blocks if it is longer.  Every pair of blocks is one piece
of work and returns a spanning set of its links.

Defined results: null text stays null; a null identifier is a document that
comes first; rows alike in identifier and text are treated alike, and rows of one
identifier with different texts apart; of lines that stand at one place of such
rows the one of the smaller text hash comes first; lines that lose leave the
text, a document that loses every line is dropped by `dedup_lines`; a text of one
very long line is hashed and compared whole, in memory that grows with that line
alone; an empty table gives an empty result; other columns stay, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import cut, eights, is_small, lower_ascii, mix, owners, passes, read, shuffle_partitions, span_hash, stored, tune, words
from inkspan.llm.linking import connected, id_filter, may_hold

SHINGLE = 8
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
ALL_PAIRS = 16
#: Lines of an open run that are compared in one task with as many others.
BLOCK = 1024
#: Shingles held by more lines of a block are columns of 0/1 matrices of so many columns.
LIGHT = 16
WIDTH = 8192
#: Bytes of lines whose shingles are sorted together.
TOGETHER = 1 << 20
_rng = np.random.default_rng(1204)
_MULTIPLY = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, starts, ends, row, number in its text) of the lines that have a word."""
    low = lower_ascii(buf)
    ws, we = words(low)
    ends = np.flatnonzero(low == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    full = hi > lo
    row = owners(starts, offsets)
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[row]
    return low, ws[lo[full]], we[hi[full] - 1], row[full], number[full]


def shingle_codes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the sorted distinct shingles of each line, one line after the other.

    A shingle is its eight bytes as a number; a line too short for one has one
    code of its own, its bytes with its length in the free byte.
    """
    size = np.array([len(x) for x in lines], np.int64)
    n = np.maximum(size - SHINGLE + 1, 1)
    ends = np.cumsum(n)
    grams = eights(np.frombuffer(b"".join(lines), np.uint8))
    first = np.cumsum(size) - size
    codes = grams[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    short = np.flatnonzero(size < SHINGLE)
    codes[ends[short] - 1] = (codes[ends[short] - 1] & ((np.uint64(1) << (8 * size[short]).astype(np.uint64)) - np.uint64(1))) | (size[short].astype(np.uint64) << np.uint64(56))
    for hi, many in zip(ends.tolist(), n.tolist(), strict=True):
        codes[hi - many : hi].sort()
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = codes[1:] != codes[:-1]
    fresh[(ends - n)[n > 0]] = True
    return codes[fresh], np.cumsum(fresh)[ends - 1] if len(ends) else ends


def similar_pairs(x: list[bytes], y: list[bytes], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each line of x is a near duplicate of that of y, by exact intersections."""
    (a, a_ends), (b, b_ends) = shingle_codes(x), shingle_codes(y)
    n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    ends = np.cumsum(n_a + n_b)
    both = np.empty(len(a) + len(b), np.uint64)
    for k, hi in enumerate(ends.tolist()):
        lo = hi - n_a[k] - n_b[k]
        both[lo : lo + n_a[k]] = a[a_ends[k] - n_a[k] : a_ends[k]]
        both[lo + n_a[k] : hi] = b[b_ends[k] - n_b[k] : b_ends[k]]
        both[lo:hi].sort()
    twice = np.zeros(len(both) + 1, np.int64)
    equal = both[1:] == both[:-1]
    equal[ends[:-1] - 1] = False
    np.cumsum(equal, out=twice[2:])
    shared = np.diff(twice[ends], prepend=0)
    return shared >= threshold * (n_a + n_b - shared) - 1e-9


def similar(a: bytes, b: bytes, threshold: float = THRESHOLD) -> bool:
    return bool(similar_pairs([a], [b], threshold)[0])


def band_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """BANDS keys of each line; a line without a whole shingle has keys of its own."""
    keys = np.empty((len(starts), BANDS), dtype=np.uint64)
    short = ends - starts < SHINGLE
    keys[short] = mix(h[short, None] + np.arange(BANDS, dtype=np.uint64))
    full = np.flatnonzero(~short)
    if len(full):
        x = eights(low) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(32)
        x = x.astype(np.uint32)
        # Every other stretch is a line's shingles; the ones between are not looked at.
        bounds = np.stack((starts[full], ends[full] - SHINGLE + 1), axis=1).ravel()
        for band in range(BANDS):
            key = np.full(len(full), band + 1, dtype=np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mix(key + np.minimum.reduceat(x * _MULTIPLY[k], bounds)[::2])
            keys[full, band] = key
    return keys.view(np.int64)


_KEYS = [f"key{k}" for k in range(BANDS)]
_LINES = "doc long, doc_id long, number int, h long, " + ", ".join(f"{k} long" for k in _KEYS)


def _line_rows(batches):
    """Every line with a word; the first of equal lines in a batch has the band keys too."""
    for b in batches:
        docs, rows, numbers, hashes, at, keys = [b.column(c) for c in ("doc", "doc_id")], [], [], [], [], []
        seen = 0
        for lo, _, buf, off in passes(b.column("text")):
            low, s, e, row, number = line_spans(buf, off)
            h = span_hash(low, s, e)
            _, first = np.unique(h, return_index=True)
            first.sort()
            keys.append(band_keys(low, s[first], e[first], h[first]))
            at.append(seen + first)
            seen += len(h)
            rows.append(row + lo), numbers.append(number), hashes.append(h.view(np.int64))
        if not rows:
            continue
        take, h = pa.array(np.concatenate(rows)), np.concatenate(hashes)
        at, keys = np.concatenate(at), np.concatenate(keys)
        _, once = np.unique(h[at], return_index=True)
        once.sort()
        bare = np.ones(seen, dtype=bool)
        bare[at[once]] = False
        full = np.zeros((BANDS, seen), np.int64)
        full[:, at[once]] = keys[once].T
        columns = [pa.array(k, mask=bare) for k in full]
        yield pa.RecordBatch.from_arrays([*[c.take(take) for c in docs], pa.array(np.concatenate(numbers).astype(np.int32)), pa.array(h), *columns], names=["doc", "doc_id", "number", "h", *_KEYS])


def _propose(batches):
    """(a, h, key) from rows sorted by (key, h): a is the first line of h's run; key is told for runs of three lines and more."""
    now, count, leader, second, last = None, 0, 0, 0, 0  # of the run that may go on
    for batch in batches:
        key, h = batch.column("key").to_numpy(), batch.column("h").to_numpy()
        if not len(key):
            continue
        fresh = np.concatenate(([not count or now != key[0] or last != h[0]], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
        key, h = key[fresh], h[fresh]
        if not len(key):
            continue
        goes_on = bool(count) and now == key[0]
        at = np.arange(len(key))
        start = np.maximum.accumulate(np.where(np.concatenate(([not goes_on], key[1:] != key[:-1])), at, -1))
        place = np.where(start < 0, at + count, at - start)
        first = np.where(start < 0, leader, h[start])
        follow, third = np.flatnonzero(place > 0), np.flatnonzero(place == 2)
        # The third line of a run also names the first two.
        two = np.where(third > 0, h[third - 1], second)
        keys = pa.concat_arrays([pa.array(key[follow], mask=place[follow] == 1), pa.array(key[third]), pa.array(key[third])])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((first[follow], first[third], first[third]))), pa.array(np.concatenate((h[follow], first[third], two))), keys], names=["a", "h", "key"])
        now, last, leader, count = key[-1], h[-1], first[-1], int(place[-1]) + 1
        second = h[-1] if count == 2 else h[-2] if count == 3 and len(h) > 1 else second


def _texts(shared, owners_of):
    """Wanted lines (h, line), from the documents that may hold one first."""

    def run(batches):
        for b in batches:
            found = {}
            for _, _, buf, off in passes(b.column("text").filter(pa.array(may_hold(owners_of.value, b.column("doc").to_numpy())))):
                low, s, e, _, _ = line_spans(buf, off)
                h, first = np.unique(span_hash(low, s, e).view(np.int64), return_index=True)
                hit = may_hold(shared.value, h)
                raw = low.tobytes()
                for k, i, j in zip(h[hit].tolist(), s[first[hit]].tolist(), e[first[hit]].tolist(), strict=True):
                    found[k] = raw[i:j]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["h", "line"])

    return run


def _verify(rest: list[str]):
    def run(batches):
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            size = np.cumsum([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            ok, lo = [np.empty(0, bool)], 0
            while lo < len(x):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TOGETHER, side="right")))
                ok.append(similar_pairs(x[lo:hi], y[lo:hi]))
                lo = hi
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(np.concatenate(ok))], names=[*rest, "ok"])

    return run


def _spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Links (first member, member) of the components of a symmetric boolean matrix."""
    free, out = np.ones(len(close), dtype=bool), []
    for k in range(len(close)):
        if free[k]:
            free[k], front = False, np.array([k])
            while len(front):
                front = np.flatnonzero(close[front].any(axis=0) & free)
                free[front] = False
                out += [(k, int(x)) for x in front]
    return out


def similar_in_block(lines: list[bytes], threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines of a block are similar, by exact intersections of all pairs."""
    token, ends = shingle_codes(lines)
    size, n = len(lines), np.diff(ends, prepend=0)
    row = np.repeat(np.arange(size), n)
    n = n.astype(np.float32)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    held = np.diff(np.concatenate((heads, [len(token)])))
    # Shingles of few lines add one to each pair of them; those of many are columns of a matrix.
    each = np.repeat(held, held)
    light = (each > 1) & (each <= LIGHT)
    row_l, token_l = row[light], token[light]
    codes = []
    for d in range(1, LIGHT):
        i = np.flatnonzero(token_l[d:] == token_l[:-d]) if len(token_l) > d else token_l[:0].astype(np.int64)
        codes.append(row_l[i] * size + row_l[i + d])
    both = np.bincount(np.concatenate(codes).astype(np.int64), minlength=size * size).reshape(size, size).astype(np.float32)
    both += both.T
    heavy = each > LIGHT
    row_h, column = row[heavy], np.repeat(np.arange((held > LIGHT).sum()), held[held > LIGHT])
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        i, j = np.searchsorted(column, (lo, lo + WIDTH))
        m = np.zeros((size, min(WIDTH, int(column[-1]) + 1 - lo)), dtype=np.float32)
        m[row_h[i:j], column[i:j] - lo] = 1
        both += m @ m.T
    np.fill_diagonal(both, n)
    return both >= threshold * (n[:, None] + n[None] - both) - 1e-4


def _block_links(batches):
    """Links of components inside each (key, lo, hi) of rows sorted by it: by lines of the two blocks, or of the one."""

    def links(block, label, line):
        label = np.array(label)
        if label.min() == label.max():
            return []
        close = similar_in_block(list(line)) & (label[:, None] != label[None])
        if block[0] != block[-1]:
            b = np.array(block)
            close &= b[:, None] != b[None]
        return [(int(label[x]), int(label[y])) for x, y in _spanning(close)]

    now, rows, out = None, [], []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("key", "lo", "hi", "block", "label", "line")]
        for key, lo, hi, block, label, line in zip(*cols, strict=True):
            if (key, lo, hi) != now:
                if rows:
                    out += links(*zip(*rows, strict=True))
                now, rows = (key, lo, hi), []
            rows.append((block, label, line))
        yield _pairs(out)
        out = []
    if rows:
        yield _pairs(links(*zip(*rows, strict=True)))


def _pairs(links: list) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of line hashes that are near duplicates, with what else the pairs carry."""
    both = pairs.join(lines.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    rest = [c for c in pairs.columns if c not in ("a", "b")] or ["a", "b"]
    return both.select(*rest, "x", "y").mapInArrow(_verify(rest), ", ".join(f"{c} long" for c in rest) + ", ok boolean").filter("ok").drop("ok")


def open_links(runs: DataFrame, label: DataFrame, lines: DataFrame) -> DataFrame:
    """Links (a, b) between components of the first round, by lines of one run (key, h) that are of different ones."""
    parts = shuffle_partitions(runs.sparkSession)
    named = cut(runs.join(F.broadcast(label) if is_small(label) else label, runs["h"] == label["id"], "left").select("key", "h", F.coalesce("component", "h").alias("label")))
    # Runs of the same lines under several keys are compared once.
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y")).filter("lo <> hi")
    sizes = cut(sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.when(F.col("n") > ALL_PAIRS, F.ceil(F.col("n") / BLOCK)).otherwise(0).cast("int").alias("blocks")))
    left = named.join(F.broadcast(sizes) if is_small(sizes) else sizes, "key")
    few = left.filter("blocks = 0").groupBy("key").agg(F.collect_list(F.struct("h", "label")).alias("all"))  # at most ALL_PAIRS of them
    few = few.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).filter("p.h < q.h AND p.label <> q.label")
    few = few.select(F.col("p.h").alias("a"), F.col("q.h").alias("b"), F.col("p.label").alias("la"), F.col("q.label").alias("lb")).distinct()
    judged = _verified(few, lines).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    placed = left.filter("blocks > 0").withColumn("block", F.pmod(F.hash("h"), F.col("blocks"))).join(lines, "h")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "label", "line")
    inside = met.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block").mapInArrow(_block_links, "a long, b long")
    return judged.unionByName(inside)


def line_groups(d: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which lines of d (doc, doc_id, text) belong together, as two tables (id, component).

    The first holds lines by their hash; the second says which components of the
    first, or lines that are not in it, are one.
    """
    parts = shuffle_partitions(d.sparkSession)
    # One shuffle brings the lines of a key together and sorts them; what it proposes is far smaller and is written.
    dealt = lines.filter("key0 IS NOT NULL").select(F.explode(F.array(*_KEYS)).alias("key"), "h").repartition(parts, "key").sortWithinPartitions("key", "h")
    proposed = cut(dealt.mapInArrow(_propose, "a long, h long, key long"))
    wanted = cut(proposed.select(F.explode(F.array("a", "h")).alias("h")).distinct())
    holders = lines.select("h", "doc").join(F.broadcast(wanted) if is_small(wanted) else wanted, "h", "left_semi").groupBy("h").agg(F.min("doc").alias("doc"))
    texts = d.select("doc", "text").mapInArrow(_texts(id_filter(wanted, "h"), id_filter(holders, "doc")), "h long, line binary")
    found = cut(texts.groupBy("h").agg(F.first("line").alias("line")))
    links = _verified(proposed.filter("a <> h").select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct(), found)
    label = cut(connected(links))
    return label, cut(connected(open_links(proposed.filter("key IS NOT NULL").select("key", "h"), label, found)))


def dropped_lines(d: DataFrame) -> DataFrame:
    """(doc, lost): for each document that loses lines, their numbers and hashes."""
    with stored(d.mapInArrow(_line_rows, _LINES)) as lines:
        label, more = line_groups(d, lines)
        # Only lines that stand twice or have near duplicates are looked at further.
        again = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        near = label.select(F.col("id").alias("h")).unionByName(more.select(F.col("id").alias("h")))
        some = again.unionByName(near).distinct()
        some = some.join(F.broadcast(label) if is_small(label) else label, some["h"] == label["id"], "left").select("h", F.coalesce("component", "h").alias("own"))
        some = some.join(F.broadcast(more) if is_small(more) else more, some["own"] == more["id"], "left")
        # Written, so that a line or a group that holds very many rows meets them in a join that can be split.
        some = cut(some.select("h", F.coalesce("component", "own").alias("group")))
        place = F.struct("doc_id", "number", "doc")
        met = cut(lines.select("doc", "doc_id", "number", "h").join(F.broadcast(some) if is_small(some) else some, "h"))
        winners = cut(met.groupBy("group").agg(F.min(place).alias("winner")))
        losing = met.join(F.broadcast(winners) if is_small(winners) else winners, "group").filter(~place.eqNullSafe(F.col("winner")))
        # A document's lost lines are no more than its text has.
        return cut(losing.groupBy("doc").agg(F.collect_set(F.struct("number", "h")).alias("lost")))


def _rebuild(names: list[str], text: str):
    def run(batches):
        for b in batches:
            texts = b.column(text)
            lost = b.column("lost").to_pylist()
            new, n_lines, n_lost = texts.to_pylist(), [], []
            for lo, n, buf, off in passes(texts):
                low, s, e, row, number = line_spans(buf, off)
                ends = np.searchsorted(row, np.arange(n + 1)).tolist()
                some = any(lost[lo : lo + n])
                h = span_hash(low, s, e).view(np.int64) if some else None
                for k in range(n):
                    n_lines.append(ends[k + 1] - ends[k])
                    if not lost[lo + k]:
                        n_lost.append(0)
                        continue
                    gone = {(x["number"], x["h"]) for x in lost[lo + k]}
                    mine = slice(ends[k], ends[k + 1])
                    out = {i for i, x in zip(number[mine].tolist(), h[mine].tolist(), strict=True) if (i, x) in gone}
                    n_lost.append(len(out))
                    new[lo + k] = "\n".join(x for i, x in enumerate(new[lo + k].split("\n")) if i not in out)
            cols = [pa.array(new, pa.string()) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_lost, pa.int64())], names=[*names, "n_lines", "n_lost"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_lost): the rows of docs with repeated lines taken out of the text, as structs."""
    tune(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    inside = [f"c{k}" for k in range(len(names))]  # whatever the columns are called
    plain = docs.withColumn(text_col, F.col(text_col).cast("string"))
    key = F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.coalesce(F.col(text_col), F.lit("")))
    plain = plain.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inside, strict=True)], key.alias("doc"))
    d = plain.select("doc", F.col(f"c{names.index(id_col)}").cast("long").alias("doc_id"), F.col(f"c{at}").alias("text"))
    joined = plain.join(dropped_lines(d), "doc", "left")
    kinds = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(plain.schema.fields[:-1])]
    out = joined.mapInArrow(_rebuild(inside, f"c{at}"), ", ".join([*kinds, "n_lines long", "n_lost long"]))
    return out.select(F.struct(*[F.col(i).alias(c) for c, i in zip(names, inside, strict=True)]).alias("row"), "n_lines", "n_lost")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one line left of each group; a document that loses every line goes."""
    return without_repeats(docs, id_col, text_col).filter("n_lost = 0 OR n_lost < n_lines").select("row.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_lost", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))
