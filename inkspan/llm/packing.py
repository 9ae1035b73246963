"""Packing of token sequences: dominance reduction, then best fit.

Documents are tokenised once; only documents over the capacity are cut, into
pieces of full length and a shorter last one.  Packing needs nothing but how
many pieces there are of each length, and lengths lie between 1 and the
capacity, so the instance is a histogram of at most `capacity` numbers however
many documents there are.  It is packed by kind: a bin layout and how many bins
have it.

1. Reduction (Martello and Toth): going down from the longest piece, a bin that
   dominates every other bin with that piece is fixed: the piece alone if no
   other fits beside it; the piece and the one that fills the bin exactly; the
   piece and the longest that fits, if no two others fit beside it.
2. What is left is packed by best fit, longest first.

Each piece finds its place from its rank among the pieces of its length.  Ranks
are counted per partition and shifted by the counts of earlier partitions, so
even if all documents have one length no task holds them all.

Defined results: null text is empty and still has its end token; repeated rows
are packed each; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm.common import WHITE, cut, lower_ascii, passes, read, same_spans, span_hash, tune

CAPACITY = 4096
END_ID = 1
CACHE_UNITS = 1_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class UnitIds:
    """Token ids of units of text, with a bounded cache.

    The tokenizer lower-cases, and never joins characters across white space or
    a run of letters with the punctuation after it (apostrophes and the signs of
    special tokens apart).  So a text's ids are those of its units, one after
    the other, and each different unit is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, "<u4")
        self.start = np.zeros(1 << 16, np.int64)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start in self.ids, length) of each unit; units are known by their bytes."""
        if len(self.place) > CACHE_UNITS:
            self._empty()
        known = self.place
        at = np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(at < 0)
        for lo in range(0, len(missing), 5000):
            part = missing[lo : lo + 5000]
            found = [e.ids for e in self.encode([texts[k].decode() for k in part.tolist()], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            n, base = len(known), self.start[len(known)]
            while n + len(part) + 1 > len(self.start):
                self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            while base + lengths.sum() > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            self.ids[base : base + lengths.sum()] = np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum()))
            self.start[n + 1 : n + 1 + len(part)] = base + np.cumsum(lengths)
            at[part] = np.arange(n, n + len(part))
            known.update(zip([texts[k] for k in part.tolist()], range(n, n + len(part)), strict=True))
        return self.start[at], self.start[at + 1] - self.start[at]


_ENDING = np.zeros(256, dtype=bool)
_ENDING[[ord(c) for c in ".,!*$%&;:?"]] = True
_known: dict[str, UnitIds] = {}  # one for each tokenizer file and worker process


def units(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the units of a pass."""
    low = buf if b"<|" in buf.tobytes() else lower_ascii(buf)
    letter = ((low >= 0x61) & (low <= 0x7A)) | ((low >= 0x41) & (low <= 0x5A))
    letter[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] != 0x97) & (low[1:] != 0xB7)
    solid = ~WHITE[low]
    before = np.concatenate(([False], solid[:-1]))
    start = solid & ~before
    start[1:] |= _ENDING[low[1:]] & letter[:-1]
    bounds = np.flatnonzero(start | (before & ~solid))
    first = start[bounds]
    return low, bounds[first], bounds[1:][first[:-1]]


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse) of the different spans, found by hash and held to their bytes: one that is not its first's is a span of its own."""
    h, first, inverse = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
    n = ends - starts
    one = first[inverse]
    apart = np.flatnonzero((n != n[one]) | ~same_spans(buf, starts, starts[one], np.minimum(n, n[one])))
    inverse[apart] = len(first) + np.arange(len(apart))
    return np.concatenate((first, apart)), inverse


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches):
        if path not in _known:
            _known[path] = UnitIds(path)
        table = _known[path]
        for b in batches:
            doc_ids, out = b.column("doc_id").to_pylist(), [[], [], [], [], []]
            for lo, n, buf, offsets in passes(b.column("text")):
                low, starts, ends = units(buf)
                first, inverse = distinct(low, starts, ends)
                raw = low.tobytes()
                at, many = table.find([raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
                source = np.append(table.ids[: table.start[len(table.place)]], np.uint32(end_id))
                at, many = np.append(at, len(source) - 1), np.append(many, 1)
                text_ends = np.searchsorted(starts, offsets[1:])
                seq = np.insert(inverse, text_ends, len(first))
                length = many[seq]
                total = np.concatenate(([0], np.cumsum(length)))
                ids = source[np.repeat(at[seq] - total[:-1], length) + np.arange(total[-1])].astype("<u4")
                stops = total[text_ends + np.arange(1, n + 1)].tolist()
                begin = 0
                for k, stop in enumerate(stops):
                    for place, p in enumerate(range(begin, stop, capacity)):
                        part = ids[p : min(p + capacity, stop)]
                        for col, v in zip(out, (doc_ids[lo + k], place, p - begin, len(part), zlib.crc32(part)), strict=True):
                            col.append(v)
                    begin = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    tune(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_tokenise(tokenizer_path, capacity, end_id), _PIECES)


def reduce_instance(left: Counter, capacity: int) -> list[tuple[tuple, int]]:
    """Fix dominating bins; takes the fixed pieces out of left.  A bin is ((length, how many), ...)."""
    fixed = []
    sizes = sorted(s for s in left if left[s])

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            sizes.pop(bisect_left(sizes, s))

    for s in sorted(sizes, reverse=True):
        while left[s]:
            room = capacity - s
            fits = bisect_left(sizes, room + 1)
            if not fits or (fits == 1 and sizes[0] == s and left[s] == 1):
                fixed.append((((s, 1),), n := left[s]))
                take(s, n)
                continue
            best = sizes[fits - 1]
            if best == s and left[s] == 1:
                best = sizes[fits - 2]  # sizes[0] < s here, so there is one
            two_least = 2 * sizes[0] if left[sizes[0]] > 1 else sizes[0] + (sizes[1] if len(sizes) > 1 else capacity)
            if best != room and two_least <= room:
                break
            n = left[s] // 2 if best == s else min(left[s], left[best])
            if best != room and left[sizes[0]] - n < 2:  # the shortest run out; judge again after one bin
                n = 1
            fixed.append((((s, 2),) if best == s else ((s, 1), (best, 1)), n))
            take(s, 2 * n if best == s else n)
            if best != s:
                take(best, n)
    return fixed


def best_fit(left: Counter, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit, longest first, over kinds of bins instead of single ones."""
    room: dict[int, list] = {}
    rooms: list[int] = []

    def put(r: int, layout: tuple, n: int) -> None:
        if n:
            if r not in room:
                room[r] = []
                insort(rooms, r)
            room[r].append((layout, n))

    for s in sorted((s for s in left if left[s]), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                each, r, layout, bins = capacity // s, capacity, (), n
            else:
                r = rooms[k]
                layout, bins = room[r].pop()
                if not room[r]:
                    del room[r]
                    rooms.pop(k)
                each = r // s
            whole = min(bins, n // each)
            put(r - each * s, layout + ((s, each),), whole)
            n -= whole * each
            if whole < bins and 0 < n < each:
                put(r - n * s, layout + ((s, n),), 1)
                whole, n = whole + 1, 0
            if layout:
                put(r, layout, bins - whole)
    return [kind for r in rooms for kind in room[r]]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    left = Counter(histogram)
    return reduce_instance(left, capacity) + best_fit(left, capacity)


def slot_table(kinds: list[tuple[tuple, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, offset), sorted by length and rank."""
    rows, next_rank, base = [], Counter(), 0
    for layout, n in kinds:
        at = 0
        for s, each in layout:
            rows.append((s, next_rank[s], each, base, at))
            next_rank[s] += each * n
            at += s * each
        base += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    def run(batches):
        scale = np.int64(1) << np.int64(46)  # ranks stay below 2**46
        keys = slots[:, 0] * scale + slots[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            row = slots[np.searchsorted(keys, length * scale + rank, side="right") - 1]
            inside = rank - row[:, 1]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + inside // row[:, 2]), pa.array(row[:, 4] + inside % row[:, 2] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the pieces of a stored table."""
    rows = cut_pieces.withColumn("part", F.spark_partition_id())
    per_part = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows come to the driver: how many pieces there are of each length.
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(plan_bins(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("local", local).join(shifts, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("local")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(slots), _PLACED)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path or default_tokenizer(), capacity, end_id)), capacity)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
