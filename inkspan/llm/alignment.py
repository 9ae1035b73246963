"""Alignment of the tokens that two tokenizers give for the same texts.

Tokens of A (byte-level BPE) and B (pieces with byte fallback) of one text are cut
into groups where both end at the same byte, and linked where their bytes overlap.
A pair of ids counts the documents that hold it linked.

Most groups are one A token and one B token of the same bytes.  An array from A id to
the B id of the same bytes is made from the two vocabularies beforehand, so such a
group is told by one look-up, and its pair counts in a vector as long as A's
vocabulary: each task sends one vector, and no pair of this kind is shuffled.  Only
pairs of irregular groups go through a shuffle, added up in each task first.  Counts
then go back to the documents: the vectors, and the `MOST_BROADCAST` most frequent
irregular pairs, by broadcast; all rarer pairs by a join, so no key of that join is
hot and none is left out.

Texts are cut into units before white space that follows something else; neither
tokenizer joins bytes across such a place (for B that is read off its vocabulary; a
vocabulary that allows it makes every text one unit).  Each different unit is encoded
and aligned once for each task, in numpy, and documents add up their units.

Defined results: null and empty texts, and texts whose tokens do not give back their
bytes, have no tokens: zeros and an empty hash; repeated rows count each; ties for the
best pair are all best; a very long text is read whole, and if it has no white space
it is one unit; identifiers only pass through, null included; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import MOST_BROADCAST, WHITE, cut, owners, passes, read, stored, tune
from inkspan.llm.packing import distinct

#: Units known to a task, and irregular pairs it adds up, before it starts anew.
CACHE_UNITS, CACHE_PAIRS = 400_000, 1_000_000
#: A pair of ids is one number: A's id times this, and B's.
PAIR = np.int64(1) << np.int64(32)
_DOC, _VECTOR, _PAIRS = 0, 1, 2
_ROW = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids array<int>, ids_n array<int>, pairs array<long>, pairs_n array<int>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def a_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, out = byte_letters(), {}
    for token, i in told["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in token)
    for token in told["added_tokens"]:
        out.setdefault(token["id"], token["content"].encode())
    return [out.get(i, b"") for i in range(max(out) + 1)]


def b_bytes(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary."""
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def identity_map(of_a: list[bytes], of_b: list[bytes], is_byte) -> np.ndarray:
    """For each A id the B id of the same bytes, a whole piece before a byte; -1 without one."""
    known = {raw: i for i, raw in enumerate(of_b) if is_byte(i)}
    known.update({raw: i for i, raw in enumerate(of_b) if not is_byte(i)})
    return np.array([known.get(raw, -1) if raw else -1 for raw in of_a], np.int64)


class Blob:
    """Many byte strings in one buffer, gathered by number."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])) if parts else np.zeros(0, np.int64)

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.data[spread(self.start[which], self.size[which])]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the sizes, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Lists:
    """A growing list of arrays in one buffer."""

    def __init__(self):
        self.data, self.ends, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        base = self.ends[self.n]
        while base + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        while self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.data[base : base + len(values)] = values
        self.ends[self.n + 1 : self.n + len(sizes) + 1] = base + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, sizes) of the lists of these numbers."""
        size = self.ends[which + 1] - self.ends[which]
        return self.data[spread(self.ends[which], size)], size


class Aligner:
    """Two tokenizers, and what each unit met so far gives."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_a, of_b = a_bytes(a_path), b_bytes(self.b)
        self.a_blob, self.b_blob = Blob(of_a), Blob(of_b)
        self.identity = identity_map(of_a, of_b, self.b.is_byte)
        self.decimals = Blob([str(i).encode() for i in range(max(len(of_a), len(of_b)))])
        pieces = [raw for i, raw in enumerate(of_b) if not self.b.is_byte(i)]
        self.cuts = not any(b"\n" in raw for raw in pieces)
        inner = {y for raw in pieces for x, y in zip(raw, raw[1:], strict=False) if WHITE[y] and not WHITE[x]}
        self.may_start = WHITE.copy()
        self.may_start[list(inner)] = False
        self.empty()

    def empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.counts = np.zeros((5, 1 << 16), np.int64)  # valid, n_a, n_b, n_groups, n_links
        self.regular, self.irregular, self.text = Lists(), Lists(), []

    def units(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the units of the texts of a pass; each text ends before its newline."""
        start = np.zeros(len(buf) + 1, dtype=bool)
        if self.cuts and len(buf) > 1:
            before = buf[:-1]
            # Control characters, and what may be the end of white space beyond ASCII, are not cut off.
            open_ = before <= 0x20
            open_[1:] |= (before[:-1] == 0xC2) & np.isin(before[1:], (0x85, 0xA0))
            open_[2:] |= np.isin(before[:-2], (0xE1, 0xE2, 0xE3, 0xEF)) & np.isin(before[1:-1], (0x9A, 0x80, 0x81, 0xA0, 0xBB))
            start[1:-1] = self.may_start[buf[1:]] & ~open_
        start[offsets] = True
        start[offsets[1:] - 1] = True
        at = np.flatnonzero(start)
        starts, ends = at[:-1], at[1:]
        kept = np.ones(len(starts), dtype=bool)
        kept[np.searchsorted(starts, offsets[1:] - 1)] = False
        return starts[kept], ends[kept]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The numbers of units; new ones are encoded and aligned."""
        if len(self.place) > CACHE_UNITS:
            self.empty()
        at = np.fromiter(map(self.place.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(at < 0)
        for lo in range(0, len(missing), 5000):
            part = missing[lo : lo + 5000]
            new = [texts[k] for k in part.tolist()]
            at[part] = np.arange(len(self.place), len(self.place) + len(new))
            self._align(new)
            self.place.update(zip(new, at[part].tolist(), strict=True))
        return at

    def _align(self, new: list[bytes]) -> None:
        texts = [t.decode() for t in new]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        if self.cuts:  # a newline keeps B from joining its own space with the unit
            b = [x[2:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        else:
            b = [self.b.encode(t[1:], num_threads=1) for t in texts]
        n = len(new)
        na, nb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, total) for ids, total in ((a, int(na.sum())), (b, int(nb.sum()))))
        unit_a, unit_b = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
        size = np.fromiter(map(len, new), np.int64, n)
        whole = np.frombuffer(b"".join(new), np.uint8)
        valid = self._same(whole, size, self.a_blob, a, unit_a) & self._same(whole, size, self.b_blob, b, unit_b)
        a, b, unit_a, unit_b = a[valid[unit_a]], b[valid[unit_b]], unit_a[valid[unit_a]], unit_b[valid[unit_b]]
        # Ends in one run of bytes: valid units one after the other.
        end_a, end_b = np.cumsum(self.a_blob.size[a]), np.cumsum(self.b_blob.size[b])
        both = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        start_a = end_a - self.a_blob.size[a]
        first = np.searchsorted(end_b, start_a, side="right")
        last = np.searchsorted(end_b - self.b_blob.size[b], end_a, side="left")
        linked_b = spread(first, last - first)
        links = np.repeat(np.arange(len(a)), last - first)
        id_a, id_b, unit = a[links], b[linked_b], unit_a[links]
        same = self.identity[id_a] == id_b
        # Groups of one and one have equal bytes, so they are all here; a pair of equal bytes inside a longer group counts with them.
        self.regular.add(id_a[same], np.bincount(unit[same], minlength=n))
        self.irregular.add(id_a[~same] * PAIR + id_b[~same], np.bincount(unit[~same], minlength=n))
        self.text.extend(self._groups(a, b, group_a, group_b, unit_a, unit_b, n))
        base = len(self.place)
        while base + n > self.counts.shape[1]:
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)), axis=1)
        unit_of_group = unit_a[np.searchsorted(group_a, np.arange(len(both)))]
        found = (valid, np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(unit_of_group, minlength=n), np.bincount(unit, minlength=n))
        self.counts[:, base : base + n] = np.stack(found)

    @staticmethod
    def _same(whole: np.ndarray, size: np.ndarray, blob: Blob, ids: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit give back its bytes."""
        n = len(size)
        got = np.bincount(unit, weights=blob.size[ids], minlength=n).astype(np.int64)
        fits = got == size
        inside = fits[unit]
        joined = blob.take(ids[inside])
        ends = np.cumsum(size)
        wanted = whole[spread((ends - size)[fits], size[fits])]
        wrong = np.bincount(np.repeat(np.flatnonzero(fits), size[fits])[joined != wanted], minlength=n)
        return fits & (wrong == 0)

    def _groups(self, a, b, group_a, group_b, unit_a, unit_b, n: int) -> list[bytes]:
        """The groups of each unit as text; every group ends with ';'."""
        ids, key = np.concatenate((a, b)), np.concatenate((2 * group_a, 2 * group_b + 1))
        order = np.argsort(key, kind="stable")
        ids, key, unit = ids[order], key[order], np.concatenate((unit_a, unit_b))[order]
        size = self.decimals.size[ids] + 1
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        out[spread(ends - size, size - 1)] = self.decimals.take(ids)
        closes = np.append(key[1:] != key[:-1], True)[: len(key)]
        out[ends - 1] = np.where(closes, np.where(key % 2 == 0, ord("|"), ord(";")), ord(","))
        raw = out.tobytes()
        stops = np.cumsum(np.bincount(unit, weights=size, minlength=n)).astype(np.int64).tolist()
        return [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


_known: dict[tuple[str, str], Aligner] = {}  # one for each pair of files and worker process


def _per_row(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, counts, sizes) of the different values of each row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
    at = np.flatnonzero(first)
    return value[at], np.diff(np.append(at, len(row))), np.bincount(row[at], minlength=n)


class PairSums:
    """Documents of each irregular pair, added up in one task."""

    def __init__(self):
        self.parts, self.n, self.pairs, self.sums = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> None:
        self.parts.append(pairs)
        self.n += len(pairs)

    def settle(self) -> int:
        """Merge what came since; how many pairs are held."""
        found, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *self.parts]), return_counts=True)
        both = np.concatenate((self.pairs, found))
        self.pairs, where = np.unique(both, return_inverse=True)
        self.sums = np.bincount(where, weights=np.concatenate((self.sums, counts)), minlength=len(self.pairs)).astype(np.int64)
        self.parts, self.n = [], 0
        return len(self.pairs)

    def rows(self):
        """Batches of (kind, pairs, sums), each bounded; empties itself."""
        for lo in range(0, len(self.pairs), 1 << 16):
            yield _PAIRS, self.pairs[lo : lo + (1 << 16)], self.sums[lo : lo + (1 << 16)]
        self.__init__()


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _batch(kind, row, doc_id, counts, sha, ids, pairs) -> pa.RecordBatch:
    cols = [pa.array(kind, pa.int32()), pa.array(row, pa.int64()), doc_id, *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), *ids, *pairs]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ROW.split(", ")])


def _sum_row(kind: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """A row of sums: keys in pairs; sums in ids_n and pairs_n as low and high 31 bits."""
    one, none = np.array([len(keys)]), np.array([0])
    nothing = np.zeros(0, np.int32)
    return _batch([kind], [None], pa.array([None], pa.int64()), [[0]] * 4, [""], (_lists(nothing, none, pa.int32()), _lists((sums >> 31).astype(np.int32), one, pa.int32())), (_lists(keys, one, pa.int64()), _lists((sums & 0x7FFFFFFF).astype(np.int32), one, pa.int32())))


def _align(a_path: str, b_path: str):
    def run(batches):
        if (a_path, b_path) not in _known:
            _known[a_path, b_path] = Aligner(a_path, b_path)
        table, made = _known[a_path, b_path], TaskContext.get().partitionId() << 33
        vector, sums = np.zeros(len(table.identity), np.int64), PairSums()
        for b in batches:
            for lo, n, buf, offsets in passes(b.column("spaced")):
                starts, ends = table.units(buf, offsets)
                first, inverse = distinct(buf, starts, ends)
                raw = buf.tobytes()
                unit = table.find([raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])[inverse]
                row = owners(starts, offsets)
                good = np.bincount(row, weights=table.counts[0][unit] == 0, minlength=n) == 0
                unit, row = unit[good[row]], row[good[row]]
                counts = [np.bincount(row, weights=table.counts[k][unit], minlength=n).astype(np.int64) for k in range(1, 5)]
                stops = np.searchsorted(row, np.arange(n + 1)).tolist()
                numbers, text = unit.tolist(), table.text
                sha = [hashlib.sha256(b"".join([text[u] for u in numbers[i:j]])[:-1]).hexdigest() if i < j else "" for i, j in zip(stops[:-1], stops[1:], strict=True)]
                ids, size = table.regular.take(unit)
                ids, ids_n, ids_size = _per_row(np.repeat(row, size), ids, n)
                pairs, size = table.irregular.take(unit)
                pairs, pairs_n, pairs_size = _per_row(np.repeat(row, size), pairs, n)
                vector += np.bincount(ids, minlength=len(vector))
                sums.add(pairs)
                yield _batch(np.zeros(n, np.int32), made + np.arange(n), b.column("doc_id").slice(lo, n), counts, sha, (_lists(ids, ids_size, pa.int32()), _lists(ids_n, ids_size, pa.int32())), (_lists(pairs, pairs_size, pa.int64()), _lists(pairs_n, pairs_size, pa.int32())))
                made += n
                if sums.n > CACHE_PAIRS and sums.settle() > CACHE_PAIRS:
                    for found in sums.rows():
                        yield _sum_row(*found)
        held = np.flatnonzero(vector)
        yield _sum_row(_VECTOR, held, vector[held])
        sums.settle()
        for found in sums.rows():
            yield _sum_row(*found)

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (kind 0) with their different pairs and how often they are linked, and of each task's sums (kinds 1 and 2)."""
    tune(docs.sparkSession)
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).alias("spaced"))
    return d.mapInArrow(_align(a_path, b_path), _ROW)


def pair_counts(rows: DataFrame, kind: int) -> DataFrame:
    """key (A id, or pair) and n, the documents that hold it, from the tasks' sums."""
    each = rows.filter(F.col("kind") == kind).select(F.explode(F.arrays_zip(F.col("pairs").alias("key"), F.col("ids_n").alias("high"), F.col("pairs_n").alias("low"))).alias("x"))
    n = F.shiftleft(F.col("x.high").cast("long"), 31) + F.col("x.low")
    return each.groupBy(F.col("x.key").alias("key")).agg(F.sum(n).alias("n"))


_TOLD = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_n array<int>"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _tell(shared):
    """Add what the broadcast counts give; pairs that are not among them go on as rare."""

    def run(batches):
        vector, best, common, common_n = shared.value
        for b in batches:
            lists = [b.column(c) for c in ("ids", "ids_n", "pairs", "pairs_n")]
            ids, ids_n, pairs, pairs_n = (x.flatten().to_numpy() for x in lists)
            at_ids, at_pairs = (x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() for x in (lists[0], lists[2]))
            n_best = _sums(np.where(vector[ids] == best[ids], ids_n, 0).astype(np.int64), at_ids)
            count_sum = _sums(vector[ids] * ids_n, at_ids)
            place = np.minimum(np.searchsorted(common, pairs), max(len(common) - 1, 0))
            known = common[place] == pairs if len(common) else np.zeros(len(pairs), dtype=bool)
            n = np.where(known, common_n[place], 0) if len(common) else np.zeros(len(pairs), np.int64)
            n_best += _sums(np.where(known & (n == best[pairs // PAIR]), pairs_n, 0).astype(np.int64), at_pairs)
            count_sum += _sums(n * pairs_n, at_pairs)
            rare_size = _sums((~known).astype(np.int64), at_pairs)
            cols = [b.column(c.split()[0]) for c in _TOLD.split(", ")[:7]]
            cols += [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), _lists(pairs[~known], rare_size, pa.int64()), _lists(pairs_n[~known], rare_size, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _TOLD.split(", ")])

    return run


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    a_path, b_path = a_path or _default("byte_bpe_50k.json"), b_path or _default("piece_bpe_32k.model")
    with stored(aligned(docs, a_path, b_path, id_col, text_col)) as rows:
        counts = cut(pair_counts(rows, _PAIRS))
        # Both come to the driver as one number for each id of A's vocabulary at most.
        same = pair_counts(rows, _VECTOR).toPandas()
        top = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("n")).toPandas()
        size = len(a_bytes(a_path))
        vector, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        vector[same["key"].to_numpy(np.int64)] = same["n"].to_numpy(np.int64)
        best[top["a"].to_numpy(np.int64)] = top["n"].to_numpy(np.int64)
        best = np.maximum(best, vector)
        frequent = counts.orderBy(F.desc("n"), "key").limit(most_broadcast).toPandas().sort_values("key")
        common, common_n = frequent["key"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast((vector, best, common, common_n))
        told = rows.filter(F.col("kind") == _DOC).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "ids_n", "pairs", "pairs_n")
        told = cut(told.mapInArrow(_tell(shared), _TOLD))
    rare = told.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("times"))
    tops = spark.sparkContext.broadcast(best)
    met = rare.join(counts, "key").select("row", "key", "n", "times").mapInArrow(_rare(tops), "row long, more_best long, more_sum long")
    more = met.groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))
    out = told.join(more, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def _rare(shared):
    def run(batches):
        best = shared.value
        for b in batches:
            key, n, times = (b.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "times"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.where(n == best[key // PAIR], times, 0), pa.int64()), pa.array(n * times, pa.int64())], names=["row", "more_best", "more_sum"])

    return run


def _default(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))
