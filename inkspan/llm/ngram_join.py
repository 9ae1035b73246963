"""Near duplicates by an n-gram Jaccard join: a grouped prefix join.

A document is its set of distinct shingles of some words (a shorter text is one
shingle), and two documents link when 100 * |intersection| >= percent * |union|.
The query takes 3 words and 90 percent; both are parameters.

1. A sketch of fixed size counts how often shingles occur over the whole corpus;
   it gives the global order, rare shingles first.
2. Documents with the same set are one node, nodes with the same prefix in that
   order and the same size are one group, and only group prefixes are indexed.
3. Groups that share a prefix shingle are paired when their sizes, and the
   places at which they hold it, still allow the threshold.
4. Group pairs are expanded to nodes and verified on the whole sets, and
   components are taken over the verified links.

Only components are asked for, so step 3 runs in two rounds.  The first compares
up to `ALL_PAIRS` groups of a shingle with each other and all others with the
first; after its components are known, the second compares, for shingles that
more groups share, only groups of different components.  Every pair that could
still join two components is thus verified, and a dense group of near copies
costs about one comparison for each member.

Defined results: null and empty texts, and texts without a word, have no
shingles and are components of their own; a null identifier takes part, but a
component's smallest identifier is null only if all are; repeated rows link, and
rows of one identifier with different texts are documents of their own; a very long
text is one set, held by one task; an empty table gives an empty result; other
columns of the input, whatever their names, are carried by `keep_one` and else not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import cut, lower_ascii, mix, passes, read, shuffle_partitions, span_hash, tune, words
from inkspan.llm.linking import connected, id_filter, may_hold

#: Of the query: words of a shingle, and the link rule 100 * |intersection| >= PERCENT * |union|.
SHINGLE = 3
PERCENT = 90
ALL_PAIRS = 16
#: Counters of the sketch, in chunks; 4 MB of levels are broadcast whatever the corpus.
SKETCH_BITS, CHUNK_BITS = 22, 16


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, rows: int, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a pass."""
    low = lower_ascii(buf)
    starts, ends = words(low)
    h = span_hash(low, starts, ends)
    at = np.searchsorted(starts, offsets)
    last = max(0, len(h) - shingle + 1)
    several = mix(h[:last])
    for d in range(1, shingle):
        several = mix(several + h[d : last + d])
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            s = np.sort(several[lo : hi - shingle + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            few = np.uint64(hi - lo)
            for k in range(lo, hi):
                few = mix(np.array([few], np.uint64) + h[k])[0]
            out.append(np.array([few], dtype=np.uint64))
        else:
            out.append(h[:0])
    return out


def enough(both, sizes, percent: int):
    """The link rule over an intersection and the sum of two sizes, in whole numbers."""
    return (100 + percent) * both >= percent * sizes


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A linked set shares at least ceil(percent * n / 100) elements, so one of the first n - that + 1."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _sketch(batches, shingle: int = SHINGLE):
    """Counters of one task, in chunks; one byte each, since 255 in one task is frequent enough."""
    counts = None
    for b in batches:
        for _, n, buf, off in passes(b.column("text")):
            sets = [s for s in shingle_sets(buf, off, n, shingle) if len(s)]
            if sets:
                found = np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                counts = found if counts is None else counts + found
    if counts is not None:
        chunks = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << CHUNK_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array([c.tobytes() for c in chunks], pa.binary())], names=["chunk", "counts"])


def _levels(batches):
    """Add up the chunks of this partition, one after the other; a counter becomes its level, 0 to 63."""
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
            totals[chunk] = totals.get(chunk, 0) + np.frombuffer(counts, np.uint8).astype(np.int64)
    levels = [np.minimum(2 * np.log2(t + 1), 63).astype(np.uint8).tobytes() for t in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])


def rarity(d: DataFrame, shingle: int = SHINGLE) -> Broadcast:
    """The level of each counter, over all documents."""
    sketch = d.select("text").mapInArrow(lambda batches: _sketch(batches, shingle), "chunk int, counts binary")
    found = sketch.repartition(shuffle_partitions(d.sparkSession), "chunk").mapInArrow(_levels, "chunk int, levels binary").toArrow()
    levels = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), dtype=np.uint8)
    for chunk, row in zip(found["chunk"].to_pylist(), found["levels"].to_pylist(), strict=True):
        levels[chunk] = np.frombuffer(row, np.uint8)
    return d.sparkSession.sparkContext.broadcast(levels.ravel())


def _node(s: np.ndarray) -> np.int64:
    """A hash of a whole set."""
    one = mix(s).sum(keepdims=True)
    two = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True)
    return mix(one ^ two * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0]


def _nodes(levels: Broadcast, shingle: int = SHINGLE, percent: int = PERCENT):
    def run(batches):
        level = levels.value
        for b in batches:
            n_, node, group, prefix = [], [], [], []
            for _, n, buf, off in passes(b.column("text")):
                for s in shingle_sets(buf, off, n, shingle):
                    size = len(s)
                    n_.append(size)
                    if not size:
                        node.append(0), group.append(0), prefix.append(None)
                        continue
                    ranked = (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                    p = prefix_length(size, percent)
                    ranked = np.sort(np.partition(ranked, p - 1)[:p])
                    node.append(_node(s)), prefix.append(ranked.tobytes())
                    group.append(_node(np.append(ranked, np.uint64(size))))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc_id"), *[pa.array(c, t) for c, t in zip((n_, node, group, prefix), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], names=["doc", "doc_id", "n", "node", "group", "prefix"])

    return run


def _postings(batches):
    for b in batches:
        size = b.column("n").to_numpy()
        prefixes = b.column("prefix").to_pylist()
        if not prefixes:
            continue
        lengths = np.array([len(p) // 8 for p in prefixes])
        token = np.frombuffer(b"".join(prefixes), np.int64)
        place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(place.astype(np.int32)), pa.array(np.repeat(size, lengths).astype(np.int32)), pa.array(np.repeat(b.column("group").to_numpy(), lengths))], names=["token", "place", "n", "id"])


def allowed(n: np.ndarray, place: np.ndarray, n2: np.ndarray, place2: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes, sharing a shingle at these places and none before, can still link."""
    most = np.minimum(n - place, n2 - place2).astype(np.int64)
    return enough(most, n.astype(np.int64) + n2, percent)


_PROPOSED = "a long, b long, token long, place int, n int"


def _proposed(a, b, token=None, place=None, n=None) -> pa.RecordBatch:
    if token is None:
        rest = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32())]
    else:
        rest = [pa.array(token), pa.array(place), pa.array(n)]
    b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
    return pa.RecordBatch.from_arrays([pa.array(a), b, *rest], names=["a", "b", "token", "place", "n"])


def _first_round(batches, percent: int = PERCENT):
    """Pairs (a, b) from rows sorted by (token, place, n, id), and the rows (a, token, place, n) of long runs."""
    names = ("token", "place", "n", "id")
    held = [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64)]  # the first rows of the run that may go on
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in names]
        extra = len(held[0]) if count and held[0][0] == cols[0][0] else 0
        if extra:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
        token, place, n, ids = cols
        head = np.concatenate(([True], token[1:] != token[:-1]))
        start = np.maximum.accumulate(np.where(head, np.arange(len(token)), 0))
        at = np.arange(len(token)) - start
        if extra:
            at[extra:][start[extra:] == 0] += count - extra
        fresh = np.arange(len(token)) >= extra
        a, b = [], []
        for d in range(1, ALL_PAIRS):
            i = np.flatnonzero(fresh & (at >= d) & (at < ALL_PAIRS))
            a.append(i - d), b.append(i)
        i = np.flatnonzero(fresh & (at >= ALL_PAIRS))
        a.append(start[i]), b.append(i)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = allowed(n[a], place[a], n[b], place[b], percent) & (ids[a] != ids[b])
        yield _proposed(ids[a[ok]], ids[b[ok]])
        # Rows of long runs: the first ones are told when the run turns out to be long.
        turn = np.flatnonzero(fresh & (at == ALL_PAIRS))
        early = (start[turn][:, None] + np.arange(ALL_PAIRS)).ravel()
        long_ = np.concatenate((early, i))
        yield _proposed(ids[long_], None, token[long_], place[long_], n[long_])
        tail = start[-1]
        count = int(at[-1]) + 1
        held = [c[tail : tail + ALL_PAIRS] for c in cols]


def _second_round(batches, percent: int = PERCENT):
    """Pairs of different components from rows (token, place, n, id, label) sorted by (token, label)."""
    names = ("token", "place", "n", "id", "label")
    kept: list[list[np.ndarray]] = []

    def pairs(run):
        place, n, ids, label = run[1:]
        for i in range(1, len(ids)):
            j = np.searchsorted(label[: i + 1], label[i])  # rows before it of smaller labels
            if j:
                ok = np.flatnonzero(allowed(n[i], place[i], n[:j], place[:j], percent))
                if len(ok):
                    yield _proposed(ids[ok], np.full(len(ok), ids[i]))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cols[0])], strict=True):
            part = [c[lo:hi] for c in cols]
            if kept and kept[0][0][0] != part[0][0]:
                yield from pairs([np.concatenate(c) for c in zip(*kept, strict=True)])
                kept.clear()
            kept.append(part)
    if kept:
        yield from pairs([np.concatenate(c) for c in zip(*kept, strict=True)])


def _wanted_texts(wanted: Broadcast, shingle: int = SHINGLE):
    """(node, text) of the documents that the filter may hold."""

    def run(batches):
        for b in batches:
            ids = np.array([x or 0 for x in b.column("doc_id").to_pylist()], np.int64)
            hit = pa.array(may_hold(wanted.value, ids))
            texts = b.column("text").filter(hit)
            node = [_node(s) if len(s) else None for _, n, buf, off in passes(texts) for s in shingle_sets(buf, off, n, shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), texts], names=["node", "text"])

    return run


def _sets(texts: pa.Array, shingle: int):
    """The set of each text; no more are held than those of one pass."""
    for _, n, buf, off in passes(texts):
        yield from shingle_sets(buf, off, n, shingle)


def _verify(batches, shingle: int = SHINGLE, percent: int = PERCENT):
    for b in batches:
        ok = []
        for p, q in zip(_sets(b.column("x"), shingle), _sets(b.column("y"), shingle), strict=True):
            if len(p) > len(q):
                p, q = q, p
            both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            ok.append(enough(both, len(p) + len(q), percent))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def verified(d: DataFrame, nodes: DataFrame, group_pairs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The links (a, b) between nodes of the paired groups.

    One text for each node of a pair is shuffled, once for both sides of the
    join; its shingles are made again where the pair is compared.
    """
    member = nodes.select("group", "node")
    pairs = group_pairs.join(member.select(F.col("group").alias("b"), F.col("node").alias("node_b")), "b").join(member.select(F.col("group").alias("a"), F.col("node").alias("node_a")), "a")
    pairs = cut(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).filter("a <> b").distinct())
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    keep = id_filter(wanted.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "doc_id")
    texts = d.mapInArrow(_wanted_texts(keep, shingle), "node long, text string").filter("node IS NOT NULL").groupBy("node").agg(F.first("text").alias("text"))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return cut(both.select("a", "b", "x", "y").mapInArrow(lambda batches: _verify(batches, shingle, percent), "a long, b long, ok boolean").filter("ok").select("a", "b"))


def _keyed(docs: DataFrame, id_col: str, text_col: str):
    """A hash of identifier and text: rows alike in both have one."""
    return F.xxhash64(F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, doc_id, n, node), one per document, and their nodes (node, doc_id, label); documents of one component share a label."""
    spark = docs.sparkSession
    tune(spark)
    parts = shuffle_partitions(spark)
    d = docs.select(_keyed(docs, id_col, text_col).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(d.mapInArrow(_nodes(rarity(d, shingle), shingle, percent), "doc long, doc_id long, n long, node long, `group` long, prefix binary"))
    full = rows.filter("n > 0")
    nodes = cut(full.groupBy("node", "group", "n").agg(F.min("doc_id").alias("doc_id")))
    groups = full.select("group", "n", "prefix").groupBy("group", "n").agg(F.first("prefix").alias("prefix"))
    shared = groups.select("group", "n", "prefix").mapInArrow(_postings, "token long, place int, n int, id long")
    order = ["token", "place", "n", "id"]
    proposed = cut(shared.repartition(parts, "token").sortWithinPartitions(*order).mapInArrow(lambda batches: _first_round(batches, percent), _PROPOSED))
    # Nodes of one group share a prefix, so the group itself is a shingle that they share at its head.
    many = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("group")
    inside = nodes.join(many, "group").select(F.col("group").alias("token"), F.lit(0).alias("place"), F.col("n").cast("int").alias("n"), F.col("node").alias("id"))
    inside = cut(inside.repartition(parts, "token").sortWithinPartitions(*order).mapInArrow(lambda batches: _first_round(batches, percent), _PROPOSED))

    by_node = nodes.select(F.col("node").alias("group"), "node", "doc_id")
    links = verified(d, nodes, proposed.filter("b IS NOT NULL").select("a", "b").distinct(), shingle, percent)
    links = links.unionByName(verified(d, by_node, inside.filter("b IS NOT NULL").select("a", "b").distinct(), shingle, percent))
    label = connected(links)
    more = []
    for found, members in ((proposed, nodes), (inside, by_node)):
        long_ = found.filter("token IS NOT NULL").select(F.col("a").alias("id"), "token", "place", "n")
        named = members.join(label, members["node"] == label["id"], "left").groupBy("group").agg(F.min(F.coalesce("component", "node")).alias("lo"), F.max(F.coalesce("component", "node")).alias("hi"))
        named = named.select(F.col("group").alias("id"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("group")).alias("label"))
        long_ = cut(long_.join(named, "id"))
        split = long_.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
        open_ = long_.join(split, "token").select("token", "place", "n", "id", "label")
        pairs = open_.repartition(parts, "token").sortWithinPartitions("token", "label", "id").mapInArrow(lambda batches: _second_round(batches, percent), _PROPOSED)
        more.append(verified(d, members, pairs.select("a", "b").distinct(), shingle, percent))
    label = connected(links.unionByName(more[0]).unionByName(more[1]))

    named = nodes.join(label, nodes["node"] == label["id"], "left").select("node", "doc_id", F.coalesce("component", "node").alias("label"))
    return rows.select("doc", "doc_id", "n", "node"), cut(named)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, named = labelled(docs, id_col, text_col, shingle, percent)
    least = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    by_node = cut(named.select("node", "label").join(least, "label").select(F.col("node").alias("of"), "component_id"))
    out = rows.join(by_node, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document left of each component: that of the smallest identifier, nulls last, then of the smallest text hash.

    Documents without a word stay; of rows alike in identifier and text one stays.
    """
    rows, named = labelled(docs, id_col, text_col, shingle, percent)
    of = rows.filter("n > 0").select("doc", "doc_id", "node").join(named.select("node", "label"), "node")
    first = of.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "doc")).alias("x")).select("x.doc")
    kept = cut(first.unionByName(rows.filter("n = 0").select("doc")).distinct())
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _keyed(docs, id_col, text_col).alias("doc"))
    out = tagged.join(kept, "doc", "left_semi")
    again = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").join(kept, "doc", "left_semi")
    return (out if again.isEmpty() else out.dropDuplicates(["doc"])).select("row.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS x FROM s),
f AS (SELECT x, count(*) AS c FROM t GROUP BY x HAVING count(*) > 1),
o AS (SELECT t.doc_id, n.n, t.x, row_number() OVER (PARTITION BY t.doc_id ORDER BY f.c NULLS FIRST, t.x) AS r FROM t JOIN n USING (doc_id) LEFT JOIN f USING (x)),
p AS (SELECT * FROM o WHERE r <= n - ceil(n * 9 / 10.0) + 1 AND x IN (SELECT x FROM f)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, c.na, c.nb, count(*) AS k FROM c JOIN t ta ON ta.doc_id = c.a JOIN t tb ON tb.doc_id = c.b AND tb.x = ta.x GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 90 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""
