"""A Merkle manifest of a dataset: one root for all rows, and a proof for each.

Each row's leaf is the SHA-256 of its fields, each written with its length.  The
leaves of a group, in the order of their identifiers, are folded pair by pair (runs
of `ARITY`) into one subroot, and the subroots, in the order of the groups, into the
root.  A row's proof is what stands beside its path, from the leaf to the root.

Levels are strings.  A block is an aligned stretch of `BLOCK` nodes of one group, and
keeps each of its levels as one string of digests of fixed width.  Parents are hashes
of fixed-width substrings of the level below; what stands on either side of a node,
inside its run, is a substring too, its flanks.  A block gives one digest, and the
blocks' digests are the nodes of the next round, so a tree of any height takes
log(rows) / log(BLOCK) rounds, and no task holds more of a group than a block, however
large the group is.  Places are ranks inside sorted ranges, shifted by the sizes of
earlier ranges.  Flanks of upper rounds meet the blocks below, not the rows.

Only DataFrame functions are used.  Defined results: null fields are '-'; a null
group is a group of its own and comes first; null identifiers come first; rows alike
in group and identifier are ordered by their leaves, so equal rows have the same set
of proofs whatever their order; a single row is its own subroot, and a single group's
subroot the root; null and empty texts differ; a very long text is hashed whole; an
empty table gives an empty result; columns that are not named as fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm.common import cut, is_small, read, shuffle_partitions

#: Nodes that become one parent, and nodes of a block: a power of ARITY.
ARITY, BLOCK_LEVELS = 2, 8
BLOCK = ARITY**BLOCK_LEVELS
WIDTH = 64


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of fields: '-' for null, else the number of bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def with_places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add place (from 0, in its group) and nodes (of the group).  Rows come from a stored table.

    Groups and orders are dealt out by ranges of both, so that one group lies in many.
    """
    parts = shuffle_partitions(rows.sparkSession)
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = cut(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "_tie").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))  # no more rows than ranges and groups
    by_group = Window.partitionBy(group)
    before = F.sum("_n").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(before, F.lit(0)).alias("_shift"), F.sum("_n").over(by_group).alias("nodes"))
    local = F.row_number().over(Window.partitionBy("_part", group).orderBy(*keys[1:], "_tie")) - 1
    met = dealt.withColumn("_local", local).join(shifts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.withColumn("place", F.col("_shift") + F.col("_local")).drop("_tie", "_part", "_p", "_g", "_n", "_shift", "_local")


def _parents(level: Column) -> Column:
    """The level above a level, given as the bytes of its digests."""
    run = ARITY * WIDTH
    many = F.ceil(F.length(level) / run).cast("int")
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.sha2(F.substring(level, k * run + 1, F.lit(run)), 256))).cast("binary")


def _levels(lowest: Column, nodes: Column) -> Column:
    """The levels of a block, from its nodes up.  A tree stops where its whole group is one node; a block that ends a longer group goes on."""

    def climb(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        return F.when((nodes <= BLOCK) & (F.length(last) <= WIDTH), found).otherwise(F.concat(found, F.array(_parents(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), F.array(lowest), climb)


_FLANKS = "array<struct<left:string,right:string>>"


def _flanks(level: Column, place: Column) -> Column:
    """What stands left and right of a node in its run."""
    inside = F.pmod(place, F.lit(ARITY))
    first = (place - inside) * WIDTH + 1
    left = F.substring(level, first, inside * WIDTH)
    right = F.substring(level, first + (inside + 1) * WIDTH, (ARITY - 1 - inside) * WIDTH)
    return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))


def _path(levels: Column, place: Column) -> Column:
    """Flanks of a node of a block, from its own level up, for the levels that have a parent."""
    below = F.slice(levels, 1, F.size(levels) - 1)
    return F.transform(below, lambda level, k: _flanks(level, F.floor(place / F.pow(F.lit(ARITY), k)).cast("int")))


def fold_trees(nodes: DataFrame, group: str) -> DataFrame:
    """Add top (the root of its group's tree) and path (flanks up to it) to nodes with digest, place and nodes.

    Rounds go up until every group is one block; then paths come down again.
    """
    rounds, rows = [], nodes
    while True:
        members = F.array_sort(F.collect_list(F.struct("place", *[c for c in rows.columns if c not in (group, "place", "nodes")])))
        blocks = rows.groupBy(group, F.floor(F.col("place") / BLOCK).alias("block"), "nodes").agg(members.alias("members"))
        blocks = blocks.withColumn("levels", _levels(F.concat_ws("", F.col("members.digest")).cast("binary"), F.col("nodes")))
        blocks = cut(blocks.withColumn("top", F.element_at("levels", -1).cast("string")))
        rounds.append(blocks)
        higher = blocks.filter(F.col("nodes") > BLOCK)
        if higher.isEmpty():
            break
        rows = higher.select(group, F.col("top").alias("digest"), F.col("block").alias("place"), F.ceil(F.col("nodes") / BLOCK).alias("nodes"))
    above = None
    for blocks in reversed(rounds):
        if above is None:
            met = blocks.withColumn("upper", F.array().cast(_FLANKS))
        else:
            a = above.select(F.col(group).alias("_g"), F.col("place").alias("_b"), F.col("top").alias("_top"), F.col("path").alias("_path"))
            same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))
            met = blocks.join(F.broadcast(a) if is_small(a) else a, same, "left").withColumn("top", F.coalesce("_top", "top")).withColumn("upper", F.coalesce("_path", F.array().cast(_FLANKS)))
        inside = (F.col("m.place") - F.col("block") * BLOCK).cast("int")
        kept = [F.col(f"m.{c}") for c in rounds[0].schema["members"].dataType.elementType.names] if blocks is rounds[0] else [F.col("m.place")]
        opened = met.withColumn("m", F.explode("members"))
        above = opened.select(group, *kept, "top", F.concat(_path(F.col("levels"), inside), "upper").alias("path"))
    return above


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the flanks of its path give."""
    return F.aggregate(path, node, lambda h, x: digest(F.concat(x["left"], h, x["right"])))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), more: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, group, leaf, subroot, root, path, and more columns made from those of docs."""
    made = [c.alias(k) for k, c in (more or {}).items()]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("group"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"), *made)
    leaves = fold_trees(with_places(cut(d), "group", ["id", "digest"]), "group")
    leaves = cut(leaves)
    subroots = leaves.filter("place = 0").select(F.lit(0).alias("all"), "group", F.col("top").alias("digest"))
    tops = fold_trees(with_places(cut(subroots), "all", ["group"]), "all").select(F.col("group").alias("_g"), F.col("top").alias("root"), F.col("path").alias("_path"))
    tops = cut(tops)
    out = leaves.join(F.broadcast(tops) if is_small(tops) else tops, F.col("group").eqNullSafe(F.col("_g")))
    return out.select("id", "group", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "_path").alias("path"), *(more or {}))


def proof(path: Column) -> Column:
    """The flanks of a path as one string, from the leaf to the root, left to right."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda x: F.array(x["left"], x["right"]))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    changed = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    rows = manifest(docs, more={"tampered": F.when(hit & F.col("n_chars").isNotNull(), changed)})
    out = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)),
      lambda h, c: xor(tab[(xor(h, c) & 255) + 1], h >> 8)), 4294967295) % 7 = 0 AS hit
  FROM documents, crc),
l AS (SELECT rid, doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' WHEN hit THEN strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i FROM l),
t AS (SELECT lang, i, leaf AS h, 0 AS k, count(*) OVER (PARTITION BY lang) AS n FROM p
  UNION ALL SELECT lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(k) + 1, (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, i // 2),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM t WHERE n = 1),
u AS (SELECT j AS i, subroot AS h, 0 AS k, count(*) OVER () AS n FROM sub
  UNION ALL SELECT i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(k) + 1, (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY i // 2),
low AS (SELECT p.rid, list({'s': coalesce(o.h, ''), 'r': (p.i >> t.k) % 2 = 1} ORDER BY t.k) AS path
  FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.i = p.i >> t.k AND t.n > 1
  LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.k = t.k AND o.i = xor(t.i, 1) GROUP BY p.rid),
top AS (SELECT sub.lang, list({'s': coalesce(o.h, ''), 'r': (sub.j >> u.k) % 2 = 1} ORDER BY u.k) AS path
  FROM sub JOIN u ON u.i = sub.j >> u.k AND u.n > 1 LEFT JOIN u o ON o.k = u.k AND o.i = xor(u.i, 1) GROUP BY sub.lang),
f AS (SELECT p.*, sub.subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(low.path, []), coalesce(top.path, [])) AS path
  FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang LEFT JOIN low ON low.rid = p.rid LEFT JOIN top ON top.lang IS NOT DISTINCT FROM p.lang),
g AS (SELECT *, list_reduce(list_prepend(changed, list_transform(path, lambda x: CASE WHEN x.r THEN 'l' ELSE 'r' END || x.s)),
    lambda h, x: sha256(CASE WHEN x[1] = 'l' THEN substr(x, 2) || h ELSE h || substr(x, 2) END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.s), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
