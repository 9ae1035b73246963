"""Mixing sources to target weights by Pareto order sampling.  DataFrame functions only.

Each source has a target number of words.  A document may expect some copies,
between 0 and `MOST_COPIES`: a rate of its source times the length of its size as
a binary number, so longer documents expect slowly more.  The rate is the one at
which the expected words of the source are its target.  The whole part of the
expectation is certain copies; the fraction is the inclusion probability p of one
copy more.  Those are drawn in Pareto order: documents are ranked by the random
odds u / (1 - u) over the inclusion odds p / (1 - p), and in that order each
document that still fits in the words left to the source is taken; one that does
not fit is passed over.  At the end the smallest document that passes the target
is added if that ends nearer to it.  u comes from the md5 of identifier and text,
so reruns agree.

No window ever holds a source.  The order is cut in slices of the rank, sums of
the slices find the one in which the words run out, and only its rows are
ordered; so on from there with the documents that fit in the gap, until the gap
is under `CLOSING` words.  Of documents that weigh the same the pass then takes the
first ones in rank, as many as fill the gap at most, and no later one, since the gap
never grows; so all that may still fit, some 36,000 documents, are one array for each
source.  A source's plan is one row:
its rate, the stretches of the order that are taken, and the closing picks.
Documents meet it in a broadcast join if the plan is proven small, and then no
text is shuffled; with very many sources they meet by source, and adaptive
execution splits a source with very many documents.

Defined results: null text has size 0; a null source is a source of its own and
comes last; documents of size 0 get their certain copies only; rows alike in
identifier, source and text are decided together; ties of the rank go by
identifier, nulls first, then size; a very long document that does not fit is
passed over like any other; an empty table gives an empty result; other columns
are carried by `mix`, whatever their names, and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm.common import cut, is_small, read, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Slices of the order: at least LEAST_SLICES, and more where a slice would hold over SLICE_ROWS documents.
LEAST_SLICES, SLICE_ROWS = 4096, 1 << 16
#: Words left to a source under which the rest is picked from one array; it holds at most the sum of CLOSING / words over all weights, some 36,000 documents.
CLOSING = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number above 0 and below 1 from identifier and text: 52 bits of their md5."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(whole.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """id, source, src (never null), size, size_class, u, and more columns."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("src"), n_words(text).alias("size"), uniform(F.col(id_col).cast("long"), text).alias("u"), *more)
    return d.withColumn("size_class", F.length(F.bin("size")).cast("long"))


def _places(sources: DataFrame) -> DataFrame:
    """Add place, from 0, in code-point order of source, nulls last: places inside ranges, shifted by the sizes of earlier ranges."""
    parts = shuffle_partitions(sources.sparkSession)
    rows = cut(sources.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    shifts = sizes.withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "shift")
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return rows.withColumn("local", local).join(F.broadcast(shifts), "part").withColumn("place", F.col("shift") + F.col("local")).drop("part", "local", "shift")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, src, source_size, target.

    Sources in code-point order take the weights in turn and share the budget;
    a source above `most` times its size is held there and its excess goes to
    the rest by weight, again and again until none is above.
    """
    s = _places(cut(sized.groupBy("source", "src").agg(F.sum("size").alias("source_size"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = cut(s.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size")).drop("place"))
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(above.cast("long")), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if r[0] in (None, held) or not r[2]:
            break
        held, level = r[0], (budget - r[1]) / r[2]
    return s.select("source", "src", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def source_rates(sized: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Targets with rate (expected copies for each unit of size class) and need (words left after the certain copies)."""
    classes = sized.filter("size > 0").groupBy("src", "size_class").agg(F.sum("size").alias("words"))  # some forty rows a source
    classes = classes.join(targets.select("src", "target"), "src")
    down = Window.partitionBy("src").orderBy(F.desc("size_class"))
    held = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("size_class")).over(down.rowsBetween(0, Window.unboundedFollowing))
    classes = classes.withColumn("if_last", (F.col("target") - F.lit(float(most)) * held) / rest)
    fits = F.col("if_last") * F.col("size_class") <= F.lit(float(most))
    classes = classes.withColumn("rate", F.coalesce(F.max(F.when(fits, F.struct("size_class", "if_last"))).over(Window.partitionBy("src"))["if_last"], F.lit(float(most))))
    certain = F.floor(F.least(F.lit(float(most)), F.col("rate") * F.col("size_class"))).cast("long")
    found = classes.groupBy("src").agg(F.first("rate").alias("rate"), F.sum(certain * F.col("words")).alias("certain"))
    s = targets.join(found, "src", "left")
    need = F.floor(F.col("target") - F.coalesce("certain", F.lit(0)) + 1e-6).cast("long")
    return s.select("source", "src", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.greatest(need, F.lit(0)).alias("need"))


def ranks(rows: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Add certain (copies), p (inclusion probability of one more) and pareto (its rank; null where p is 0) by the rate."""
    expected = F.least(F.lit(float(most)), F.col("rate") * F.col("size_class"))
    rows = rows.withColumn("certain", F.floor(expected).cast("long")).withColumn("p", expected - F.floor(expected))
    odds = F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("p") / (1 - F.col("p")))
    return rows.withColumn("pareto", F.col("u") / (1 - F.col("u")) / odds)


def _key() -> Column:
    return F.struct("pareto", "id", "size")


_KEY = "struct<pareto:double,id:bigint,size:bigint>"
_SPAN = f"struct<after:{_KEY},border:{_KEY},most:bigint>"


def _meet(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(plan) if small else plan, "src")


def plan_sources(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: targets, rate, the taken stretches of the Pareto order, the closing picks."""
    s = cut(source_rates(sized, targets))
    small = is_small(s)
    units = sized.groupBy("src", "id", "size", "size_class", "u").agg((F.count(F.lit(1)) * F.col("size")).cast("long").alias("words"))
    pool = ranks(_meet(units, s.select("src", "rate"), small)).filter("pareto IS NOT NULL").select("src", "id", "size", "size_class", "words", "pareto")
    pool = cut(pool)
    slices = LEAST_SLICES
    while slices * SLICE_ROWS < pool.count():
        slices *= 2
    place = F.floor(F.col("pareto") / (1 + F.col("pareto")) * slices).cast("int")

    s = cut(s.select("*", F.col("need").alias("gap"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"), F.expr(f"cast(struct(-1D, null, null) as {_KEY})").alias("after")))
    first = True
    while first or not s.filter(F.col("gap") >= CLOSING).isEmpty():
        # All that may still fit: the first time every document is looked at.
        fits = (F.col("gap") > 0) if first else (F.col("gap") >= CLOSING)
        open_ = s.filter(fits).select("src", "gap", "after")
        left = _meet(pool.withColumn("slice", place), open_, small).filter((F.col("size") <= F.col("gap")) & (_key() > F.col("after")))
        sums = left.groupBy("src", "gap", "slice").agg(F.sum("words").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
        sums = cut(sums.withColumn("upto", upto))
        crossing = cut(sums.filter("upto > gap").groupBy("src").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("x")).select("src", "x.*"))
        inside = _meet(left, crossing.withColumnRenamed("slice", "at"), small).filter("slice = at")
        running = F.sum("words").over(Window.partitionBy("src").orderBy("pareto", F.asc_nulls_first("id"), "size").rowsBetween(Window.unboundedPreceding, 0))
        inside = inside.withColumn("upto", F.col("before") + running)
        ends = inside.groupBy("src").agg(F.min(F.when(F.col("upto") > F.col("gap"), _key())).alias("border"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("inside"), F.max("before").alias("before"))
        totals = sums.groupBy("src").agg(F.max("upto").alias("total")).join(ends, "src", "left")
        got = F.coalesce("inside", "before", "total", F.lit(0))
        no_border = F.expr(f"cast(struct(double('Infinity'), null, null) as {_KEY})")
        s = s.join(F.broadcast(totals) if small else totals, "src", "left").withColumn("went", fits)
        border = F.coalesce("border", no_border)
        s = s.withColumn("spans", F.when(F.col("went"), F.concat("spans", F.array(F.struct("after", border.alias("border"), F.col("gap").alias("most")).cast(_SPAN)))).otherwise(F.col("spans")))
        # Without a border all that fit are taken, and nothing is left to try.
        s = s.withColumn("after", F.when(F.col("went"), border).otherwise(F.col("after"))).withColumn("short", F.when(F.col("went"), F.col("gap") - got).otherwise(F.col("gap")))
        s = cut(s.withColumn("gap", F.when(F.col("went") & F.col("border").isNull(), 0).otherwise(F.col("short"))).drop("total", "border", "inside", "before", "went"))
        first = False
    # The closing picks.  The gap never grows, so of documents that weigh the same the pass takes the first few and no later one: no more than fill the gap.
    left = _meet(pool.withColumn("slice", place), s.filter("gap > 0").select("src", "gap", "after"), small).filter((F.col("words") <= F.col("gap")) & (_key() > F.col("after")))
    alike = Window.partitionBy("src", "words")
    counts = left.groupBy("src", "gap", "words", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(alike.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    most = F.floor(F.col("gap") / F.col("words"))
    counts = counts.filter(F.col("earlier") < most).groupBy("src", "words").agg(F.max("slice").alias("last"))
    left = left.join(counts, ["src", "words"]).filter("slice <= last")
    left = left.withColumn("nth", F.row_number().over(alike.orderBy("pareto", F.asc_nulls_first("id"), "size"))).filter(F.col("nth") <= most)
    arrays = left.groupBy("src", "gap").agg(F.array_sort(F.collect_list(F.struct("pareto", "id", "size", "words"))).alias("all"))
    start = F.struct(F.col("gap").alias("gap"), F.expr(f"cast(array() as array<{_KEY}>)").alias("picks"))

    def pick(acc, x):
        fits = x["words"] <= acc["gap"]
        key = F.struct(x["pareto"].alias("pareto"), x["id"].alias("id"), x["size"].alias("size"))
        return F.struct(F.when(fits, acc["gap"] - x["words"]).otherwise(acc["gap"]).alias("gap"), F.when(fits, F.concat(acc["picks"], F.array(key))).otherwise(acc["picks"]).alias("picks"))

    picked = arrays.select("src", F.aggregate("all", start, pick).alias("end")).select("src", F.col("end.gap").alias("rest"), "end.picks")
    s = s.join(F.broadcast(picked) if small else picked, "src", "left")
    s = cut(s.withColumn("short", F.coalesce("rest", "short")).withColumn("picks", F.coalesce("picks", F.expr(f"cast(array() as array<{_KEY}>)"))).drop("rest", "gap", "after"))
    beyond = _meet(pool, s.filter("short > 0").select("src", "short", "spans", "picks"), small).filter(~_taken() & (F.col("words") > F.col("short")) & (F.col("words") < 2 * F.col("short")))
    extra = beyond.groupBy("src").agg(F.min(F.struct("words", "pareto", "id", "size")).alias("b")).select("src", F.struct("b.pareto", "b.id", "b.size").alias("extra"))
    s = s.join(F.broadcast(extra) if small else extra, "src", "left")
    return cut(s.withColumn("picks", F.when(F.col("extra").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("extra")))).drop("extra", "short", "need"))


def _taken() -> Column:
    """Whether a row with a rank lies in a stretch that its source takes, or is a closing pick."""
    inside = F.exists("spans", lambda x: (_key() > x["after"]) & (_key() < x["border"]) & (F.col("size") <= x["most"]))
    return F.col("pareto").isNotNull() & (inside | F.array_contains("picks", _key()))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and copies to rows of `sized_rows`."""
    j = ranks(_meet(rows, plan.drop("source"), is_small(plan)))
    return j.withColumn("copies", F.col("certain") + _taken().cast("long")).drop("spans", "picks", "rate")


def mixed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken, p, pareto."""
    sized = cut(sized_rows(docs, id_col, text_col, source_col))
    out = with_copies(sized, plan_sources(sized, source_targets(sized)))
    return out.select("id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "p", "pareto")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    sized = cut(sized_rows(docs, id_col, text_col, source_col))
    plan = plan_sources(sized, source_targets(sized))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = with_copies(sized_rows(docs, id_col, text_col, source_col, row), plan).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_words(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH RECURSIVE z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, most / weight AS level, (budget - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS if_first
       FROM s1 WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
s3 AS (SELECT source, source_size, least(most, (SELECT arg_min(if_first, level) FROM s2 WHERE level >= if_first) * weight) AS target FROM s2),
c0 AS (SELECT source, length(bin(size)) AS k, sum(size)::BIGINT AS words FROM z WHERE size > 0 GROUP BY ALL),
c1 AS (SELECT c0.*, s3.target, (s3.target - 2.0::DOUBLE * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(words * k) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS if_last
       FROM c0 JOIN s3 ON c0.source IS NOT DISTINCT FROM s3.source WINDOW o AS (PARTITION BY c0.source ORDER BY k DESC)),
c2 AS (SELECT source, coalesce(arg_max(if_last, k) FILTER (WHERE if_last * k <= 2.0), 2.0)::DOUBLE AS rate FROM c1 GROUP BY source),
c3 AS (SELECT c0.source, any_value(rate) AS rate, sum(floor(least(2.0::DOUBLE, rate * k))::BIGINT * words)::BIGINT AS certain
       FROM c0 JOIN c2 ON c0.source IS NOT DISTINCT FROM c2.source GROUP BY c0.source),
s4 AS (SELECT s3.*, coalesce(rate, 0.0)::DOUBLE AS rate, greatest(floor(target - coalesce(certain, 0) + 1e-6)::BIGINT, 0) AS need
       FROM s3 LEFT JOIN c3 ON s3.source IS NOT DISTINCT FROM c3.source),
d AS (SELECT z.*, s4.* EXCLUDE (source), least(2.0::DOUBLE, rate * length(bin(size))) AS e FROM z JOIN s4 ON z.source IS NOT DISTINCT FROM s4.source),
q AS (SELECT *, floor(e)::BIGINT AS certain, CASE WHEN e > floor(e) AND size > 0 THEN u / (1 - u) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS pareto FROM d),
n AS (SELECT source, doc_id, size, pareto, need, count(*) * size AS words FROM q WHERE pareto IS NOT NULL GROUP BY source, doc_id, size, pareto, need),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pareto, doc_id NULLS FIRST, size) AS r FROM n),
g AS (SELECT source, r, doc_id, size, pareto, words, words <= need AS taken, need - CASE WHEN words <= need THEN words ELSE 0 END AS gap FROM t WHERE r = 1
      UNION ALL SELECT t.source, t.r, t.doc_id, t.size, t.pareto, t.words, t.words <= gap, gap - CASE WHEN t.words <= gap THEN t.words ELSE 0 END
      FROM g JOIN t ON t.r = g.r + 1 AND t.source IS NOT DISTINCT FROM g.source),
f AS (SELECT source, min(gap) AS short FROM g GROUP BY source),
x AS (SELECT g.source, g.doc_id, g.size, g.pareto FROM g JOIN f ON g.source IS NOT DISTINCT FROM f.source WHERE NOT taken AND short > 0 AND words > short AND words < 2 * short
      QUALIFY row_number() OVER (PARTITION BY g.source ORDER BY g.words, g.pareto, g.doc_id NULLS FIRST, g.size) = 1),
k AS (SELECT source, doc_id, size, pareto FROM g WHERE taken UNION ALL SELECT * FROM x)
SELECT q.doc_id, q.size, q.source_size, q.target, ((certain + (k.pareto IS NOT NULL)::INT) * q.size)::BIGINT AS taken
FROM q LEFT JOIN k ON k.source IS NOT DISTINCT FROM q.source AND k.doc_id IS NOT DISTINCT FROM q.doc_id AND k.size = q.size AND k.pareto = q.pareto
"""
