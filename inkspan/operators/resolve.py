"""Entity resolution: aliases, surnames, merging inside an article, and the durable dimension."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions.text import PARTICLES, display_rule, initials, key_words, norm_key, significant_words, squeeze, strip_title

#: The actors that an analysis names.
ACTORS = ("dominant_actor", "blamed_actor", "credited_actor")
_FIELDS = ["article_id", "name", "type", "mentions_count", "sentiment_toward", "sentiment_score", "context", "extraction_confidence"]


def _alias_rows(aliases: DataFrame) -> DataFrame:
    """One row per key of the active aliases; of several the highest id wins."""
    last = F.max_by(F.struct("canonical_name", F.col("type").alias("alias_type")), "id")
    return aliases.filter("is_active").groupBy("alias_key").agg(last.alias("to")).select("alias_key", "to.*")


def resolve_aliases(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace name and type of mentions whose key is an active alias."""
    j = mentions.withColumn("_key", norm_key(F.col("name"))).join(_alias_rows(aliases), F.col("_key") == F.col("alias_key"), "left")
    return j.withColumn("name", F.coalesce("canonical_name", "name")).withColumn("type", F.coalesce("alias_type", "type")).drop("_key", "alias_key", "canonical_name", "alias_type")


def last_words(names: DataFrame) -> DataFrame:
    """(surname, name) of the names of two or more significant words."""
    words = names.select("name", significant_words(F.col("name")).alias("words")).filter(F.size("words") >= 2)
    return words.select(F.element_at("words", -1).alias("surname"), "name")


def person_map(mentions: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """(surname, full_name): last significant words that belong to exactly one known full name."""
    names = mentions.filter("type = 'PERSON'").select("name").union(canonical.filter("type = 'PERSON'").select("name"))
    names = names.union(aliases.filter("type = 'PERSON' AND is_active").select("canonical_name")).distinct()
    return last_words(names).groupBy("surname").agg(F.min("name").alias("full_name"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def resolve_surnames(mentions: DataFrame, surnames: DataFrame) -> DataFrame:
    """Give a person known by one significant word the only full name that ends in it."""
    words = significant_words(F.col("name"))
    word = F.when((F.col("type") == "PERSON") & (F.size(words) == 1), words[0])
    j = mentions.withColumn("_word", word).join(surnames, F.col("_word") == F.col("surname"), "left")
    changes = F.col("full_name").isNotNull() & (norm_key(F.col("full_name")) != norm_key(F.col("name")))
    return j.withColumn("name", F.when(changes, F.col("full_name")).otherwise(F.col("name"))).drop("_word", "surname", "full_name")


class _OpenHeads:
    """The heads of one kind in their order, found by key, by word and by initials."""

    def __init__(self):
        self.heads: list[tuple[int, str, frozenset]] = []
        self.by_key: dict[str, int] = {}
        self.by_initials: dict[str, int] = {}
        self.by_word: dict[str, list[int]] = {}

    def add(self, row: int, key: str, mine: frozenset) -> None:
        n = len(self.heads)
        self.heads.append((row, key, mine))
        self.by_key.setdefault(key, n)
        self.by_initials.setdefault("".join(w[0] for w in key.split() if w not in PARTICLES), n)
        for word in set(key.split()):
            self.by_word.setdefault(word, []).append(n)

    def _with(self, words: Iterable[str]) -> list[int]:
        """Heads that hold the rarest of the words; the others are to be looked for in them."""
        return min((self.by_word.get(w, []) for w in words), key=len, default=[])

    def target(self, key: str, mine: frozenset, acronym: bool, partial: bool) -> int | None:
        if key in self.by_key:
            return self.heads[self.by_key[key]][0]
        whole = f" {key} "
        inside = next((n for n in self._with(key.split()) if whole in f" {self.heads[n][1]} "), None)
        short = self.by_initials.get(key) if acronym else None
        first = [n for n in (inside, short) if n is not None]
        if first:
            return self.heads[min(first)][0]
        if not partial or len(mine) < 2:
            return None
        wider = []
        for n in self._with(mine):
            if mine < self.heads[n][2]:
                wider.append(n)
                if len(wider) > 1:
                    return None
        return self.heads[wider[0]][0] if wider else None


def assign_groups(rows: Iterable[tuple[str, str, float]], by_initials: bool = False) -> list[int | None]:
    """For (key, type, weight) rows, the row that each joins, itself for the head of a group.

    Rows go from the longest key down, heavier first.  A row joins the group of
    its own key, or the first whose key holds it as whole words, or, for
    persons of two or more significant words, the only group whose words are
    more than its own.  With by_initials an acronym also joins a name that it
    abbreviates, and partial names do not.  Rows with an empty key join nothing.
    Heads are found by their words, so a row meets only those that hold its
    rarest one.
    """
    rows = list(rows)
    heads: dict[str, _OpenHeads] = {}
    out: list[int | None] = [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (-len(rows[i][0]), -rows[i][2])):
        key, kind, _ = rows[i]
        if not key:
            continue
        open_ = heads.setdefault(kind, _OpenHeads())
        mine = frozenset(key.split()) - set(PARTICLES)
        acronym = by_initials and re.fullmatch(r"[^\W\d_]{2,6}", key) is not None
        target = open_.target(key, mine, acronym, kind == "PERSON" and not by_initials)
        out[i] = i if target is None else target
        if target is None:
            open_.add(i, key, mine)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _heads(keys: pd.Series, kinds: pd.Series, weights: pd.Series) -> pd.Series:
    """For the mentions of each article, the place of the mention that each joins."""
    return pd.Series([assign_groups(list(zip(k, t, w, strict=True))) for k, t, w in zip(keys, kinds, weights, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _acronym_heads(keys: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([assign_groups([(a, b, 0) for a, b in zip(k, t, strict=True)], by_initials=True) for k, t in zip(keys, kinds, strict=True)])


def _collected(rows: DataFrame, *fields: str) -> DataFrame:
    """One row for each article, with its rows as an ordered array m; fields starts with the order."""
    return rows.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))


def merge_duplicates(mentions: DataFrame) -> DataFrame:
    """Merge the variants of a name inside each article; articles of one mention skip Python.

    mentions may have a column `ord` that gives the order inside an article;
    without it the order is that of the names.  Python only decides which
    mention joins which, for many articles at a time.
    """
    m = mentions if "ord" in mentions.columns else mentions.withColumn("ord", F.col("name"))
    m = m.withColumn("key", norm_key(F.col("name"))).filter("key <> ''").withColumn("mentions_count", F.col("mentions_count").cast("long"))
    c = _collected(m, "ord", "key", *_FIELDS[1:])
    heads = F.when(F.size("m") > 1, _heads("m.key", "m.type", "m.mentions_count")).otherwise(F.array(F.lit(0)))
    z = c.select("article_id", F.posexplode(F.arrays_zip("m", heads.alias("head"))).alias("pos", "z")).select("article_id", "pos", "z.m.*", F.col("z.head").alias("head"))
    z = z.withColumn("rank", F.struct((-F.length("key")).alias("k"), (-F.col("mentions_count")).alias("n"), "pos"))
    told = F.when(F.col("sentiment_toward").isNotNull(), F.col("rank"))
    g = z.groupBy("article_id", "head").agg(
        F.min_by(F.struct("name", "type", "sentiment_score"), "rank").alias("first"), F.sum("mentions_count").alias("mentions_count"),
        F.min_by(F.struct("sentiment_toward", "sentiment_score"), told).alias("told"),
        F.min_by("context", F.when(F.col("context").isNotNull(), F.col("rank"))).alias("context"), F.max("extraction_confidence").alias("extraction_confidence"),
    )
    score = F.when(F.col("told").isNotNull(), F.col("told.sentiment_score")).otherwise(F.col("first.sentiment_score"))
    return g.select("article_id", "first.name", "first.type", "mentions_count", F.col("told.sentiment_toward").alias("sentiment_toward"), score.alias("sentiment_score"), "context", "extraction_confidence")


def merge_mention_groups(groups: DataFrame) -> DataFrame:
    """Add head_key to (article_id, key, type, count, ord): the group that a short name or an acronym joins."""
    c = _collected(groups.select("article_id", "ord", "key", "type", "count"), "ord", "key", "type", "count")
    c = c.withColumn("head", _acronym_heads("m.key", "m.type"))
    z = c.select("article_id", "m", F.explode(F.arrays_zip("m", "head")).alias("z"))
    return z.select("article_id", "z.m.key", "z.m.type", "z.m.count", "z.m.ord", F.get("m", F.col("z.head"))["key"].alias("head_key"))


def merge_groups(groups: DataFrame) -> DataFrame:
    """Groups of `group_mentions` with short names and acronyms merged into the names they stand for.

    (article_id, key, type, name, count, variants, places): the spellings of a
    merged group with their sums and first places, the best of them as its
    name, and all places.
    """
    g = groups.withColumn("ord", F.col("variants")[0]["first_pos"])
    heads = merge_mention_groups(g.select("article_id", "key", "type", "count", "ord")).select("article_id", "key", "type", "head_key")
    m = g.join(heads, ["article_id", "key", "type"]).withColumn("key", F.col("head_key"))
    v = m.select("article_id", "key", "type", F.explode("variants").alias("v")).select("article_id", "key", "type", "v.*")
    v = v.groupBy("article_id", "key", "type", "name").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    named = v.groupBy("article_id", "key", "type").agg(display_rule().alias("name"), F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("first_pos", "name", "n"))).alias("variants"))
    places = m.groupBy("article_id", "key", "type").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    return named.join(places, ["article_id", "key", "type"])


def merge_stored_mentions(mentions: DataFrame, aliases: DataFrame, surnames: DataFrame) -> DataFrame:
    """Merge stored mentions by resolved key: one row per (article, key, type) with sums and fills.

    Columns as the input's plus old_name and merged, how many rows were merged
    into it.  The keeper is the row already named like the target, else the one
    with most mentions, else the first; the target's name is the last row's.
    What the keeper lacks is filled from the first other row that has it.
    """
    old = mentions.withColumn("old_name", F.col("name")).withColumn("old_type", F.col("type"))
    r = resolve_surnames(resolve_aliases(old, aliases), surnames).withColumn("_key", norm_key(F.col("name")))
    group = Window.partitionBy("article_id", "_key", "type")
    r = r.withColumn("_target", F.max_by("name", "id").over(group))
    exact = (F.col("old_name") == F.col("_target")) & (F.col("old_type") == F.col("type"))
    rank = F.struct(exact.cast("int").alias("e"), F.when(exact, 0).otherwise(F.col("mentions_count")).alias("n"), (-F.col("id")).alias("i"))
    other = (F.col("id") != F.max_by("id", rank).over(group)).cast("int")
    r = r.withColumn("_place", F.struct(other.alias("other"), "id"))
    told = lambda c, given: F.min_by(c, F.when(F.col(given).isNotNull(), F.col("_place")))
    score = F.when(F.count("sentiment_toward") > 0, told("sentiment_score", "sentiment_toward")).otherwise(F.max_by("sentiment_score", "_place"))
    out = r.groupBy("article_id", "_key", "type").agg(
        F.min_by("id", "_place").alias("id"), F.first("_target").alias("name"), F.min_by("old_name", "_place").alias("old_name"), F.sum("mentions_count").alias("mentions_count"),
        told("sentiment_toward", "sentiment_toward").alias("sentiment_toward"), score.alias("sentiment_score"), told("context", "context").alias("context"), F.count(F.lit(1)).alias("n"),
    )
    return out.select("id", "article_id", "name", "type", "old_name", "mentions_count", "sentiment_toward", "sentiment_score", "context", (F.col("n") - 1).alias("merged"))


def canonicalize(mentions: DataFrame, aliases: DataFrame, surnames: DataFrame) -> DataFrame:
    """Titles of persons, aliases, merge, surnames, merge: the full order of an analysis."""
    name = squeeze(F.col("name"))
    m = mentions.filter(F.trim("name") != "").withColumn("name", F.when(F.col("type") == "PERSON", strip_title(name)).otherwise(name))
    return merge_duplicates(resolve_surnames(merge_duplicates(resolve_aliases(m, aliases)), surnames))


def match_actors(actors: DataFrame, mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(article_id, actor, matched): an actor's entity in its article.

    Aliases first, then the first mention (most mentions, then name) whose key
    is or holds the actor's; without one the name stays, and blank is NULL.
    """
    a = actors.withColumn("_name", F.nullif(squeeze(F.col("actor")), F.lit("")))
    a = a.withColumn("_ak", norm_key(F.col("_name"))).join(_alias_rows(aliases), F.col("_ak") == F.col("alias_key"), "left")
    a = a.withColumn("_name", F.coalesce("canonical_name", "_name")).select("article_id", "actor", "_name").withColumn("_key", norm_key(F.col("_name")))
    m = mentions.select(F.col("article_id").alias("_article"), F.col("name").alias("_mention"), norm_key(F.col("name")).alias("_mkey"), "mentions_count")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    near = (F.col("article_id") == F.col("_article")) & F.contains(pad(F.col("_mkey")), pad(F.col("_key")))
    j = a.join(m, near, "left").groupBy("article_id", "actor", "_name").agg(F.min_by("_mention", F.struct((-F.col("mentions_count")).alias("n"), F.col("_mention").alias("m"))).alias("hit"))
    return j.select("article_id", "actor", F.coalesce("hit", "_name").alias("matched"))


def _each_actor(results: DataFrame, found: DataFrame, value: str, suffix: str = "") -> DataFrame:
    """Look every actor of results up in found (article_id, actor, value); at most one small map an article."""
    to = found.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("actor", value))).alias("_to"))
    out = results.join(to, "article_id", "left").withColumns({c + suffix: F.col("_to")[F.col(c)] for c in ACTORS})
    return out.drop("_to", *(ACTORS if suffix else ()))


def _actor_names(results: DataFrame) -> DataFrame:
    return results.select("article_id", F.explode(F.array(*ACTORS)).alias("actor")).filter("actor IS NOT NULL").distinct()


def canonicalize_result(results: DataFrame, mentions: DataFrame, aliases: DataFrame, surnames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, results) of whole analyses: canonical mentions, and the three actors of each article re-pointed to them.

    results has article_id, one row each, and the columns of ACTORS; others are kept.
    """
    entities = canonicalize(mentions, aliases, surnames)
    return entities, _each_actor(results, match_actors(_actor_names(results), entities, aliases), "matched")


def with_actor_ids(results: DataFrame, linked: DataFrame) -> DataFrame:
    """Replace the three actor names by dimension ids, NULL where an article has no mention of that name."""
    return _each_actor(results, resolve_actor_ids(_actor_names(results), linked), "canonical_entity_id", "_id")


def rectify_actor_ids(actors: DataFrame, linked: DataFrame, canonical: DataFrame) -> DataFrame:
    """(article_id, actor, canonical_entity_id) for names that people send: the link of the article's first mention whose own or dimension name has the same key."""
    names = canonical.select(F.col("id").alias("_of"), F.col("name").alias("_known"))
    # Mentions without a link are dealt by their own id; NULL would send them all to one task.
    m = linked.select("article_id", "id", "name", "canonical_entity_id", F.coalesce("canonical_entity_id", -F.col("id")).alias("_dealt"))
    m = m.join(names, (F.col("_dealt") == F.col("_of")) & (F.col("canonical_entity_id") == F.col("_of")), "left")
    keys = F.explode(F.array_distinct(F.array(norm_key(F.col("name")), norm_key(F.col("_known")))))
    first = m.select("article_id", "id", "canonical_entity_id", keys.alias("_key")).filter("_key IS NOT NULL").groupBy("article_id", "_key").agg(F.min_by(F.struct("canonical_entity_id"), "id").alias("to"))
    a = actors.select("article_id", "actor").withColumn("_key", F.when(F.col("actor") != "", norm_key(F.col("actor"))))
    return a.join(first, ["article_id", "_key"], "left").select("article_id", "actor", "to.canonical_entity_id")


def resolve_actor_ids(actors: DataFrame, linked: DataFrame) -> DataFrame:
    """(article_id, actor, canonical_entity_id) by exact name inside the article; linked has the mentions' ids."""
    m = linked.groupBy("article_id", F.col("name").alias("actor")).agg(F.min("canonical_entity_id").alias("canonical_entity_id"))
    return actors.select("article_id", "actor").join(m, ["article_id", "actor"], "left")


def seed_aliases(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Rows of a catalogue (ord, alias, canonical_name, type) whose key is not there yet; the first of a key wins."""
    keyed = seed.withColumn("alias_key", norm_key(F.col("alias")))
    new = keyed.join(existing.select("alias_key").distinct(), "alias_key", "left_anti")
    return new.withColumn("_r", F.row_number().over(Window.partitionBy("alias_key").orderBy("ord"))).filter("_r = 1").drop("_r")


def numbered(new: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """new, one row for each value of keys, with ids going on from the largest of stored."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # Ids without one sorted task: places inside 256 ranges of a hash, shifted by the sizes of the earlier ranges.
    slot = F.pmod(F.xxhash64(*keys), F.lit(256))
    new = new.withColumn("_slot", slot)
    sizes = new.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_slot", before.alias("shift")).crossJoin(F.broadcast(top))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(*keys))
    placed = new.withColumn("place", place).join(F.broadcast(shifts), "_slot")
    return placed.withColumn("id", (F.col("top") + F.col("shift") + F.col("place")).cast("long")).drop("_slot", "shift", "top", "place")


def new_canonical(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, name, type) of the names of mentions that the dimension lacks, ids going on from the largest."""
    new = mentions.select("name", "type").distinct().join(canonical.select("name", "type"), ["name", "type"], "left_anti")
    return numbered(new, canonical, "type", "name").select("id", "name", "type")


def upsert_canonical(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    """The dimension with the new (name, type) of mentions added."""
    return canonical.select("id", "name", "type").unionByName(new_canonical(mentions, canonical))


def link_mentions(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    return mentions.join(canonical.select(F.col("id").alias("canonical_entity_id"), "name", "type"), ["name", "type"], "left")


def unlink_actors(articles: DataFrame, gone: DataFrame) -> DataFrame:
    """Articles with the actor ids that are in gone (id) set to NULL, as they do not follow a merge."""
    ids = [f"{a}_id" for a in ACTORS]
    lost = articles.select("id", F.explode(F.array_distinct(F.array(*ids))).alias("_gone")).join(gone.select(F.col("id").alias("_gone")), "_gone", "left_semi")
    lost = lost.groupBy("id").agg(F.collect_set("_gone").alias("_lost"))
    out = articles.join(lost, "id", "left")
    return out.withColumns({c: F.when(~F.coalesce(F.array_contains("_lost", F.col(c)), F.lit(False)), F.col(c)) for c in ids}).drop("_lost")


def merge_canonical(linked: DataFrame, canonical: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, dimension, rejected) after merging source_id into target_id; pairs between types or unknown rows are rejected.

    Rows that left the dimension are also no actors any more: see unlink_actors.
    """
    kinds = canonical.select("id", "type")
    p = pairs.join(kinds.select(F.col("id").alias("source_id"), F.col("type").alias("st")), "source_id", "left").join(kinds.select(F.col("id").alias("target_id"), F.col("type").alias("tt")), "target_id", "left")
    reason = F.when(F.col("source_id") == F.col("target_id"), "self").when(F.col("st").isNull() | F.col("tt").isNull(), "missing").when(F.col("st") != F.col("tt"), "type")
    p = p.select("source_id", "target_id", reason.alias("reason"))
    good = p.filter("reason IS NULL").select("source_id", "target_id")
    moved = linked.join(good, linked["canonical_entity_id"] == good["source_id"], "left").withColumn("canonical_entity_id", F.coalesce("target_id", "canonical_entity_id")).drop("source_id", "target_id")
    return moved, canonical.join(good, canonical["id"] == good["source_id"], "left_anti"), p.filter("reason IS NOT NULL")


def acronym_of(key: Column, longer: Column) -> Column:
    """Whether a key of 2 to 6 letters spells the initials of a longer key."""
    return key.rlike(r"^\p{L}{2,6}$") & (key == initials(longer)) & (F.size(key_words(longer)) > 1)
