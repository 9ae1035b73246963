"""Literal cases of the operators over small tables."""

import json
import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkspan.operators import analyze, evaluate, filters, maintain, mentions, reports, resolve, sentiment, verify

MENTION = "article_id long, name string, type string, mentions_count long, sentiment_toward string, sentiment_score double, context string, extraction_confidence double"
ALIAS = "id long, alias string, alias_key string, canonical_name string, type string, is_active boolean"


def rows(spark, *names):
    """(name, kind, count[, sentiment, score, context]) of one article."""
    full = [(1, n[0], {"P": "PERSON", "O": "ORG"}[n[1]], *(list(n[2:]) + [1, None, None, None][len(n) - 2 :]), 1.0) for n in names]
    return spark.createDataFrame(full, MENTION)


@pytest.mark.parametrize(
    "given, expected",
    [
        ([("Abinader", "P", 5, "POS", 0.9, "corto"), ("Luis Abinader", "P", 2, "NEG", 0.5, "largo")], [("Luis Abinader", 7, "NEG", "largo")]),
        ([("Ministerio de Educación", "O", 2), ("Educación", "O", 1, "NEU", 0.6, "frase")], [("Ministerio de Educación", 3, "NEU", "frase")]),
        ([("Salud", "O"), ("Salud", "P")], [("Salud", 1, None, None)] * 2),
        ([("Luis Abinader", "P", 5), ("Luis Rodolfo Abinader Corona", "P", 1)], [("Luis Rodolfo Abinader Corona", 6, None, None)]),
        ([("Juan Pablo Duarte", "P"), ("Juan Pablo Pichardo", "P")], [("Juan Pablo Duarte", 1, None, None), ("Juan Pablo Pichardo", 1, None, None)]),
        ([("Luis Abinader", "P"), ("Luis Alberto Abinader", "P"), ("Luis Fernando Abinader", "P")], [("Luis Abinader", 1, None, None), ("Luis Alberto Abinader", 1, None, None), ("Luis Fernando Abinader", 1, None, None)]),
        ([("Banco Popular", "O"), ("Banco Popular Dominicano Multiple", "O")], [("Banco Popular Dominicano Multiple", 2, None, None)]),
    ],
)
def test_merge_duplicates(spark, given, expected):
    out = resolve.merge_duplicates(rows(spark, *given)).collect()
    assert sorted((r["name"], r["mentions_count"], r["sentiment_toward"] or "", r["context"] or "") for r in out) == sorted((a, b, c or "", d or "") for a, b, c, d in expected)


def test_canonicalize_and_surnames(spark):
    known = rows(spark, ("Luis Abinader", "P"), ("Leonel Fernández", "P"), ("Omar Fernández", "P"), ("Acme Corp", "O"))
    none = spark.createDataFrame([], ALIAS)
    surnames = resolve.person_map(known, known.limit(0), none)
    assert {r["surname"]: r["full_name"] for r in surnames.collect()} == {"abinader": "Luis Abinader"}
    out = resolve.canonicalize(rows(spark, ("Presidente Abinader", "P", 1), ("Luis Abinader", "P", 3), (" ", "P", 1)), none, surnames).collect()
    assert [(r["name"], r["mentions_count"]) for r in out] == [("Luis Abinader", 4)]
    assert resolve.resolve_surnames(rows(spark, ("Abinader", "P")), surnames).first()["name"] == "Luis Abinader"


def test_titles_leave_organisations_alone(spark):
    none, nobody = spark.createDataFrame([], ALIAS), spark.createDataFrame([], "surname string, full_name string")
    out = resolve.canonicalize(rows(spark, ("General Motors", "O", 2), ("General Pérez", "P", 1)), none, nobody).collect()
    assert {(r["name"], r["type"]) for r in out} == {("General Motors", "ORG"), ("Pérez", "PERSON")}


def test_stored_rows_fill_from_the_first_in_order(spark):
    none, nobody = spark.createDataFrame([], ALIAS), spark.createDataFrame([], "surname string, full_name string")
    schema = "id long, article_id long, name string, type string, mentions_count long, sentiment_toward string, sentiment_score double, context string"
    stored = [(1, 9, "ACME corp", "ORG", 1, "POS", 0.5, None), (2, 9, "Acme Corp", "ORG", 5, None, None, None), (3, 9, "acme corp", "ORG", 3, "NEG", 0.9, "last"), (4, 8, "Solo", "ORG", 1, None, 0.4, None)]
    out = {r["article_id"]: r for r in resolve.merge_stored_mentions(spark.createDataFrame(stored, schema), none, nobody).collect()}
    # The target's name is the last row's, which is there already, so that row stays; the first row in order fills.
    assert (out[9]["id"], out[9]["sentiment_toward"], out[9]["context"], out[9]["mentions_count"], out[9]["merged"]) == (3, "NEG", "last", 9, 2)
    renamed = [(k, 9, n, "ORG", c, s, x, None) for k, n, c, s, x in ((1, "ACME corp", 1, "POS", 0.5), (2, "Acme Corp", 5, None, None), (3, "acme corp", 3, "NEG", 0.9))]
    alias = spark.createDataFrame([(1, "acme corp", "acme corp", "Acme Corporation", "ORG", True)], ALIAS)
    r = resolve.merge_stored_mentions(spark.createDataFrame(renamed, schema), alias, nobody).first()
    assert (r["id"], r["name"], r["sentiment_toward"], r["sentiment_score"], r["mentions_count"]) == (2, "Acme Corporation", "POS", 0.5, 9)
    assert out[8]["sentiment_score"] == 0.4


@pytest.mark.parametrize("text, reason", [("Servicio saturado", "rate_limit"), ("LÍMITE DIARIO", "rate_limit"), ("rate exceeded", "rate_limit"), ("HTTP 429", "other"), ("Timed out", "timeout"), ("boom", "other")])
def test_fallback_reasons(spark, text, reason):
    assert [tuple(r) for r in verify.fallback_reasons(spark.createDataFrame([(text,), (None,)], "error string")).collect()] == [(reason, 1)]


def test_aliases_replace_name_and_type(spark):
    a = spark.createDataFrame([(1, "PLD", "pld", "Partido", "ORG", True), (2, "x", "x", "Y", "ORG", False)], ALIAS)
    out = resolve.resolve_aliases(rows(spark, ("P.L.D.", "P"), ("X", "P")), a).collect()
    assert sorted((r["name"], r["type"]) for r in out) == [("Partido", "ORG"), ("X", "PERSON")]


def test_acronyms_join(spark):
    g = spark.createDataFrame([(1, "fdd", "ORG", 2, 0), (1, "fundacion dominicana de desarrollo", "ORG", 1, 1), (1, "otra", "ORG", 1, 2)], "article_id long, key string, type string, count long, ord long")
    heads = {r["key"]: r["head_key"] for r in resolve.merge_mention_groups(g).collect()}
    assert heads["fdd"] == "fundacion dominicana de desarrollo" and heads["otra"] == "otra"


@pytest.mark.parametrize(
    "variants, best",
    [
        ([("PLD", 5), ("Partido de la Liberación Dominicana", 1)], "Partido de la Liberación Dominicana"),
        ([("Luis Abinader", 1), ("Rafael Abinader", 3)], "Rafael Abinader"),
        ([("Eduardo -Yayo- Sanz Lovatón", 1), ("Sanz Lovatón", 3)], "Sanz Lovatón"),
        ([("Jean-Claude Pérez-Gómez", 1), ("Pérez-Gómez", 3)], "Jean-Claude Pérez-Gómez"),
    ],
)
def test_display_name(spark, variants, best):
    v = spark.createDataFrame([(1, n, c, k) for k, (n, c) in enumerate(variants)], "g int, name string, n int, first_pos int")
    assert mentions.display_name(v, "g").first()["name"] == best


def test_verification(spark):
    articles = spark.createDataFrame([(1, "t", "La vicepresidenta Peña encabezó. Víctor\nAtallah habló de salud. La salud pública preocupa. Juan Paz: pazguatería")], "id long, title string, body string")
    e = rows(spark, ("Partido Revolucionario Moderno", "O"), ("Raquel Peña", "P"), ("Víctor Atallah", "P"), ("Juan Paz", "P", 9), ("Luis Rodolfo Abinader Corona", "P", 4), ("Ministerio de Salud Pública", "O", 1))
    kept = {r["name"]: r["extraction_confidence"] for r in verify.verify_entities(e, articles).collect()}
    assert kept == {"Raquel Peña": 0.6, "Víctor Atallah": 1.0, "Juan Paz": 1.0, "Ministerio de Salud Pública": 0.6}
    counted = {r["name"]: r["mentions_count"] for r in verify.recount_mentions(e, articles).collect()}
    assert (counted["Juan Paz"], counted["Luis Rodolfo Abinader Corona"], counted["Ministerio de Salud Pública"]) == (1, 4, 1)


def test_listing_filters(spark):
    at = lambda s: datetime.fromisoformat(s)
    data = [(1, True, at("2026-01-09 00:00"), "Sube 50% en ventas"), (2, False, at("2026-01-10 04:00"), "Sube 50X en ventas"), (3, None, at("2026-01-12 23:00"), "Matías"), (4, None, at("2026-01-13 03:59"), "x"), (5, None, at("2026-01-14 00:00"), "y")]
    a = spark.createDataFrame(data, "id long, has_hard_data boolean, published_at timestamp, title string").withColumn("main_topic", F.lit(None).cast("string")).withColumn("topic_keywords", F.lit(""))
    ids = lambda **f: sorted(r["id"] for r in filters.filter_articles(a, **f).collect())
    assert ids(has_hard_data=True) == [1] and ids(has_hard_data=False) == [2]
    assert ids(date_from="2026-01-10", date_to="2026-01-12") == [2, 3, 4]
    assert ids(q="50%") == [1] and ids(q="matias") == [3] and len(ids(date_from="nonsense")) == 5


def test_article_once_for_two_mentions(spark):
    a = spark.createDataFrame([(1, "s")], "id long, source string")
    m = spark.createDataFrame([(1, "Ana"), (1, "Ana B")], "article_id long, name string")
    assert filters.filter_articles(a, m, entity="ana").count() == 1


def test_canonical_counts(spark):
    c = spark.createDataFrame([(1, "A", "ORG"), (2, "B", "ORG")], "id long, name string, type string")
    m = spark.createDataFrame([(10, 1, 3), (11, 1, 2)], "article_id long, canonical_entity_id long, mentions_count long")
    out = {r["name"]: (r["article_count"], r["mention_count"]) for r in reports.canonical_counts(m, c).collect()}
    assert out == {"A": (2, 5), "B": (0, 0)}


def test_attribution_is_strict_and_cancels(spark):
    hits = spark.createDataFrame([(1, 0, 12, "NEG"), (1, 1, 5, "NEG"), (1, 1, 9, "POS"), (1, 2, 0, "NEG")], "article_id long, idx int, pos int, label string")
    m = spark.createDataFrame([(1, 0, 0, "perez"), (1, 0, 40, "otra"), (1, 1, 0, "ana"), (1, 2, 0, "late")], "article_id long, idx int, pos int, key string")
    out = {(r["idx"], r["key"]): r["label"] for r in sentiment.attribute_relations(hits, m).collect()}
    assert out == {(0, "perez"): "NEG", (1, "ana"): None}


def test_articles_without_sentences(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    s = spark.createDataFrame([(1, 0, "x", 0.1, 0.2, 0.7)], "article_id long, idx int, text string, p_neg double, p_neu double, p_pos double")
    assert {r["id"]: (r["label"], r["score"]) for r in sentiment.article_sentiment(a, s).collect()} == {1: ("POS", 0.7), 2: ("NEU", 0.0)}


def test_model_scorer(spark):
    import pandas as pd

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame({"p_neg": [0.1] * len(b), "p_neu": [0.2] * len(b), "p_pos": [0.7] * len(b)})

    s = spark.createDataFrame([(1, 0, "hola"), (2, 0, "hola")], "article_id long, idx int, text string")
    assert [r["p_pos"] for r in sentiment.score_sentences(s, sentiment.model_scores(scorer)).collect()] == [0.7, 0.7]


def test_published_rates(spark):
    c = spark.createDataFrame([(203, 48, 51), (83, 38, 48), (120, 10, 3), (0, 0, 7)], "tp long, fp long, fn long")
    out = [(r["precision"], r["recall"], r["f1"]) for r in evaluate.rates(c).orderBy(F.desc("fn"), "tp").collect()]
    assert out == [(0.8088, 0.7992, 0.804), (0.686, 0.6336, 0.6588), (None, 0.0, None), (0.9231, 0.9756, 0.9486)]


def test_matching_against_gold(spark):
    side = "article_id long, ord int, name string, type string, sentiment_toward string"
    pred = spark.createDataFrame([(1, 0, "Luis Abinader", "PERSON", "POS"), (1, 1, "Salud", "ORG", None), (2, 0, "Inventada", "ORG", None)], side)
    gold = spark.createDataFrame([(1, 0, "Abinader", "PERSON", "POS"), (1, 1, "Salud", "PERSON", None), (3, 0, "Sola", "ORG", None)], side)
    full = spark.createDataFrame([(1, True), (2, False)], "article_id long, entities_exhaustive boolean")
    m = {r["type"]: r for r in evaluate.entity_metrics(evaluate.match_predictions(pred, gold), full).collect()}
    assert (m[None]["tp"], m[None]["fp"], m[None]["fn"], m[None]["sentiment_correct"], m[None]["sentiment_total"]) == (1, 1, 2, 1, 1)


def test_jobs(spark):
    now = datetime(2026, 1, 1, 12)
    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    j = spark.createDataFrame(
        [("a", "u", "done", at(11, 30), None, "{}", None), ("b", "u", "done", at(11, 10), None, "{}", None), ("c", "v", "running", at(11, 55), None, None, None), ("d", "w", "running", at(11, 0), None, None, None), ("e", "x", "done", datetime(2025, 12, 1), None, "{}", None)],
        "id string, url string, status string, created_at timestamp, finished_at timestamp, result_json string, error string",
    )
    assert [r["id"] for r in maintain.reusable_jobs(j, F.lit(now)).collect()] == ["a"]
    assert maintain.reusable_jobs(j, F.lit(now), 0).count() == 0
    assert [r["id"] for r in maintain.inflight_jobs(j, F.lit(now)).collect()] == ["c"]
    swept = {r["id"]: r["status"] for r in maintain.sweep_jobs(j, F.lit(now)).collect()}
    assert swept == {"a": "done", "b": "done", "c": "running", "d": "failed"}
    req = spark.createDataFrame([("u",), ("v",), ("w",), ("z",)], "url string")
    out = {r["url"]: r["action"] for r in maintain.triage(req, spark.createDataFrame([("z",)], "url string"), j, F.lit(now)).collect()}
    assert out == {"u": "reuse", "v": "join", "w": "enqueue", "z": "saved"}


def test_quota_equals_sequential_rule(spark):
    a = spark.createDataFrame([(k, "ab"[k % 3 == 0], datetime(2026, 1, 1, 0, k)) for k in range(20)], "id long, source string, published_at timestamp")
    got = [r["id"] for r in reports.quota_sample(a, 8, 4).collect()]
    taken, n = [], {}
    for k in range(20):
        s = "ab"[k % 3 == 0]
        if n.get(s, 0) < 4 and len(taken) < 8:
            n[s] = n.get(s, 0) + 1
            taken.append(k)
    assert sorted(got) == taken


def test_actors_follow_their_entities(spark):
    found = rows(spark, ("Luis Abinader", "P", 1), ("Abinader", "P", 4), ("General Motors", "O", 2))
    named = spark.createDataFrame([(1, "Abinader", " ", None, "kept"), (2, "Otro", None, None, "kept")], "article_id long, dominant_actor string, blamed_actor string, credited_actor string, framing string")
    nobody = spark.createDataFrame([], "surname string, full_name string")
    entities, out = resolve.canonicalize_result(named, found, spark.createDataFrame([], ALIAS), nobody)
    assert sorted((r["name"], r["mentions_count"]) for r in entities.collect()) == [("General Motors", 2), ("Luis Abinader", 5)]
    assert sorted((r["article_id"], r["dominant_actor"], r["blamed_actor"], r["credited_actor"], r["framing"]) for r in out.collect()) == [(1, "Luis Abinader", None, None, "kept"), (2, "Otro", None, None, "kept")]
    linked = spark.createDataFrame([(1, "Luis Abinader", 7), (1, "General Motors", 8)], "article_id long, name string, canonical_entity_id long")
    assert {r["article_id"]: r["dominant_actor_id"] for r in resolve.with_actor_ids(out, linked).collect()} == {1: 7, 2: None}


def test_rectified_actors(spark):
    linked = spark.createDataFrame([(1, 10, "MINERD", 7), (1, 11, "Ana Paz", 8), (1, 12, "ana paz", 9), (1, 13, "Sin Enlace", None)], "article_id long, id long, name string, canonical_entity_id long")
    known = spark.createDataFrame([(7, "Ministerio de Educación", "ORG"), (8, "Ana Paz", "PERSON"), (9, "ana paz", "PERSON")], "id long, name string, type string")
    typed = spark.createDataFrame([(1, "ministerio de educacion"), (1, "Minerd"), (1, "ANA  PAZ"), (1, "Sin enlace"), (1, "Nadie"), (2, "Minerd"), (1, ""), (1, None)], "article_id long, actor string")
    out = {(r["article_id"], r["actor"]): r["canonical_entity_id"] for r in resolve.rectify_actor_ids(typed, linked, known).collect()}
    assert out == {(1, "ministerio de educacion"): 7, (1, "Minerd"): 7, (1, "ANA  PAZ"): 8, (1, "Sin enlace"): None, (1, "Nadie"): None, (2, "Minerd"): None, (1, ""): None, (1, None): None}


def test_merged_rows_are_no_actors(spark):
    a = spark.createDataFrame([(1, 5, 6, 5), (2, 6, None, None)], "id long, dominant_actor_id long, blamed_actor_id long, credited_actor_id long")
    out = sorted(tuple(r) for r in resolve.unlink_actors(a, spark.createDataFrame([(5,)], "id long")).collect())
    assert out == [(1, None, 6, None), (2, 6, None, None)]


def test_sweep_counts_and_stage(spark):
    now, at = datetime(2026, 1, 3), lambda d, h, m=0: datetime(2026, 1, d, h, m)
    j = spark.createDataFrame([("a", "running", "fetch", at(2, 23, 45), None), ("b", "running", "fetch", at(2, 23, 46), None), ("c", "pending", None, at(1, 0), None), ("d", "done", None, at(1, 0, 1), None), ("e", "failed", None, at(1, 0), None)], "id string, status string, stage string, created_at timestamp, error string")
    out = {r["id"]: (r["status"], r["stage"]) for r in maintain.sweep_jobs(j, F.lit(now)).collect()}
    assert out == {"a": ("failed", None), "b": ("running", "fetch"), "d": ("done", None)}
    assert tuple(maintain.sweep_counts(j, F.lit(now)).first()) == (2, 2)
    assert maintain.sweep_jobs(j, F.lit(now), keep_hours=0).count() == 5


def test_run_status(spark):
    e = spark.createDataFrame([("a", "saved"), ("a", "cancelled"), ("b", "broken"), ("c", "failed")], "source string, k string")
    is_ = lambda k: F.col("k") == k
    got = lambda df: {r["source"]: r["status"] for r in maintain.run_totals(df, is_("discovered"), is_("saved"), is_("failed"), is_("cancelled"), is_("broken")).collect()}
    assert got(e) == {"a": "cancelled", "b": "failed", "c": "success", None: "cancelled"}
    assert got(e.union(spark.createDataFrame([(None, "broken")], e.schema)))[None] == "failed"


def test_alias_patches(spark):
    a = spark.createDataFrame([(1, "PLD", "pld", "Partido", "ORG", True), (2, "PRM", "prm", "Otro", "ORG", True)], ALIAS)
    p = spark.createDataFrame([(1, " P.R.D. ", None, None, None), (2, None, " Nuevo ", None, False), (3, "x", None, None, None)], "id long, alias string, canonical_name string, type string, is_active boolean")
    out, rejected = maintain.patch_aliases(a, p)
    assert sorted(tuple(r) for r in out.select("id", "alias", "alias_key", "canonical_name", "is_active").collect()) == [(1, "P.R.D.", "prd", "Partido", True), (2, "PRM", "prm", "Nuevo", False)]
    assert [tuple(r) for r in rejected.collect()] == [(3, "missing")]
    assert [tuple(r) for r in maintain.patch_aliases(a, p.filter("id = 1").withColumn("alias", F.lit("prm")))[1].collect()] == [(1, "clash")]


def test_orphans_of_every_reference(spark):
    a = spark.createDataFrame([(1, "u", 5, 9, None)], "id long, url string, dominant_actor_id long, blamed_actor_id long, credited_actor_id long")
    m = spark.createDataFrame([(1, "A", "ORG", 5), (2, "A", "ORG", 8), (1, "B", "ORG", None)], "article_id long, name string, type string, canonical_entity_id long")
    c = spark.createDataFrame([(5, "A", "ORG")], "id long, name string, type string")
    out = {r["rule"]: r["n"] for r in filters.audit_constraints(a, m, c, spark.createDataFrame([], ALIAS)).collect()}
    assert {k: v for k, v in out.items() if v} == {"orphan_mention": 1, "orphan_link": 1, "orphan_blamed_actor": 1} and len(out) == 9


def test_default_topic(spark):
    a = spark.createDataFrame([("http://a/x/1", "El Senado vota", ""), ("http://a/deportes/1", "El Senado vota", ""), ("http://a/x/2", "Feria", "el alcalde y el alcalde"), ("http://a/x/3", "Feria", "el alcalde y la JCE")], "url string, title string, body string")
    assert [r[0] for r in a.select(filters.is_topic(F.col("url"), F.col("title"), F.col("body"))).collect()] == [True, False, False, True]


def test_an_article_that_fails_alone(spark):
    def one(title, body):
        if "bad" in body:
            raise RuntimeError("no")
        return {"overall_sentiment": "POS", "has_hard_data": "x" if "odd" in body else True, "entities": [{"name": title, "type": "ORG", "mentions_count": 1}]}

    a = spark.createDataFrame([(1, "t", "good"), (2, "t", "bad"), (3, "t", None), (4, "t", "odd")], "id long, title string, body string").coalesce(1)
    for many in (None, lambda texts: [one(*x) for x in texts]):
        out = {r["id"]: r for r in analyze.analyze_articles(a, analyze.analysis(one, many), "n", "m", "v").collect()}
        assert [k for k, r in out.items() if r["analysis_error"]] == [2, 4] and out[2]["analysis_error"] == "RuntimeError: no" and out[2]["analyzer_name"] is None
        assert out[3]["result"]["entities"][0]["name"] == "t" and out[1]["analysis_schema_version"] == 2 and out[1]["analyzed_at"]


def test_evaluation_report(spark):
    fields = "article_id long, overall_sentiment string, framing string, sentiment_basis string, facts_sentiment string, quoted_sentiment string, media_stance string, content_flags array<string>"
    gold = spark.createDataFrame([(1, "POS", "denuncia", None, None, None, None, ["a"], True), (2, "NEG", None, None, None, None, None, None, False)], fields + ", entities_exhaustive boolean")
    pred = spark.createDataFrame([(1, "POS", "?", None, None, None, None, ["a", "b"])], fields)
    side = "article_id long, ord int, name string, type string, sentiment_toward string"
    ents = spark.createDataFrame([(1, 0, "Ana", "PERSON", "POS"), (2, 1, "Eva", "PERSON", None)], side)
    report, each = evaluate.evaluate(pred, gold, ents, ents.filter("article_id = 1"))
    r = json.loads(evaluate.report_json(report).first()["report"])
    assert (r["n_articles"], r["overall_sentiment"]["accuracy"], r["overall_sentiment"]["confusion_matrix"]["NEG->NEU"]) == (2, 0.5, 1)
    assert r["category_matrices"]["framing"] == {"accuracy": 0.0, "n_labeled": 1, "confusion_matrix": r["category_matrices"]["framing"]["confusion_matrix"]}
    assert r["category_matrices"]["framing"]["confusion_matrix"]["denuncia->neutro_informativo"] == 1 and r["category_matrices"]["media_stance"]["n_labeled"] == 0
    assert (r["entities"]["overall"]["tp"], r["entities"]["overall"]["fp"], r["entities"]["by_type"]["PERSON"]["f1"]) == (1, 0, 1.0)
    assert (r["content_flags"]["tp"], r["content_flags"]["fp"]) == (1, 1)
    assert sorted((x["article_id"], x["entity_pairs"]) for x in each.collect()) == [(1, 1), (2, 1)]


def _in_turn(rows, patches, unique):
    """Patches one after the other: (rows, rejected identifiers)."""
    rows, rejected = {r["id"]: dict(r) for r in rows}, []
    for p in sorted(patches, key=lambda p: (p["seq"], p["id"])):
        if p["id"] not in rows:
            rejected.append((p["id"], "missing"))
            continue
        to = rows[p["id"]] | {f: v for f, v in p["set"].items()}
        key = [to[u] for u in unique]
        if key != [rows[p["id"]][u] for u in unique] and any(key == [r[u] for u in unique] for i, r in rows.items() if i != p["id"]):
            rejected.append((p["id"], "clash"))
        else:
            rows[p["id"]] = to
    return sorted(tuple(r.values()) for r in rows.values()), sorted(rejected)


def _patch_rows(spark, patches, fields):
    kind = {"k": "string", "t": "string", "v": "long"}
    schema = "id long, seq long, " + ", ".join(f"{f} {kind[f]}, set_{f} boolean" for f in fields)
    return spark.createDataFrame([(p["id"], p["seq"], *[x for f in fields for x in (p["set"].get(f), f in p["set"])]) for p in patches], schema)


PATCH_CASES = {
    "a later patch leaves the key": [(1, {"k": "k3"}), (2, {"k": "k1"})],
    "swap": [(1, {"k": "k2"}), (2, {"k": "k1"})],
    "chain from its end": [(3, {"k": "z"}), (2, {"k": "k3"}), (1, {"k": "k2"}), (4, {"k": "k1"})],
    "chain from its start": [(1, {"k": "k2"}), (2, {"k": "k3"}), (3, {"k": "z"})],
    "many want one": [(1, {"k": "z"}), (2, {"k": "z"}), (3, {"k": "z", "v": 9}), (4, {"v": 7})],
    "two to a row": [(1, {"k": "z"}), (1, {"k": "k2"}), (2, {"k": "k1"}), (1, {"k": "k1"}), (1, {"k": "k1"})],
    "away and back": [(1, {"k": "z"}), (2, {"k": "k1"}), (2, {"k": "k2"}), (1, {"k": "k1"})],
    "missing and null": [(9, {"k": "z"}), (1, {"k": None}), (2, {"k": None}), (3, {"k": "k1", "v": None})],
    "part of the key": [(1, {"t": "B"}), (1, {"k": "k2"}), (2, {"t": "B"}), (3, {"t": "A", "k": "k1"})],
}


@pytest.mark.parametrize("case", PATCH_CASES)
def test_patches_in_turn(spark, case):
    rows = [{"id": i, "k": f"k{i}", "t": "A", "v": i} for i in range(1, 5)]
    patches = [{"id": i, "seq": n, "set": s} for n, (i, s) in enumerate(PATCH_CASES[case])]
    kept, rejected = maintain.apply_patches(spark.createDataFrame([tuple(r.values()) for r in rows], "id long, k string, t string, v long"), _patch_rows(spark, patches, ["k", "t", "v"]), ["k", "t", "v"], ["k", "t"], "seq")
    got = sorted(map(tuple, kept.collect()), key=lambda r: r[0])
    want, bad = _in_turn(rows, patches, ["k", "t"])
    assert got == sorted(want, key=lambda r: r[0]) and sorted(map(tuple, rejected.collect())) == bad
    assert len({r[1:3] for r in got}) == 4


def test_random_patches_in_turn(spark):
    rng = random.Random(6)
    rows = [{"id": i, "k": f"k{i}", "t": "AB"[i % 2], "v": i} for i in range(40)]
    choices = [{"k": f"k{rng.randrange(50)}"} | ({"t": rng.choice("AB")} if rng.random() < 0.4 else {}) if rng.random() < 0.8 else {"t": rng.choice("AB")} for _ in range(60)]
    patches = [{"id": rng.randrange(42), "seq": n, "set": s} for n, s in enumerate(choices)]
    kept, rejected = maintain.apply_patches(spark.createDataFrame([tuple(r.values()) for r in rows], "id long, k string, t string, v long"), _patch_rows(spark, patches, ["k", "t"]), ["k", "t"], ["k", "t"], "seq")
    want, bad = _in_turn(rows, patches, ["k", "t"])
    assert sorted(map(tuple, kept.collect())) == want and sorted(map(tuple, rejected.collect())) == bad and {"clash", "missing"} == {b[1] for b in bad}


def test_dictionary_mentions_both_ways(spark):
    """The automaton and the join give the same: overlapping runs, one key for two names, a key over the bound, an empty one, repeated rows."""
    texts = ["El Banco Central de Lima, y el banco central.", "", "Lima Lima LIMA-Lima", "Ana", "banco  central  de lima norte", "x.y é ñ Ana María de Ruiz", None]
    s = spark.createDataFrame([(k // 2, k % 2, t) for k, t in enumerate(texts)], "article_id long, idx int, text string")
    entries = [("banco central", "BC", "ORG"), ("banco", "Banco", "ORG"), ("central de lima", "CL", "ORG"), ("lima", "Lima", "ORG"), ("lima", "Lima Vega", "PERSON"), ("banco central de lima", "no", "ORG"), ("", "no", "ORG"), ("ana", "Ana", "PERSON"), ("ana", "Ana", "PERSON"), ("lima lima", "LL", "ORG"), ("y el", "Y", "ORG")]
    c = spark.createDataFrame(entries, "alias_key string, canonical_name string, type string")
    one, two = (sorted(map(tuple, mentions.dictionary_mentions(s, c, **more).collect())) for more in ({}, {"most_rows": 0}))
    brute = []
    for k, t in enumerate(texts):
        words = {0: "el banco central de lima y el banco central", 2: "lima lima lima lima", 3: "ana", 4: "banco central de lima norte", 5: "xy e n ana maria de ruiz"}.get(k, "").split()
        brute += [(k // 2, k % 2, i + 1, name, kind) for i in range(len(words)) for n in (1, 2, 3) for key, name, kind in entries if i + n <= len(words) and " ".join(words[i : i + n]) == key]
    assert one == two == sorted(brute) and len(one) > 15
    assert mentions.dictionary_mentions(s, c.limit(0)).count() == 0


def test_keys_of_any_number_of_words_are_found(spark):
    """Without a bound on words both ways find every key, one of 30 words and one in a text of many slices among them."""
    many = " ".join(f"n{k}" for k in range(30))
    texts = ["banco central de la lima", f"y {many} {many}", "ana", "z " * 3_000_000 + "a b c d e", "a b c d", "", None]
    s = spark.createDataFrame(list(enumerate(texts)), "article_id long, text string").withColumn("idx", F.lit(0)).coalesce(1)
    c = spark.createDataFrame([(k, k[:9], "ORG") for k in ("banco central de la lima", "central", many, "a b c d", "b c d e", "ana", "no hay de todo eso")], "alias_key string, canonical_name string, type string")
    want = [(0, 0, 1, "banco cen", "ORG"), (0, 0, 2, "central", "ORG"), (1, 0, 2, many[:9], "ORG"), (1, 0, 32, many[:9], "ORG"), (2, 0, 1, "ana", "ORG"), (3, 0, 3_000_001, "a b c d", "ORG"), (3, 0, 3_000_002, "b c d e", "ORG"), (4, 0, 1, "a b c d", "ORG")]
    for most_rows in (200_000, 0):
        assert sorted(map(tuple, mentions.dictionary_mentions(s, c, most_words=None, most_rows=most_rows).collect())) == want


def test_scores_are_kept(spark, tmp_path):
    """A second run scores only what the store lacks, and the moves by lexicon and denial are the same."""
    asked = []

    def score(distinct):
        asked.append(sorted(r["text"] for r in distinct.collect()))
        n = F.length("text") / 100
        return distinct.select("text", n.alias("p_neg"), (n / 2).alias("p_neu"), (1 - 1.5 * n).alias("p_pos"))

    make = lambda *texts: spark.createDataFrame([(k // 2, k % 2, t) for k, t in enumerate(texts)], "article_id long, idx int, text string")
    one, two = make("hoy no", "crisis", "hoy no", "gol"), make("gol", "crisis", "nuevo", "")
    for s in (one, two):
        kept = sentiment.score_sentences(s, sentiment.kept_scores(score, sentiment.score_store(spark, str(tmp_path / "scores")), "r"))
        got = sorted(map(tuple, kept.collect()))
        n = len(asked)
        assert got == sorted(map(tuple, sentiment.score_sentences(s, score).collect())) and len(got) == 4
        del asked[n:]
    assert asked == [["crisis", "gol", "hoy no"], ["", "nuevo"]]


@pytest.mark.parametrize("text", ["ana ruiz y ana ruiz, ana; ruiz ana", "a a a a", "la ana-maria de ana.maria x", "", "e\u0301 e ²x x² x", "it's it s", "a.b a.b.c .b a .b"])
def test_index_of_a_text_counts_as_patterns_do(text):
    import regex

    index = verify.TextIndex(text)
    for phrase in ("ana", "ana ruiz", "ruiz", "a a", "a", "ana-maria", "de ana.maria", "", "e", "e\u0301", "x", "²x", "it's", ".b", "a.b", "s", "b."):
        want = len(regex.findall(rf"(?<!\w){regex.escape(phrase)}(?!\w)", text)) if phrase else 0
        assert index.count(phrase) == want, phrase


def test_whole_results(spark):
    articles = spark.createDataFrame([(1, "Ana Ruiz", "Ana Ruiz y ACME. ACME gana; ACME."), (2, "t", "b"), (3, "t", "b")], "id long, title string, body string")
    whole = {"main_topic": "  ", "topic_keywords": [" x ", " "], "overall_sentiment": "positivo", "dominant_actor": " Ana Ruiz ", "has_hard_data": True, "content_flags": ["b", "a", "b"], "media_stance": "critica",
             "entities": [{"name": "Ana Ruiz", "type": "PERSON", "mentions_count": 9, "confidence": 1.0}, {"name": "Nadie Más", "type": "PERSON", "mentions_count": 5}, {"name": "ACME", "type": "ORG", "mentions_count": 1}]}
    results = spark.createDataFrame([(1, json.dumps(whole)), (2, "{\"main_topic\": \"x"), (3, "{}")], "article_id long, result_json string")
    out = {r["article_id"]: r for r in verify.whole_results(results, articles).collect()}
    assert sorted(out) == [1, 3] and [r["article_id"] for r in verify.broken_results(results).collect()] == [2]
    r = out[1]
    assert (r["main_topic"], r["topic_keywords"], r["overall_sentiment"], r["dominant_actor"], r["has_hard_data"], r["content_flags"], r["media_stance"], r["facts_sentiment"]) == (None, ["x"], "POS", "Ana Ruiz", True, ["b", "a"], "critica", "NEU")
    assert [(e["name"], e["mentions_count"]) for e in r["entities"]] == [("ACME", 3), ("Ana Ruiz", 2)] and out[3]["entities"] == []


def _groups_of_all(rows, by_initials):
    """The same as assign_groups, every row against every head."""
    particles = set(resolve.PARTICLES)
    order = sorted(range(len(rows)), key=lambda i: (-len(rows[i][0]), -rows[i][2]))
    heads, out = [], [None] * len(rows)
    for i in order:
        key, kind, _ = rows[i]
        if not key:
            continue
        mine, peers = set(key.split()) - particles, [h for h in heads if rows[h][1] == kind]
        short = by_initials and key.isalpha() and 2 <= len(key) <= 6
        same = [h for h in peers if rows[h][0] == key]
        inside = [h for h in peers if f" {key} " in f" {rows[h][0]} " or (short and key == "".join(w[0] for w in rows[h][0].split() if w not in particles))]
        wider = [h for h in peers if mine < set(rows[h][0].split()) - particles] if kind == "PERSON" and len(mine) > 1 and not by_initials else []
        to = same[0] if same else inside[0] if inside else wider[0] if len(wider) == 1 else i
        out[i] = to
        if to == i:
            heads.append(i)
    return out


@pytest.mark.parametrize("by_initials", [False, True])
def test_groups_by_word_equal_groups_of_all(by_initials):
    rng = random.Random(7)
    for _ in range(60):
        rows = [(" ".join(rng.choice(["ana", "ruiz", "de", "la", "sol", "p", "ar", "paz", "luis", "as"]) for _ in range(rng.randrange(5))), rng.choice(["PERSON", "ORG"]), rng.randrange(4)) for _ in range(60)]
        assert resolve.assign_groups(rows, by_initials) == _groups_of_all(rows, by_initials)


def test_very_many_mentions_in_one_article():
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(30_000)} de x{rng.randrange(3_000)}" if k % 3 else f"x{rng.randrange(3_000)}", "PERSON", k % 5) for k in range(100_000)]
    began = time.process_time()
    heads = resolve.assign_groups(rows)
    assert time.process_time() - began < 20 and sum(h != k for k, h in enumerate(heads)) > 30_000


def test_groups_are_merged_whole(spark):
    raw = spark.createDataFrame([(1, n, "ORG", p) for p, n in enumerate(["FDD", "Fundación Dominicana de Desarrollo", "fdd", "FDD", "Fundacion Dominicana de Desarrollo", "Otra"])], "article_id long, name string, type string, pos int")
    got = sorted((r["key"], r["name"], r["count"], r["places"], [(v["name"], v["n"]) for v in r["variants"]]) for r in resolve.merge_groups(mentions.group_mentions(raw)).collect())
    assert got == [
        ("fundacion dominicana de desarrollo", "Fundación Dominicana de Desarrollo", 5, [0, 1, 2, 3, 4], [("FDD", 2), ("Fundación Dominicana de Desarrollo", 1), ("fdd", 1), ("Fundacion Dominicana de Desarrollo", 1)]), ("otra", "Otra", 1, [5], [("Otra", 1)])
    ]


def test_words_and_phrases_are_counted_in_their_article(spark):
    """Keywords and topics as counted by hand, without a shuffle of words."""
    texts = {1: "Alfa beta alfa, beta Alfa gama. Gama alfa beta", 2: "uno", 3: "", 4: None, 5: "Ñandú ñandu Ñandú ñandu", 6: "delta casa rosa casa rosa delta", 7: "casa casa casa"}
    a = spark.createDataFrame(list(texts.items()), "id long, body string")
    k = mentions.keywords(a, ["gama"], k=2)
    assert sorted(map(tuple, k.collect())) == [(1, "alfa", 4, 1), (1, "beta", 3, 2), (5, "nandu", 4, 1), (6, "casa", 2, 2), (6, "delta", 2, 1), (7, "casa", 3, 1)]
    assert "Exchange" not in k._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, mentions.main_topic(a, k).collect())) == {1: "alfa beta", 5: "nandu nandu", 6: "delta", 7: "casa casa"}
    assert mentions.held_phrase("b a b a b a".split(), "a") == "b a" and mentions.held_phrase("a a a".split(), "a") == "a a" and mentions.held_phrase("x a y".split(), "a") is None
    assert "Generate" not in mentions.main_topic(a, k)._jdf.queryExecution().optimizedPlan().toString()


def test_unlinked_mentions_are_dealt_over_tasks(spark):
    """Mentions without a dimension row do not all meet in one task of the rectifying join."""
    linked = spark.range(4000).select(F.col("id"), (F.col("id") % 50).alias("article_id"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") < 40, F.col("id")).alias("canonical_entity_id"))
    canonical = spark.range(0, 60).select("id", F.concat(F.lit("known "), "id").alias("name"), F.lit("ORG").alias("type"))
    actors = spark.createDataFrame([(0, "n50"), (1, "known 1"), (2, "n2"), (3, "known 53")], "article_id long, actor string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = resolve.rectify_actor_ids(actors, linked, canonical)
        assert sorted(map(tuple, out.collect())) == [(0, "n50", None), (1, "known 1", 1), (2, "n2", 2), (3, "known 53", None)]
        assert re.search(r"hashpartitioning\([^)]*_dealt", out._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_large_catalogue_meets_likely_runs_only(spark):
    """Runs that are no key are left out where they are read, not exploded and shuffled."""
    s = spark.createDataFrame([(k, 0, f"uno dos{k} tres cuatro{k} Lima") for k in range(300)], "article_id long, idx int, text string")
    c = spark.createDataFrame([("lima", "Lima", "ORG"), ("tres cuatro7 lima", "T", "ORG")], "alias_key string, canonical_name string, type string")
    out = mentions.dictionary_mentions(s, c, most_rows=0)
    assert out.count() == 301 and out.filter("name = 'T'").select("article_id", "word_pos").first() == (7, 3)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_labels_do_not_hang_on_the_order_of_sums(spark):
    """Shares that are equal but for the order in which they are added are a tie."""
    rows = [(1, 0.3, 0.0, 0.1), (1, 0.2, 0.0, 0.2), (1, 0.1, 0.0, 0.3), (2, 0.375, 0.0, 0.0), (2, 0.3, 0.0, 0.0), (2, 0.3, 0.0, 0.0), (2, 0.3, 0.0, 0.0)]
    s = spark.createDataFrame([(*r, "t") for r in rows], "article_id long, p_neg double, p_neu double, p_pos double, text string").coalesce(1)
    a = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, sentiment.article_sentiment(a, s).collect())) == [(1, "NEG", 0.2), (2, "NEG", 0.3188)]
