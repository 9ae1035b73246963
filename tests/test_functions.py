"""Literal cases of the Column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkspan.functions import dates, lexicon, text, urls


def one(spark, f, *values):
    schema = ", ".join(f"c{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in enumerate(values))
    df = spark.createDataFrame([values], schema)
    return df.select(f(*[F.col(c) for c in df.columns]).alias("out")).first()[0]


@pytest.mark.parametrize("name, key", [("P.R.M.", "prm"), ("Jean-Claude", "jean claude"), ("  Luis   Abinader ", "luis abinader"), ("Muñoz Ñame", "munoz name"), ("", "")])
def test_norm_key(spark, name, key):
    assert one(spark, text.norm_key, name) == key


def test_fold_keeps_places(spark):
    assert one(spark, text.fold, "Ámbito ÑANDÚ İx") == "ambito nandu ix"


@pytest.mark.parametrize("name, out", [("Presidente Abinader", "Abinader"), ("Monseñor Juan Pérez", "Juan Pérez"), ("Presidente", "Presidente"), ("Ana Ruiz", "Ana Ruiz")])
def test_strip_title(spark, name, out):
    assert one(spark, text.strip_title, name) == out


@pytest.mark.parametrize("name, spliced", [("Eduardo -Yayo- Sanz Lovatón", True), ("Jean-Claude Pérez-Gómez", False), ('Juan "Manguera" Pérez', True), ('"Manguera" Pérez', False), ("Danilo (el Rubio) Medina", True)])
def test_nickname(spark, name, spliced):
    assert one(spark, text.has_nickname, name) is spliced


@pytest.mark.parametrize("a, b, same", [("Jean-Claude", "Jean Claude", True), ("PRM", "P.R.M. nacional", True), ("Salud", "Saludo", False), ("", "x", False)])
def test_names_match(spark, a, b, same):
    assert one(spark, text.names_match, a, b) is same


def test_count_phrase(spark):
    assert one(spark, text.count_phrase, "juan paz hablo de la pazguateria", "paz") == 1
    assert one(spark, text.count_phrase, "a.b a.b", "a.b") == 2
    assert one(spark, text.count_phrase, r"x \E y", r"\E") == 1
    assert one(spark, text.count_phrase, "x", "") == 0


@pytest.mark.parametrize("name, kind, n, out", [("Luis Abinader", "PERSON", 5, 1.0), ("Luis Abinader", "PERSON", 1, 0.85), ("Abinader", "PERSON", 1, 0.75), ("MINERD", "ORG", 5, 1.0)])
def test_confidence(spark, name, kind, n, out):
    assert one(spark, text.extraction_confidence, name, kind, n) == out


BASE = "https://listindiario.com/politica/20260807/nota-de-prueba"


@pytest.mark.parametrize("url", [BASE + "/", BASE + "#comentarios", BASE + "?utm_source=whatsapp&utm_medium=social", BASE + "?fbclid=IwAR123", BASE + "/?utm_campaign=x#top", BASE.replace("listin", "LISTIN").replace("https", "HTTPS"), "https://u:p@listindiario.com:443" + BASE[len("https://listindiario.com") :]])
def test_same_address(spark, url):
    assert one(spark, urls.canonical_url, url) == BASE


def test_canonical_url(spark):
    same = lambda a, b: one(spark, urls.canonical_url, a) == one(spark, urls.canonical_url, b)
    assert not same(BASE + "?id=1", BASE + "?id=2")
    assert not same(BASE, BASE.replace("nota", "Nota"))
    assert same(BASE + "?b=2&a=1", BASE + "?a=1&b=2")
    assert one(spark, urls.canonical_url, "http://x.com") == "http://x.com/"
    assert one(spark, urls.canonical_url, "http://x.com:8080/a?q=a+b%2A~&e=") == "http://x.com:8080/a?e=&q=a+b%2A~"
    assert one(spark, urls.url_section, "https://x.com/El-Deporte/a") == "el-deporte"
    assert one(spark, urls.url_section, "https://x.com/") is None


@pytest.mark.parametrize(
    "url, why",
    [("https://sub.diario.com/a", None), ("ftp://diario.com", "scheme"), ("https://diario.com@evil.com/", "credentials"), ("https://diario.com:8080/", "port"), ("https://otrodiario.com/", "domain"), ("https://" + "x" * 3000, "too_long"), ("https:///a", "no_host"), ("https://DIARIO.com:443/", None)],
)
def test_url_policy(spark, url, why):
    assert one(spark, lambda c: urls.url_reject(c, ["diario.com"]), url) == why


@pytest.mark.parametrize(
    "written, utc",
    [("", None), ("not a date", None), ("2026/01/15 10:30:00", None), ("2026-01-15T10:30:00-04:00", "2026-01-15 14:30"), ("2026-01-15T10:30:00Z", "2026-01-15 10:30"), ("2026-01-15", "2026-01-15 04:00"), ("15/01/2026", "2026-01-15 04:00"), ("2026-01-15 10:30:00", "2026-01-15 14:30")],
)
def test_parse_date(spark, written, utc):
    got = one(spark, dates.parse_date, written)
    assert got == (utc and datetime.fromisoformat(utc))


def test_short_date(spark):
    assert one(spark, lambda c: dates.short_date(c.cast("timestamp")), "2026-07-27 10:00:00") == "27 jul 26"
    assert one(spark, lambda c: dates.short_date(F.lit(None).cast("timestamp")), "x") == "—"


@pytest.mark.parametrize(
    "sentence, label, relation",
    [("El funcionario fue acusado de corrupción.", "NEG", "NEG"), ("Las partes alcanzaron un consenso histórico.", "POS", None), ("Tras el escándalo de corrupción, el gobierno prometió transparencia.", None, None), ("Un sistema corruptible en teoría", None, None), ("La alcaldesa fue reconocida por su gestión.", None, "POS")],
)
def test_labels(spark, sentence, label, relation):
    assert one(spark, lexicon.lexicon_label, sentence) == label
    assert one(spark, lexicon.relation_label, sentence) == relation


def test_relation_hits_and_terms(spark):
    s = "El diputado, acusado de corrupción, fue reconocido por su labor previa."
    hits = one(spark, lexicon.relation_hits, s)
    assert [(h["pos"], h["label"]) for h in hits] == [(s.index("acusado"), "NEG"), (s.index("reconocido"), "POS")]
    found = one(spark, lexicon.lexicon_matches, s)
    assert (found["NEG"], found["ENTITY_NEG"], found["ENTITY_POS"]) == (["corrupcion"], ["acusado de"], ["reconocido por"])
    assert one(spark, lexicon.relation_hits, "nada") == []


def test_boost_and_dampen(spark):
    up = one(spark, lambda a, b, c: lexicon.boost(a, b, c, F.lit("NEG")), 0.3, 0.4, 0.3)
    assert up["p_neg"] > 0.3 and sum(up) == pytest.approx(1)
    assert one(spark, lambda a, b, c: lexicon.boost(a, b, c, F.lit(None).cast("string")), 0.3, 0.4, 0.3)["p_neg"] == 0.3
    down = one(spark, lambda a, b, c: lexicon.dampen(a, b, c, F.lit(True)), 0.7, 0.2, 0.1)
    assert down["p_neg"] < 0.7 and sum(down) == pytest.approx(1)
    assert one(spark, lexicon.has_negation, "No hay apagones, no podemos hablar de apagones sino de sobrecarga") is True


def test_names_without_accents_skip_the_table(spark):
    from pyspark.sql import functions as F

    from inkspan.functions import text

    d = spark.createDataFrame([("Ana-Luz",), ("Éñe",), ("é",), ("",), (None,)], "t string").select(text.strip_accents(F.col("t")).alias("bare"))
    assert [r[0] for r in d.collect()] == ["Ana-Luz", "Ene", "e", "", None]
    assert "octet_length" in d._jdf.queryExecution().analyzed().toString()
