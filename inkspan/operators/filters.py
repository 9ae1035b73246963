"""Article, URL and mention filters, listings and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.dates import local_day_start
from inkspan.functions.lexicon import any_of, plain
from inkspan.functions.text import PARTICLES, finds, norm_key, strip_accents
from inkspan.functions.urls import url_section
from inkspan.operators.resolve import ACTORS

# Sections whose political names are never the topic; words and names that are no mention.
OTHER_SECTIONS = [
    "entretenimiento", "farandula", "espectaculos", "deportes", "el-deporte", "la-vida", "vivir", "moda", "gente",
    "loterias", "horoscopo", "turismo", "gastronomia",
]
# What an article on politics names.
TOPIC_TERMS = [
    "presidencia de la republica", "poder ejecutivo", "palacio nacional",
    "senado", "senador", "senadora", "camara de diputados", "diputado", "diputada",
    "congreso nacional", "junta central electoral", "jce", "tribunal superior electoral",
    "tribunal constitucional", "suprema corte de justicia", "procuraduria general",
    "procurador general", "ministerio de la presidencia", "ayuntamiento", "sindico",
    "sindica", "regidor", "regidora", "gabinete ministerial", "cancilleria",
    "poder judicial", "camara de cuentas", "defensor del pueblo", "consejo de estado",
    "junta electoral", "liga municipal dominicana", "consultoria juridica",
    "contraloria general de la republica", "consejo nacional de la magistratura",
    "consejo economico y social",
    "alcaldia", "vicealcalde", "vicealcaldesa", "concejal", "distrito municipal", "fedomin",
    "partido revolucionario moderno", "partido de la liberacion dominicana",
    "fuerza del pueblo", "partido revolucionario dominicano",
    "partido reformista social cristiano", "prm", "pld", "prd", "prsc", "fp",
    "gente de dominguez", "opcion democratica", "partido politico",
    "partido revolucionario independiente", "pri", "partido civico renovador", "pcr",
    "partido humanista dominicano", "phd", "partido verde dominicano",
    "partido fuerza nacional progresista", "fnp", "dominicanos por el cambio", "dxc",
    "alianza pais", "movimiento patria para todos", "mpt",
    "luis abinader", "abinader", "danilo medina", "leonel fernandez", "abel martinez",
    "guillermo moreno", "hipolito mejia", "raquel pena", "carolina mejia", "victor orlando bisono",
    "elecciones", "campana electoral", "candidato presidencial",
    "candidata presidencial", "candidatura", "reforma constitucional",
    "presupuesto nacional", "gobierno dominicano", "oposicion politica",
    "proyecto de ley", "decreto presidencial", "consulta popular",
    "boletin electoral", "encuesta electoral", "precandidato", "precandidata",
    "alcalde", "alcaldesa", "vicepresidenta de la republica", "vicepresidente de la republica",
    "elecciones municipales", "elecciones congresuales", "elecciones generales",
    "elecciones presidenciales", "primarias electorales", "padron electoral",
    "colegio electoral", "recinto electoral", "mesa electoral", "escrutinio electoral",
    "fraude electoral", "delito electoral", "observador electoral",
    "segunda vuelta electoral", "registro electoral", "reglamento electoral",
    "delegado electoral", "delegada electoral",
    "asamblea nacional revisora", "reforma a la constitucion", "enmienda constitucional",
    "veto presidencial", "comision permanente", "ley electoral", "ley de partidos",
]
STOP_NAMES = ["foto", "video", "listín", "listin", "diario", "libre"]
GENERIC_ORGS = ["republica", "estado", "nacion", "pais", "administracion"]
KNOWN_BRANDS = ["instagram", "facebook", "twitter", "x", "tiktok", "youtube", "whatsapp", "telegram", "linkedin"]
PROVINCES = [
    "azua", "bahoruco", "barahona", "dajabon", "distrito nacional", "duarte", "el seibo", "elias pina", "espaillat",
    "hato mayor", "hermanas mirabal", "independencia", "la altagracia", "la romana", "la vega",
    "maria trinidad sanchez", "monsenor nouel", "monte cristi", "montecristi", "monte plata", "pedernales", "peravia",
    "puerto plata", "samana", "san cristobal", "san jose de ocoa", "san juan", "san pedro de macoris",
    "sanchez ramirez", "santiago", "santiago rodriguez", "santo domingo", "valverde",
]
VENUE_WORDS = [
    "calle", "avenida", "autopista", "carretera", "salon", "sala", "auditorio", "asamblea", "conferencia", "coliseo",
    "estadio", "polideportivo", "gimnasio", "palacio", "casa", "centro", "complejo", "plaza", "plazoleta", "parque",
    "malecon", "puente", "glorieta", "rotonda", "monumento", "iglesia", "parroquia", "catedral", "escuela", "liceo",
    "colegio", "universidad", "instituto", "biblioteca", "museo", "teatro", "hospital", "clinica", "hotel",
    "aeropuerto", "puerto", "mercado", "club", "estacion", "terminal", "edificio", "torre", "residencial",
    "urbanizacion", "sector", "barrio", "condominio", "circunscripcion", "demarcacion", "subalcaldia",
    "subsecretaria", "tribunal", "gabinete", "despacho", "consultorio", "villa", "homenaje", "honor", "tributo",
    "reconocimiento", "memoria",
]
#: Fields that a listing filters by equality.
EQUAL_FIELDS = ("overall_sentiment", "framing", "headline_intent", "lead_orientation", "source_quality", "has_hard_data")
LOW_CONFIDENCE = 0.9
SCHEMA_VERSION = 2


def article_predicate(source: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, q: str | None = None, **equal) -> Column:
    """All given conditions together; what is absent, or no date, does not filter."""
    parts = []
    if source:
        parts.append(F.col("source").isin(*source))
    for name, value in equal.items():
        if name not in EQUAL_FIELDS:
            raise ValueError(f"no filter named {name}")
        if value is not None:
            parts.append(F.col(name) == F.lit(value))
    if date_from:
        start = local_day_start(date_from)
        parts.append(start.isNull() | (F.col("published_at") >= start))
    if date_to:
        end = local_day_start(date_to) + F.expr("INTERVAL 1 DAY")
        parts.append(end.isNull() | (F.col("published_at") < end))
    if q:
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(finds(F.col(c), q), F.lit(False)) for c in ("title", "main_topic", "topic_keywords")]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_articles(articles: DataFrame, mentions: DataFrame | None = None, entity: str | None = None, **filters) -> DataFrame:
    """Articles that pass all filters; with entity, those that mention a matching name, each once."""
    out = articles.filter(article_predicate(**filters))
    if entity:
        hits = mentions.filter(finds(F.col("name"), entity)).select(F.col("article_id").alias("id"))
        out = out.join(hits, "id", "left_semi")
    return out


def _page(df: DataFrame, limit: int, offset: int, most: int) -> DataFrame:
    return df.offset(max(0, offset)).limit(min(max(1, limit), most))


def list_articles(articles: DataFrame, sort: str = "recent", limit: int = 20, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the filtered articles, newest or oldest first."""
    found = filter_articles(articles, **filters)
    order = F.col("published_at").desc_nulls_first() if sort == "recent" else F.col("published_at").asc_nulls_last()
    return _page(found.drop("body").orderBy(order, F.desc("id")), limit, offset, 100), found.agg(F.count(F.lit(1)).alias("total"))


def list_canonical(counts: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return _page(counts.orderBy(F.desc("article_count"), "name", "id"), limit, offset, 200)


def list_aliases(aliases: DataFrame, q: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    found = aliases.filter(finds(F.col("alias"), q) | finds(F.col("canonical_name"), q)) if q else aliases
    return _page(found.orderBy("alias", "id"), limit, offset, 1000)


def is_topic(url: Column, title: Column, body: Column, terms: list[str] = TOPIC_TERMS, blocked: list[str] = OTHER_SECTIONS) -> Column:
    """Not in a blocked section, and a term in the title or two different ones in the body."""
    pattern = any_of(terms, longest_first=False)
    in_body = F.size(F.array_distinct(F.regexp_extract_all(plain(F.coalesce(body, F.lit(""))), F.lit(pattern), 0))) >= 2
    return ~F.coalesce(url_section(url).isin(*blocked), F.lit(False)) & (F.coalesce(plain(title).rlike(pattern), F.lit(False)) | in_body)


def clean_mentions(raw: DataFrame, org_keys: DataFrame | None = None, provinces: list[str] = PROVINCES, generic: list[str] = GENERIC_ORGS, brands: list[str] = KNOWN_BRANDS) -> DataFrame:
    """Drop spans that are no name and set the kind of known brands.

    Out go spans over two lines, of under 3 characters, stop names, generic
    state names as ORG, provinces as PERSON, anything with a digit, and spans
    that end in a particle, brands apart.  A kind that is neither PERSON nor ORG
    stays, as ORG, only if its key is in org_keys (column alias_key).
    """
    m = raw.withColumn("_key", norm_key(F.col("name")))
    m = m.withColumn("_known", F.lit(False)) if org_keys is None else m.join(org_keys.select(F.col("alias_key").alias("_key"), F.lit(True).alias("_known")).distinct(), "_key", "left")
    kind = F.when(F.col("type").isin("PER", "PERSON"), "PERSON").when(F.col("type") == "ORG", "ORG").when(F.coalesce("_known", F.lit(False)), "ORG")
    brand = F.col("_key").isin(*brands)
    last = F.element_at(F.split("_key", " "), -1)
    m = m.withColumn("type", kind).filter(F.col("type").isNotNull())
    bad = F.contains(F.col("name"), F.lit("\n")) | (F.length("name") < 3) | F.col("_key").isin(*STOP_NAMES) | F.col("name").rlike("[0-9]")
    bad = bad | ((F.col("type") == "ORG") & F.col("_key").isin(*generic)) | ((F.col("type") == "PERSON") & F.col("_key").isin(*provinces)) | (~brand & last.isin(*PARTICLES))
    return m.filter(~bad).withColumn("type", F.when(brand, "ORG").otherwise(F.col("type"))).drop("_key", "_known")


def review_queue(mentions: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    return mentions.filter(F.col("extraction_confidence") < below)


def ambiguous_persons(mentions: DataFrame, venue_words: list[str] = VENUE_WORDS) -> DataFrame:
    """Persons whose context has a word for a place."""
    words = F.transform(F.split(F.lower(strip_accents(F.col("context"))), r"\s+"), lambda w: F.regexp_replace(w, "^[.,;:()\"']+|[.,;:()\"']+$", ""))
    return mentions.filter((F.col("type") == "PERSON") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in venue_words])))


def needs_backfill(articles: DataFrame, version: str, schema: int = SCHEMA_VERSION) -> DataFrame:
    """Articles analysed by another version, or under an older schema or none."""
    return articles.filter(~F.col("analyzer_version").eqNullSafe(F.lit(version)) | F.col("analysis_schema_version").isNull() | (F.col("analysis_schema_version") < schema))


def audit_constraints(articles: DataFrame, mentions: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule, n): how many keys break each unique rule, and how many rows point to no row.

    References are checked as far as the columns are there: a mention's article
    and dimension row, and the three actors of an article.
    """
    def repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")

    def orphans(df: DataFrame, column: str, to: DataFrame, rule: str) -> DataFrame:
        lost = df.filter(F.col(column).isNotNull()).join(to.select(F.col("id").alias(column)), column, "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")

    links = [(mentions, "article_id", articles, "orphan_mention"), (mentions, "canonical_entity_id", canonical, "orphan_link")]
    links += [(articles, f"{a}_id", canonical, f"orphan_{a}") for a in ACTORS]
    return reduce(DataFrame.unionByName, [
        repeated(articles, "article_url", "url"), repeated(mentions, "mention", "article_id", "name", "type"),
        repeated(canonical, "canonical", "name", "type"), repeated(aliases, "alias", "alias_key", "type"),
        *[orphans(*link) for link in links if link[1] in link[0].columns],
    ])
