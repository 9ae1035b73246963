"""Lexicon labels and the small moves that they make on sentence probabilities.

All functions take the term lists as parameters; the defaults are the fixed
Spanish lists.  Terms are matched as whole words on text in lower case without
accents, longer terms first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import fold, strip_accents

# Terms that are negative or positive by themselves.
NEGATIVE = [
    "corrupcion", "corrupto", "corrupta", "soborno", "sobornos", "coima", "coimas", "desfalco", "malversacion",
    "fraude", "fraude electoral", "compra de votos", "narcotrafico", "crimen organizado", "extorsion",
    "trata de personas", "trafico de influencias", "peculado", "lavado de activos", "prision preventiva",
    "arresto domiciliario", "condena", "condenado", "condenada", "impunidad", "escandalo", "encubrimiento",
    "nepotismo", "clientelismo", "desvio de fondos", "enriquecimiento ilicito", "evasion fiscal", "abuso de poder",
    "represion", "censura", "destitucion", "destituido", "destituida", "renuncia forzada", "crisis politica",
    "vacancia", "juicio politico", "malos manejos", "opacidad", "conflicto de intereses",
    "irregularidades administrativas",
]
POSITIVE = [
    "acuerdo bipartidista", "acuerdo historico", "consenso", "pacto nacional", "dialogo nacional", "transparencia",
    "rendicion de cuentas", "reforma exitosa", "gobernabilidad", "estabilidad politica", "institucionalidad",
    "cooperacion internacional", "crecimiento economico", "reconciliacion", "gobernanza", "buenas practicas",
    "gestion eficiente", "victoria electoral", "triunfo electoral", "aprobado por unanimidad",
    "aprobada por unanimidad",
]
# Phrases that tell how the one before them comes off, and phrases of denial.
RELATION_NEGATIVE = [
    "acusado de", "acusada de", "acusados de", "acusadas de", "senalado por", "senalada por", "senalados por",
    "senaladas por", "vinculado a", "vinculada a", "vinculados a", "vinculadas a", "implicado en", "implicada en",
    "implicados en", "implicadas en", "condenado por", "condenada por", "condenados por", "condenadas por",
    "investigado por", "investigada por", "investigados por", "investigadas por", "sancionado por",
    "sancionada por", "sancionados por", "sancionadas por",
]
RELATION_POSITIVE = [
    "reconocido por", "reconocida por", "reconocidos por", "reconocidas por", "respaldado por", "respaldada por",
    "respaldados por", "respaldadas por", "premiado por", "premiada por", "premiados por", "premiadas por",
    "felicitado por", "felicitada por", "felicitados por", "felicitadas por", "elogiado por", "elogiada por",
    "elogiados por", "elogiadas por",
]
DENIAL = [
    "no hay", "no es", "no fue", "no fueron", "no son", "no se registra", "no se registran", "no damos", "no dan",
    "no podemos hablar de", "nego", "negaron", "no sean", "no sea",
]
BOOST = 0.12
DAMPING = 0.5


def any_of(terms: list[str], longest_first: bool = True) -> str:
    """A whole-word pattern over terms; which alternative wins depends on the order."""
    ordered = sorted(set(terms), key=lambda t: (-len(t) if longest_first else len(t), t))
    return r"\b(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in ordered) + r")\b"


def plain(c: Column) -> Column:
    return F.lower(strip_accents(c))


def one_sided(c: Column, negative: list[str], positive: list[str]) -> Column:
    """NEG or POS when only that side is hit; NULL for none or both."""
    t = plain(c)
    neg, pos = t.rlike(any_of(negative)), t.rlike(any_of(positive))
    return F.when(neg & ~pos, "NEG").when(pos & ~neg, "POS")


def lexicon_label(c: Column, negative: list[str] = NEGATIVE, positive: list[str] = POSITIVE) -> Column:
    return one_sided(c, negative, positive)


def relation_label(c: Column, negative: list[str] = RELATION_NEGATIVE, positive: list[str] = RELATION_POSITIVE) -> Column:
    return one_sided(c, negative, positive)


def _offsets(text: Column, pattern: str, label: str) -> Column:
    """(offset, label) of each hit, from the lengths of what lies between and before."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda acc, p: acc + F.length(p))
    at = lambda i: F.struct((total(parts, i) + total(hits, i - 1)).alias("pos"), F.lit(label).alias("label"))
    return F.when(F.size(hits) > 0, F.transform(F.sequence(F.lit(1), F.size(hits)), at)).otherwise(F.array().cast("array<struct<pos:int,label:string>>"))


def relation_hits(c: Column, negative: list[str] = RELATION_NEGATIVE, positive: list[str] = RELATION_POSITIVE) -> Column:
    """Offset (from 0) and label of every relational phrase, in order."""
    t = fold(c)
    return F.array_sort(F.concat(_offsets(t, any_of(negative), "NEG"), _offsets(t, any_of(positive), "POS")))


def has_negation(c: Column, cues: list[str] = DENIAL) -> Column:
    return plain(c).rlike(any_of(cues))


def boost(neg: Column, neu: Column, pos: Column, label: Column, by: float = BOOST) -> Column:
    """Struct p_neg, p_neu, p_pos with the label's share raised and the sum back at 1."""
    raised = {k: F.when(label == k, F.least(p + by, F.lit(1.0))).otherwise(p) for k, p in (("NEG", neg), ("NEU", neu), ("POS", pos))}
    total = raised["NEG"] + raised["NEU"] + raised["POS"]
    known = F.coalesce(label.isin(*raised), F.lit(False))
    return F.struct(*[F.when(known, raised[k] / total).otherwise(p).alias(n) for k, p, n in (("NEG", neg, "p_neg"), ("NEU", neu, "p_neu"), ("POS", pos, "p_pos"))])


def dampen(neg: Column, neu: Column, pos: Column, negated: Column, factor: float = DAMPING) -> Column:
    """Struct with both poles drawn towards neutral when the text denies something."""
    n, p = neu + (neg - neu) * factor, neu + (pos - neu) * factor
    total = n + neu + p
    return F.struct(*[F.when(negated, new / total).otherwise(old).alias(k) for k, new, old in (("p_neg", n, neg), ("p_neu", neu, neu), ("p_pos", p, pos))])


def lexicon_matches(c: Column, lists: dict[str, list[str]] | None = None) -> Column:
    """Struct of the distinct terms found, sorted, for each list."""
    lists = lists or {"NEG": NEGATIVE, "POS": POSITIVE, "ENTITY_NEG": RELATION_NEGATIVE, "ENTITY_POS": RELATION_POSITIVE}
    t = plain(c)
    return F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(any_of(terms)), 0))).alias(k) for k, terms in lists.items()])
