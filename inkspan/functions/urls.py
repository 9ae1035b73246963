"""URL canonical form, sections and admission rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track readers, content types of article pages.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader",
    "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "s", "smid",
    "spm", "yclid", "_ga",
]
PAGE_TYPES = ["text/html", "application/xhtml+xml", "text/plain", "text/xml", "application/xml", "application/rss+xml"]
MOST_CHARS = 2048

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host, without user information and port."""
    return F.regexp_extract(F.lower(F.regexp_replace(_part(url, 2), r"^.*@", "")), r"^(\[[^\]]*\]|[^:]*)", 1)


def port(url: Column) -> Column:
    return F.regexp_extract(_part(url, 2), r":([^:@\]]*)$", 1)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One form for all spellings of an article's address.

    Scheme and host in lower case, no user information, default port, fragment
    or tracking parameter, other parameters sorted, no slash at the end of the
    path; the path keeps its case, and the root stays a slash.
    """
    items = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, "=(.*)$", 1)).otherwise("")).alias("v")),
    )
    kept = F.array_sort(F.filter(items, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    p = port(url)
    return F.when(
        F.trim(url).rlike(_PARTS),
        F.concat(
            scheme(url), F.lit("://"), host(url), F.when(p.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), p)),
            F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        ),
    ).otherwise(F.trim(url))


def url_section(url: Column) -> Column:
    """The first segment of the path in lower case; NULL if there is none."""
    return F.nullif(F.lower(F.regexp_extract(_part(url, 3), r"^/*([^/]+)", 1)), F.lit(""))


def url_reject(url: Column, domains: list[str], most_chars: int = MOST_CHARS) -> Column:
    """Why an address is not admitted, by the first rule that fails; NULL if it is."""
    u, h, p = F.trim(url), host(url), port(url)
    inside = F.lit(False)
    for d in domains:
        inside = inside | (F.rtrim(h, F.lit(".")) == d) | F.endswith(F.rtrim(h, F.lit(".")), F.lit("." + d))
    return (
        F.when(F.length(u) > most_chars, "too_long")
        .when(~scheme(url).isin("http", "https") | url.isNull(), "scheme")
        .when(F.contains(_part(url, 2), F.lit("@")), "credentials")
        .when(h == "", "no_host")
        .when(~p.rlike("^[0-9]*$") | ~p.isin("", "80", "443"), "port")
        .when(~inside, "domain")
    )


def content_type_ok(c: Column) -> Column:
    """Whether a content type is that of a page; a missing one is not."""
    return F.coalesce(F.lower(F.trim(F.substring_index(c, ";", 1))).isin(*PAGE_TYPES), F.lit(False))
