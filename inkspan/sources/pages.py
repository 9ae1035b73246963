"""From sitemaps, feeds and raw pages to article rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.dates import parse_date
from inkspan.functions.urls import canonical_url
from inkspan.sources.markup import page_fields

FALLBACK_CHARSET = "ISO-8859-1"


def sitemap_urls(df: DataFrame, column: str = "xml") -> DataFrame:
    """Rows of df with a url for each address of a sitemap; an index, broken or empty XML gives none."""
    parsed = F.from_xml(F.col(column), "url array<struct<loc:string>>")
    out = df.select("*", F.posexplode(parsed["url"]).alias("ord", "_u")).withColumn("url", F.trim("_u.loc"))
    return out.filter("url <> ''").drop("_u", column)


def feed_urls(df: DataFrame, column: str = "xml") -> DataFrame:
    """Rows of df with a url for each entry of an RSS feed."""
    parsed = F.from_xml(F.col(column), "channel struct<item:array<struct<link:string>>>")
    out = df.select("*", F.posexplode(parsed["channel"]["item"]).alias("ord", "_i")).withColumn("url", F.trim("_i.link"))
    return out.filter("url <> ''").drop("_i", column)


def page_links(df: DataFrame, key: str, pattern: str, limit: int | None = None, column: str = "html") -> DataFrame:
    """(key, ord, url): the matches of a pattern in each page, the first of each, in order."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("at", "url"))
    first = found.groupBy(key, "url").agg(F.min("at").alias("at"))
    out = first.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    return (out.filter(F.col("ord") <= limit) if limit else out).select(key, "ord", "url")


def discover_urls(sitemaps: DataFrame, feeds: DataFrame, limit: int | None = None, https_sources: list[str] | None = None) -> DataFrame:
    """(source, url, ord): sitemap addresses, then those of feeds, each once, at most limit of a source."""
    both = sitemaps.select("source", "url", F.lit(0).alias("kind"), "ord").unionByName(feeds.select("source", "url", F.lit(1).alias("kind"), "ord"))
    secure = F.col("source").isin(*https_sources) if https_sources else F.lit(False)
    both = both.withColumn("url", F.when(secure, F.regexp_replace("url", "^http://", "https://")).otherwise(F.col("url")))
    first = both.groupBy("source", "url").agg(F.min(F.struct("kind", "ord")).alias("o"))
    out = first.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("o", "url")))
    return (out.filter(F.col("ord") <= limit) if limit else out).select("source", "url", "ord")


#: Charsets of one byte a letter, by the names that pages declare.
SINGLE_BYTE = [f"iso-8859-{k}" for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15, 16)] + [f"windows-{k}" for k in range(1250, 1259)] + ["koi8-r", "koi8-u", "macintosh", "ibm850", "us-ascii"]
#: Other names of them.
CHARSET_NAMES = {"latin1": "iso-8859-1", "latin-1": "iso-8859-1", "ascii": "us-ascii", "latin9": "iso-8859-15", "latin-9": "iso-8859-15", "iso8859-1": "iso-8859-1", "iso8859-15": "iso-8859-15"} | {f"cp{k}": f"windows-{k}" for k in range(1250, 1259)}
_PYTHON = {"macintosh": "mac-roman", "ibm850": "cp850"}


def _moved(charset: str) -> tuple[str, str]:
    """The characters of Latin-1 that a charset has other ones for, and those; what it leaves open is U+FFFD."""
    pairs = [(chr(k), bytes([k]).decode(_PYTHON.get(charset, charset), "replace")) for k in range(256)]
    if charset.startswith("windows-"):  # a byte without a letter is the control character
        pairs = [(x, x if y == "\ufffd" and x < "\xa0" else y) for x, y in pairs]
    return "".join(x for x, y in pairs if x != y), "".join(y for x, y in pairs if x != y)


def decode_page(data: Column, content_type: Column) -> Column:
    """Text of page bytes by the declared charset, what is broken replaced; without one that is known, UTF-8 if valid, else Latin-1.  Never fails.

    Charsets are not guessed from the bytes.  Those with several bytes a letter
    are known only as UTF-8 and UTF-16.
    """
    declared = F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([A-Za-z0-9_\-]+)", 1))
    text = data.cast("string")
    latin = F.decode(data, FALLBACK_CHARSET)
    out = F.when(declared.isin("utf-8", "utf8"), F.make_valid_utf8(text)).when(declared == "utf-16", F.decode(data, "UTF-16")).when(declared == "utf-16le", F.decode(data, "UTF-16LE")).when(declared == "utf-16be", F.decode(data, "UTF-16BE"))
    for charset in SINGLE_BYTE:
        names = [charset, *[n for n, of in CHARSET_NAMES.items() if of == charset]]
        moved = _moved(charset)
        out = out.when(declared.isin(names), F.translate(latin, *moved) if moved[0] else latin)
    return out.otherwise(F.coalesce(F.try_validate_utf8(text), latin))


def _extract(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In small slices, so that a worker holds the fields of some pages and not of a whole batch.
        for b in (whole.slice(k, 100) for whole in batches for k in range(0, max(whole.num_rows, 1), 100)):
            at = b.schema.get_field_index(column)
            fields = zip(*[page_fields(h.as_py()) for h in b.column(at)], strict=True) if b.num_rows else [[]] * 5
            kept = [k for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *[pa.array(f, pa.string()) for f in fields]], names=[*[b.schema.names[k] for k in kept], "title", "body", "section", "published", "authors"])

    return run


def extract_articles(pages: DataFrame, column: str = "html") -> DataFrame:
    """Article fields of pages; pages without a title or without a body are dropped."""
    kept = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes if n != column)
    schema = kept + (", " if kept else "") + "title string, body string, section string, published string, authors string"
    out = pages.mapInArrow(_extract(column), schema).filter("title <> '' AND body <> ''")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return out.withColumn("section", blank(F.col("section"))).withColumn("authors", blank(F.col("authors"))).withColumn("published_at", parse_date(F.col("published"))).drop("published")


def canonical_pages(pages: DataFrame) -> DataFrame:
    """One row for each canonical address: the page with the smallest id."""
    p = pages.withColumn("canonical", canonical_url(F.col("url")))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))
