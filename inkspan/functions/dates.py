"""Publication dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates without an offset are local; the country keeps one offset all year.
LOCAL_OFFSET = "-04:00"

# Month names as they are shown.
MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]

_LOCAL = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d+)?$", "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS]"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]


def parse_date(c: Column) -> Column:
    """UTC timestamp of a date text; NULL for anything not understood.

    ISO with an offset or Z, ISO without, `Y-m-d H:M:S`, `Y-m-d` and `d/m/Y`.
    Week dates and the compact ISO forms are not understood.
    """
    t = F.trim(c)
    offset = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})$")
    out = F.when(offset, F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, " ", "T"), r"([+-]\d{2})(\d{2})$", "$1:$2")))
    for pattern, form in _LOCAL:
        out = out.when(t.rlike(pattern), F.to_utc_timestamp(F.try_to_timestamp(t, F.lit(form)), LOCAL_OFFSET))
    return out


def local_day_start(day: str) -> Column:
    """UTC timestamp at which a local day begins; NULL for text that is no date."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.lit(day), F.lit("yyyy-MM-dd")), LOCAL_OFFSET)


def short_date(c: Column) -> Column:
    """Day, month name and two digits of the year; a dash for NULL."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(c))
    return F.when(c.isNull(), "—").otherwise(F.concat(F.dayofmonth(c).cast("string"), F.lit(" "), month, F.lit(" "), F.date_format(c, "yy")))
