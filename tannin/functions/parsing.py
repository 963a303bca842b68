"""Text and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A full date-time text, and a number inside a text.
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}([.]\d{1,6})?Z?$"
NUMBER_IN_TEXT = r"-?(?:[0-9][0-9,]*(?:[.][0-9]*)?|[.][0-9]+)"

# The sensor's averaging interval and half of it.
BUCKET = "5 minutes"
HALF_BUCKET = "150 seconds"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_number(c: Column | str) -> Column:
    """Text to double; NULL when the text is not a number."""
    text = F.trim(_col(c).cast("string"))
    # the JVM parser would also take a type suffix such as "1d" or "2f"
    suffixed = text.rlike("[0-9.][dDfF]$")
    return F.when(~suffixed, text.try_cast("double"))


def parse_number(c: Column | str) -> Column:
    """First number inside a text, with commas read as digit grouping."""
    found = F.regexp_extract(_col(c).cast("string"), NUMBER_IN_TEXT, 0)
    return F.regexp_replace(found, ",", "").try_cast("double")


def parse_timestamp(c: Column | str, strict: bool = True) -> Column:
    """Date-time text to a timestamp; NULL when it does not parse.

    ``strict`` demands date and time; otherwise a bare date is midnight.  Text
    carries no zone of its own: it is read in the session's zone.
    """
    text = F.trim(_col(c))
    parsed = F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))
    return F.when(text.rlike(DATE_TIME), parsed) if strict else parsed


def round_5min(ts: Column | str) -> Column:
    """Nearest multiple of five minutes, ties upward; NULL stays NULL.

    Half an interval is added, then everything beyond the last multiple of
    five minutes taken off.  Keeps the timestamp type it is given.
    """
    later = _col(ts) + F.expr(f"INTERVAL {HALF_BUCKET}")
    beyond = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(later) % 5, F.extract(F.lit("SECOND"), later)
    )
    return later - beyond
