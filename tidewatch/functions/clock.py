"""Time as whole microseconds, independent of the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a TIMESTAMP_NTZ."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    seconds = (F.date_part(F.lit("SECOND"), ts) * MICROS).cast("bigint")
    return days * (86_400 * MICROS) + minutes * (60 * MICROS) + seconds


def from_micros(us: str) -> Column:
    """The TIMESTAMP_NTZ of a column of microseconds."""
    return F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def cell_of(us: str, width_us: int) -> Column:
    """Number of the fixed-width time cell that a moment falls into (also before 1970)."""
    return F.expr(f"({us} - pmod({us}, {width_us}L)) div {width_us}L")


def window_micros(seconds: float) -> int:
    width = round(seconds * MICROS)
    if width < 1:
        raise ValueError("the time window must be at least one microsecond")
    return width


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; the fraction is left out if it is zero."""
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".000000", "").otherwise(fraction))
