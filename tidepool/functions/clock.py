"""Time expressions. All times are UTC; TIMESTAMP_NTZ columns are taken as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.session import micros

WEEK_US = 7 * 86_400_000_000


def parse_iso(text: Column | str) -> Column:
    """TIMESTAMP_NTZ in UTC of an ISO-8601 text, with or without zone (none: UTC); null if it is malformed."""
    c = F.col(text) if isinstance(text, str) else text
    t = F.trim(c)
    at = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    zoned = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), at)
    local = F.regexp_replace(zoned, r"(Z|[+-]\d{2}:?\d{2})$", "")
    local = F.when(zoned.contains("T"), local).otherwise(zoned)
    sign = F.regexp_extract(zoned, r"T.*([+-])\d{2}:?\d{2}$", 1)
    hours = F.regexp_extract(zoned, r"T.*[+-](\d{2}):?\d{2}$", 1)
    minutes = F.regexp_extract(zoned, r"T.*[+-]\d{2}:?(\d{2})$", 1)
    shift = F.when(sign == "", 0).otherwise(F.try_to_number(hours, F.lit("99")).cast("int") * 60 + F.try_to_number(minutes, F.lit("99")).cast("int"))
    shift = F.when(sign == "-", shift).otherwise(-shift)
    return F.timestamp_add("MINUTE", shift, local.try_cast("timestamp_ntz"))


def parse_iso_strict(text: Column | str) -> Column:
    """parse_iso; a text that is malformed raises an error when its row is made, a null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    at = parse_iso(c)
    return F.when(c.isNotNull() & at.isNull(), F.raise_error(F.concat(F.lit("no ISO-8601 time: "), c)).cast("timestamp_ntz")).otherwise(at)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, cut off."""
    return F.floor(micros(ts) / 1000)


def iso_text(us: Column) -> Column:
    """ISO-8601 text with +00:00 of microseconds since 1970; the fraction only where there is one."""
    at = F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    rest = F.pmod(us, F.lit(1_000_000))
    fraction = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def gap_seconds(before_us: Column, after_us: Column) -> Column:
    return (after_us - before_us) / F.lit(1e6)


def nearness(us: Column, start_us: int | None, end_us: int | None, margin_us: int = WEEK_US) -> Column:
    """1.0 inside the closed range, 0.5 within the margin of it, else 0.0; 0.0 for null or without a range."""
    if start_us is None or end_us is None:
        return F.lit(0.0)
    return F.when(us.between(start_us, end_us), 1.0).when(us.between(start_us - margin_us, end_us + margin_us), 0.5).otherwise(0.0)


def decay(ts_ms: Column, now_ms: int, half_life_days: float = 30.0) -> Column:
    """0.5 to the power of the age in half-lives; future times count as now, null and 0 as never."""
    age = F.greatest((F.lit(now_ms) - ts_ms) / F.lit(86_400_000.0), F.lit(0.0))
    return F.when(ts_ms.isNull() | (ts_ms == 0), 0.0).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life_days)))
