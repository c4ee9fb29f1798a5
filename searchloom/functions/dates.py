"""Date text in the accepted formats, and zone-aware day boundaries."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, in the order they are tried.
SEARCH_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "yyyy年M月d日")
AI_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d")
REVIEW_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "yyyy.M.d")
ZONED_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|z|[+-]\d{2}:?\d{2})$"
LOCAL_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def parse_date(text: Column, formats: tuple[str, ...] = SEARCH_DATE_FORMATS) -> Column:
    raw = F.trim(text)
    return F.coalesce(*[_try_date(raw, fmt) for fmt in formats])


def _try_date(raw: Column, fmt: str) -> Column:
    return F.try_to_timestamp(raw, F.lit(fmt)).cast("date")


def utc_wall(instant: Column) -> Column:
    """Wall-clock time in UTC of an instant, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def wall_in(instant: Column, zone: Column | str) -> Column:
    """Wall-clock time of an instant in ``zone``; NULL for a NULL zone."""
    target = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), target, utc_wall(instant))


def known_zone(zone: Column) -> Column:
    """The zone if it is a name of the time-zone database or an offset, else NULL."""
    return F.when(zone.isin(*sorted(available_timezones())) | zone.rlike(r"^[+-]\d{2}:\d{2}$"), zone)


def as_of_day(text: Column, zone: Column | str) -> Column:
    """Day in ``zone`` of an as-of time; one without an offset is read in that zone. NULL for malformed texts and unknown zones."""
    raw, target = F.trim(text), F.lit(zone) if isinstance(zone, str) else known_zone(zone)
    zoned = wall_in(F.when(raw.rlike(ZONED_TIMESTAMP), raw.try_cast("timestamp")), target)
    local = F.when(~raw.rlike(ZONED_TIMESTAMP) & target.isNotNull(), raw.try_cast("timestamp_ntz"))
    return F.coalesce(zoned, local).cast("date")


def instant_of(wall: Column) -> Column:
    """The instant whose UTC wall clock shows ``wall`` (a time without zone)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall))


def parse_day(text: Column, source_zone: Column, analysis_zone: Column) -> Column:
    """Day in the analysis zone; a timestamp without an offset is read in the source zone."""
    raw = F.trim(text)
    zoned = wall_in(F.when(raw.rlike(ZONED_TIMESTAMP), raw.try_cast("timestamp")), analysis_zone)
    local = F.convert_timezone(
        source_zone, analysis_zone, F.when(raw.rlike(LOCAL_TIMESTAMP), raw.try_cast("timestamp_ntz"))
    )
    return F.coalesce(parse_date(text, REVIEW_DATE_FORMATS), F.coalesce(zoned, local).cast("date"))


def temporal_grain(text: Column) -> Column:
    raw = F.trim(text)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("unknown"))
        .when(parse_date(text, REVIEW_DATE_FORMATS).isNotNull(), F.lit("date"))
        .when(raw.rlike(ZONED_TIMESTAMP) | raw.rlike(LOCAL_TIMESTAMP), F.lit("timestamp"))
        .otherwise(F.lit("invalid"))
    )
