"""Times: clock strings, milliseconds, file names that hold a date. All arithmetic is on long milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_INT = r"^\s*[+-]?\d+(?:_\d+)*\s*$"


def str_to_ms(text: Column, strict: bool = False) -> Column:
    """Milliseconds of 'hh:mm:ss'. Parts are not range checked ('99:99:99' counts).

    Null gives null. Anything else that isn't three whole numbers gives null, or ends the query where strict.
    """
    parts = F.split(text, ":", -1)
    number = lambda i: F.regexp_replace(F.trim(F.get(parts, F.lit(i))), "_", "").try_cast("bigint")
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike(_INT))
    value = F.when(good, (number(0) * 3600 + number(1) * 60 + number(2)) * 1000)
    if strict:
        bad = text.isNotNull() & value.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit("not hh:mm:ss: "), text)).cast("bigint")).otherwise(value)
    return value


def ms_to_str(ms: Column, include_ms: bool = False, strict: bool = False) -> Column:
    """'HH:MM:SS', or 'HH:MM:SS.mmm'; hours go on beyond 24, since recordings run for days. Below zero gives null. strict: what is outside 0 to 24:00:00 ends the query."""
    inside = ms.between(0, DAY_MS)
    hours, rest = F.floor(ms / F.lit(3_600_000)), F.pmod(ms, F.lit(3_600_000))
    minutes, seconds, millis = F.floor(rest / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000), F.pmod(ms, F.lit(1000))
    text = F.format_string("%02d:%02d:%02d.%03d", hours, minutes, seconds, millis) if include_ms else F.format_string("%02d:%02d:%02d", hours, minutes, seconds)
    if strict:
        return F.when(ms.isNull(), F.lit(None).cast("string")).when(inside, text).otherwise(F.raise_error(F.concat(F.lit("outside a day: "), ms.cast("string"))).cast("string"))
    return F.when(ms >= 0, text)


def ms_to_webvtt(ms: Column, strict: bool = False) -> Column:
    return ms_to_str(ms, include_ms=True, strict=strict)


def seconds_to_ms(seconds: Column) -> Column:
    """Round half to even, as the segment bounds are rounded; null and NaN give null."""
    return F.when(~F.isnan(seconds), F.bround(seconds * F.lit(1000.0)).cast("bigint"))


def seconds_to_ms_truncated(seconds: Column) -> Column:
    """Cut off towards zero, as turn bounds are."""
    return F.when(~F.isnan(seconds), (seconds * F.lit(1000.0)).cast("bigint"))


def pause_text(gap_ms: Column, marker: Column, first: Column) -> Column:
    """The text of a pause: from a minute on in minutes, from ten seconds in seconds, else one marker a second.

    A space precedes it, except on the first segment, where one follows. A null marker counts as '.'; a null gap gives null.
    """
    length = F.bround(gap_ms / F.lit(1000.0)).cast("int")
    body = (
        F.when(length >= 60, F.format_string("[%d minutes pause]", F.bround(length / F.lit(60.0)).cast("int")))
        .when(length >= 10, F.format_string("[%d seconds pause]", length))
        .otherwise(F.concat(F.lit("("), F.repeat(F.coalesce(marker, F.lit(".")), length), F.lit(")")))
    )
    return F.when(first, F.concat(body, F.lit(" "))).otherwise(F.concat(F.lit(" "), body))


def file_time_utc(path: Column, zone: str, fallback: Column | None = None) -> Column:
    """UTC time 'YYYY-MM-DDTHH:MM:SSZ' of a name that starts YYYY-MM-DD_HH-MM-SS in local time of zone.

    The zone is a parameter, so that the result doesn't depend on the machine. Parts needn't be padded. A name that holds no
    time, or an impossible one, gives the fallback (null when none is given).
    """
    stem = F.regexp_extract(path, r"([^/]*)$", 1)
    pattern = r"^(\d{4})-(\d{1,2})-(\d{1,2})_(\d{1,2})-(\d{1,2})-(\d{1,2})"
    part = lambda i: F.regexp_extract(stem, pattern, i).try_cast("int")
    padded = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *[part(i) for i in range(1, 7)])
    stamp = F.when(stem.rlike(pattern), F.try_to_timestamp(padded, F.lit("yyyy-MM-dd HH:mm:ss")))
    utc = F.date_format(F.to_utc_timestamp(stamp, zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(utc, fallback) if fallback is not None else utc


def date_in_text(text: Column) -> Column:
    """Time of the first 'Date/Time: YYYY-MM-DD HH:MM' (timestamp without zone), else null."""
    found = F.regexp_extract(text, r"Date/Time: (\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def date_in_name(name: Column, zone: str) -> Column:
    """UTC time of noon, local to zone, of a name that starts 'YY.MM.DD '; else null."""
    pattern = r"^(\d{2})\.(\d{2})\.(\d{2})\s"
    text = F.concat(F.lit("20"), F.regexp_extract(name, pattern, 1), F.lit("-"), F.regexp_extract(name, pattern, 2), F.lit("-"), F.regexp_extract(name, pattern, 3), F.lit(" 12:00"))
    stamp = F.when(name.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))
    return F.to_utc_timestamp(stamp, zone).cast("timestamp_ntz")


def document_date(text: Column, name: Column, zone: str, now: Column) -> Column:
    """The date in the text, else the one in the name, else now."""
    return F.coalesce(date_in_text(text), date_in_name(name, zone), now)


def clock_minutes(ms: Column) -> Column:
    """Minutes and padded seconds of a span, 'm:ss'; null below zero."""
    seconds = F.floor(ms / F.lit(1000)).cast("bigint")
    return F.when(ms >= 0, F.format_string("%d:%02d", F.floor(seconds / F.lit(60)), F.pmod(seconds, F.lit(60))))


def is_time_entry(text: Column) -> Column:
    """Whether text may be the beginning of a time being typed."""
    return text.rlike(r"^\d{0,2}(:\d{0,2}(:\d{0,2})?)?$")
