"""Date parsing, normalisation and time-bucket text (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FIXED VALUES: the export's date layout, the normalised text layout and the
# bucket labels that callers and stored data rely on.
EXPORT_DATE_PATTERN = "yyyy-MM-dd HH:mm:ss Z"          # 2024-01-01 10:00:00 -0500
NORMALISED_PATTERN = "yyyy-MM-dd'T'HH:mm:ssxxx"         # 2024-01-01T15:00:00+00:00
ISO_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
BUCKET_PATTERNS = {
    "hour": "yyyy-MM-dd'T'HH:00:00'Z'",
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_export_date(x: Column | str) -> Column:
    """Export date text -> TIMESTAMP (UTC instant); unparsable -> NULL."""
    return F.try_to_timestamp(_c(x), F.lit(EXPORT_DATE_PATTERN))


def parse_any_date(x: Column | str) -> Column:
    """Export layout, or ISO-8601 with offset/Z (GPX, ECG headers).

    Only the layouts that a text can have are tried, because a failed parse costs an exception: ISO texts have
    a ``T`` before any space, export texts have none."""
    c = _c(x)
    iso = F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in ISO_PATTERNS])
    return F.when(c.rlike("^[^ ]*[Tt]"), iso).otherwise(F.try_to_timestamp(c, F.lit(EXPORT_DATE_PATTERN)))


def normalised_text(ts: Column | str) -> Column:
    """TIMESTAMP -> RFC 3339 UTC text (``...+00:00``); session zone must be UTC."""
    return F.date_format(_c(ts), NORMALISED_PATTERN)


def normalize_date(x: Column | str) -> Column:
    """Export date text -> normalised UTC text; unparsable input passes through."""
    c = _c(x)
    return F.coalesce(normalised_text(parse_export_date(c)), c)


def bucket_pattern(unit: str) -> str:
    try:
        return BUCKET_PATTERNS[unit]
    except KeyError:
        raise ValueError(f"no bucket of this name: {unit!r} (there are {', '.join(BUCKET_PATTERNS)})") from None


def time_bucket(ts: Column | str, unit: str) -> Column:
    """Bucket label text of a TIMESTAMP; NULL timestamp -> NULL bucket."""
    return F.date_format(_c(ts), bucket_pattern(unit))


def bound(value, to_type: str = "timestamp") -> Column | None:
    """Typed, inclusive range bound from user input (D4): None stays None.

    A date-only bound means that midnight; any offset in the text is honoured.
    """
    if value is None:
        return None
    if isinstance(value, Column):
        return value
    lit = F.lit(value)
    if to_type == "timestamp":
        return F.coalesce(parse_any_date(lit), F.try_to_timestamp(lit))
    return lit.try_cast(to_type)
