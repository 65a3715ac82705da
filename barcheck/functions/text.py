"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: accepted ISO-8601 instants, with and without a zone
ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)? ?(Z|[+-]\d{2}(:?\d{2})?)$"
ISO_PARTS = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2})(?::?(\d{2})(?::?(\d{2})([.,]\d+)?)?)? ?(Z|[+-]\d{2}(?::?\d{2})?)$"
ISO_NO_ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def iso_instant(s: Column) -> Column:
    """Instant of an ISO-8601 string, NULL where the text is none. Callers must mask strings that lack a zone."""
    plain = s.rlike(ISO_NO_ZONE) | s.rlike(ISO_DATE)
    part = lambda i, empty="": F.coalesce(F.nullif(F.regexp_extract(s, ISO_PARTS, i), F.lit("")), F.lit(empty))
    # every accepted form is brought to one: basic times get colons, missing minutes and seconds zeros, a comma a point
    zone = F.when(part(6) == "Z", "Z").otherwise(F.concat(F.substring(part(6), 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(part(6), 4, 3), ":", ""), 2, "0")))
    full = F.concat(part(1), F.lit("T"), part(2), F.lit(":"), part(3, "00"), F.lit(":"), part(4, "00"), F.translate(part(5), ",", "."), zone)
    return F.when(s.rlike(ISO_WITH_ZONE), F.try_to_timestamp(full)).when(plain, F.try_to_timestamp(s))


def lacks_zone(s: Column) -> Column:
    return F.coalesce(s.rlike(ISO_NO_ZONE), F.lit(False))


def headline_key(title: Column) -> Column:
    """Headline reduced to lower-case letters, digits and inner spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", ""))


def canonical_json(s: Column) -> Column:
    """JSON text with sorted keys and no blanks (a VARIANT keeps its keys sorted)."""
    return F.to_json(F.try_parse_json(s))


def digest(s: Column) -> Column:
    return F.sha2(s, 256)
