"""Dates, numbers, maps and JSON on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("MM/dd/yyyy", "d-MMM-yy", "yyyy-MM-dd")


def parse_date(c: Column, formats=FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def excel_date(c: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("double").cast("int"))


def months_between_plain(later: Column, earlier: Column, cap: float | None = None) -> Column:
    """12 per year, 1 per month, 1/30 per day."""
    m = (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier)) + (F.day(later) - F.day(earlier)) / F.lit(30.0)
    return F.least(F.lit(float(cap)), m) if cap is not None else m


def age_months(as_of: Column, day: Column) -> Column:
    return F.floor(F.datediff(as_of, day) / F.lit(30.4))


def event_time(text: Column, receipt: Column) -> Column:
    """RFC 3339 text as a timestamp, or the time of receipt if it does not parse."""
    return F.coalesce(F.try_to_timestamp(text), receipt)


def number(c: Column) -> Column:
    """A finite number, else null ('true', 'NaN', 'inf' and words are none)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def sigmoid(z: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), z))))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(lo, hi) of the Wilson interval; (0, 1) for no trials."""
    p, z2 = k / F.nullif(n.cast("double"), F.lit(0.0)), z * z
    mid, half, d = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    some = n > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), (mid - half) / d)).otherwise(F.lit(0.0)).alias("lo"), F.when(some, F.least(F.lit(1.0), (mid + half) / d)).otherwise(F.lit(1.0)).alias("hi"))


def arc_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def merge_filled(old: Column, new: Column) -> Column:
    """Map merge where a later value wins unless it is null."""
    return F.map_zip_with(old, new, lambda k, x, y: F.coalesce(y, x))


def merge_present(old: Column, new: Column) -> Column:
    """Map merge where every key of the later map wins, even with a null value."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def fingerprint(fields: Column, digits: int = 16) -> Column:
    """A short SHA-256 of a struct's JSON (give fields in sorted order)."""
    return F.substring(F.sha2(F.to_json(fields), 256), 1, digits)


def band(c: Column, low: float = 0.02, high: float = 0.06) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c >= high, "high").when(c >= low, "medium").otherwise("low")


def charge_class(codes: Column, mfg, paper) -> Column:
    """struct(kind, code): a comma list's smallest manufacturing code, else its smallest paperwork code, else nulls."""
    have = F.transform(F.split(codes, ","), lambda x: F.trim(x))
    least = lambda values: F.array_min(F.array_intersect(have, F.array(*[F.lit(v) for v in values])))
    m, p = least(mfg), least(paper)
    return F.struct(F.when(m.isNotNull(), "mfg").when(p.isNotNull(), "paperwork").alias("kind"), F.coalesce(m, p).alias("code"))


def fused(value_a: Column, value_b: Column, weight_a: float = 0.6, weight_b: float = 0.4) -> Column:
    """Weighted blend of two sensors; the one that is there if the other is missing."""
    return F.coalesce(weight_a * value_a + weight_b * value_b, value_a, value_b)


def contamination_pct(clean: Column, now: Column) -> Column:
    """How far a resistance has fallen below its clean value, 0 to 100 (100 where that is 0)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.try_divide(now, clean)) * 100))
