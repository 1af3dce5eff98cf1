"""Column expressions used across layers. All are native, and none raises under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source and medium to channel, in order (fixed values).
MEDIA = {
    "organic_search": ("organic", "organic search"),
    "paid_search": ("cpc", "ppc", "paid search"),
    "social": ("social", "social-network", "social media"),
    "email": ("email",),
    "referral": ("referral",),
    "sms": ("sms",),
}


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole as DOUBLE rounded to `digits`; null for a null or zero denominator."""
    return F.round(F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))), digits) + F.lit(0.0)  # no negative zero


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def from_cents(c: Column) -> Column:
    return (c.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def full_name(first: Column, last: Column) -> Column:
    """Both parts with a blank between; one part alone as it is; null without any."""
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit(""))), F.lit(""))


def split_name(name: Column) -> tuple[Column, Column]:
    """(first word, rest); the rest is null where there is a single word."""
    at = F.instr(F.trim(name), " ")
    return F.when(at > 0, F.substring_index(F.trim(name), " ", 1)).otherwise(F.trim(name)), F.when(at > 0, F.trim(F.substr(F.trim(name), at + 1)))


def json_length(c: Column) -> Column:
    """Elements of a JSON array; 0 for null, blank and anything that is no array."""
    return F.coalesce(F.json_array_length(c), F.lit(0))


def column_or_property(c: Column, properties: Column, path: str) -> Column:
    """The column, or where it is blank the value of a JSON property."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.get_json_object(properties, path))


def iso_time(c: Column) -> Column:
    """TIMESTAMP of an ISO text with T and Z or without; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "T", " "), "Z$", ""))


def channel_group(source: Column, medium: Column) -> Column:
    out = F.when((source == "(direct)") | ((source == "(none)") & (medium == "(none)")), "direct")
    for name, media in MEDIA.items():
        out = out.when(medium.isin(*media), name)
    return out.otherwise("other")


def date_parts(d: Column) -> dict[str, Column]:
    """Calendar columns of a date; day_of_week counts from Sunday = 1."""
    return {
        "day_of_week": F.dayofweek(d),
        "day_name": F.date_format(d, "EEEE"),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "month_key": F.date_format(d, "yyyy-MM"),
        "is_weekend": F.dayofweek(d).isin(1, 7),
    }
