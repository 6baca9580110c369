"""Column expressions on names, codes and coordinates.

Defined results: a null argument gives null, unless the function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import LAT_METRES, LNG_METRES, half_up

# Words that a queue's name has and its ride's has not.
QUEUE_WORDS = ["standby", "fastlane", "fast lane", "lightning lane", "express", "single rider", "exit", "entrance", "queue", "line", "switchback"]
#: Letters and digits of an invite code; those that look alike are left out.
CODE_LETTERS, CODE_LENGTH = "A-HJ-NP-Z2-9", 6


def queue_to_ride(name: Column) -> Column:
    """A queue way's name without its queue words, in small letters; null is empty."""
    words = "|".join(QUEUE_WORDS)
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), rf"(?i)\s*[-–—]?\s*\b({words})\b", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def invite_code(raw: Column) -> Column:
    """Capitals and digits of a typed code, six at most; null is empty."""
    return F.substring(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), f"[^{CODE_LETTERS}]", ""), 1, CODE_LENGTH)


def identity(key: Column, own_id: Column, title: Column, lat: Column, lng: Column) -> Column:
    """The first that is there of key, id, title@lat,lng and title; empty texts count as missing."""
    some = lambda x: F.nullif(x, F.lit(""))
    placed = F.concat(F.coalesce(title, F.lit("")), F.lit("@"), lat.cast("string"), F.lit(","), lng.cast("string"))
    return F.coalesce(some(key), some(own_id), placed, title, F.lit(""))


def coarse(lat: Column, lng: Column, metres: float = 50.0) -> Column:
    """A struct (lat, lng) on a grid of about `metres`; the step of longitude is that of the row's latitude."""
    lat_step, lng_step = F.lit(metres / LAT_METRES), metres / (LNG_METRES * F.cos(F.radians(lat)))
    return F.struct((half_up(lat / lat_step) * lat_step).alias("lat"), (half_up(lng / lng_step) * lng_step).alias("lng"))


def rounded_ring(ring: Column, digits: int = 5) -> Column:
    """A ring of points rounded to `digits`, without points equal to the one before."""
    points = F.transform(ring, lambda p: F.struct(half_up(p["lat"], digits).alias("lat"), half_up(p["lng"], digits).alias("lng")))
    return F.filter(points, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(points, i - 1)))


def utc_day(ms: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd")


def battery(level: Column, charging: Column) -> Column:
    """0 to 1 in steps of 0.01: 1 on a charger, else the level; missing or hostile values are 0."""
    clamped = F.when(level.isNull() | F.isnan(level), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)))
    return half_up(F.when(F.coalesce(charging, F.lit(False)), 1.0).otherwise(clamped), 2)


def category_height(categories: Column) -> Column:
    """The largest n of the labels over-n; else 0 for the two labels that admit everybody; else null."""
    over = F.filter(F.transform(categories, lambda c: F.nullif(F.regexp_extract(c, r"^over-(\d+)$", 1), F.lit("")).cast("int")), lambda n: n.isNotNull())
    free = F.array_contains(categories, "kid-friendly") | F.array_contains(categories, "fun-for-all")
    return F.when(F.size(over) > 0, F.array_max(over)).when(free, 0)


def credit_line(own: Column, fallback: Column, addition: Column) -> Column:
    """The first credit that isn't empty, with the addition appended unless it is there already."""
    base = F.coalesce(F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(fallback), F.lit("")))
    return F.when(base.isNull(), addition).when(addition.isNull() | F.contains(base, addition), base).otherwise(F.concat_ws(" · ", base, addition))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one, where both have a key the right one's value; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
