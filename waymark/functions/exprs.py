"""Column expressions shared by the operators: rounding, distances, cells, names, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAT_METRES, LNG_METRES, EARTH = 110540.0, 111320.0, 6371000.0


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would make a null 1


def flat_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular distance, longitude scaled at the first latitude."""
    return F.hypot((lat2 - lat1) * LAT_METRES, (lng2 - lng1) * LNG_METRES * F.cos(F.radians(lat1)))


def cell(x: Column, metres_per_degree: float, size: float) -> Column:
    return F.floor(x * metres_per_degree / size).cast("long")


def ride_name(name: Column) -> Column:
    """Lower case, no brackets, marks as blanks, no leading article."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), "[^a-z0-9]+", " ")
    return F.regexp_replace(F.trim(plain), "^the ", "")


def slug(name: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("poi"))


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 for two normalised names: equal, contained, else the better of shared words and edit distance."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    words = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    edits = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(F.greatest(0.85 * words, 0.75 * edits))


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(bit) == bit
