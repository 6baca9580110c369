"""Ordered rules as column expressions: weather, freshness, fading, words for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import EARTH, LAT_METRES, LNG_METRES, half_up

# The groups of weather codes and the thresholds of the ladder.
THUNDER = [95, 96, 99]
SNOW = [71, 73, 75, 77, 85, 86]
FREEZING = [56, 57, 66, 67]
RAIN = [51, 53, 55, 61, 63, 65, 80, 81, 82]
WIND_MPH, COLD_F, HOT_F, PRECIP_INCHES, CHANCE = 35, 68, 100, 0.02, 60


def condition(code: Column, gust: Column, temp: Column, precip: Column, chance: Column, lightning: Column) -> Column:
    """The worst condition that holds: storm, wind, rain, cold, heat, clear."""
    wet = code.isin(RAIN + SNOW + FREEZING) | (precip >= PRECIP_INCHES) | (chance >= CHANCE)
    ladder = [(code.isin(THUNDER) | lightning, "storm"), (gust >= WIND_MPH, "wind"), (wet, "rain"), (temp < COLD_F, "cold"), (temp >= HOT_F, "heat")]
    out = F.lit("clear")
    for holds, name in reversed(ladder):
        out = F.when(holds, name).otherwise(out)
    return out


def is_due(last_ms: Column, cadence: Column, now_ms: int) -> Column:
    """Whether a daily or weekly job is due; one that never ran is, a manual one never."""
    day = 86_400_000
    period = F.when(cadence == "daily", day).when(cadence == "weekly", 7 * day)
    return F.when(cadence == "manual", False).otherwise(F.coalesce(now_ms - last_ms >= period, F.lit(True)))


def is_stale(value: Column, at_ms: Column, now_ms: int, days: int) -> Column:
    """A value of unknown or old date is stale; no value can't be."""
    return F.when(value.isNull(), False).otherwise(F.coalesce(now_ms - at_ms >= days * 86_400_000, F.lit(True)))


# Milliseconds between fixes by motion with a full and an empty battery, walking speed, battery levels.
CADENCE = {"walking": (3000, 5000), "standing": (15000, 30000), "background": (60000, 120000)}
WALKING_SPEED, HEALTHY, LOW, LEAST_GAP_MS = 0.35, 0.5, 0.2, 750


def motion(speed: Column, background: Column, metres: Column, gap_ms: Column) -> Column:
    """background, walking or standing: by the speed told, else by the metres since the fix before, if it is old enough to tell."""
    told = F.when((speed >= 0) & (speed < float("inf")), speed)
    derived = F.when(gap_ms >= LEAST_GAP_MS, metres / (gap_ms / 1000))
    return F.when(F.coalesce(background, F.lit(False)), "background").when(F.coalesce(told, derived) >= WALKING_SPEED, "walking").otherwise("standing")


def cadence_ms(kind: Column, battery: Column, charging: Column) -> Column:
    """Milliseconds to the next fix: longer the emptier the battery, between its healthy and its low level."""
    level = F.when(~F.isnan(battery) & ~F.coalesce(charging, F.lit(False)), battery)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (HEALTHY - level) / (HEALTHY - LOW)))
    out = F.lit(None).cast("long")
    for name, (short, long) in CADENCE.items():
        out = F.when(kind == name, F.when(level.isNull(), short).otherwise(half_up(short + t * (long - short)).cast("long"))).otherwise(out)
    return out


def mark_opacity(age_ms: Column) -> Column:
    return F.when(age_ms >= 7 * 86_400_000, 0.4).otherwise(1.0)


def distance_words(metres: Column) -> Column:
    feet = metres * 3.28084
    near = F.concat((half_up(feet / 5) * 5).cast("int").cast("string"), F.lit(" ft"))
    return F.when(metres.isNull(), "-").when(feet < 1000, near).otherwise(F.format_string("%.2f mi", half_up(feet / 5280, 2)))


def walk_words(metres: Column) -> Column:
    seconds = metres / 1.15
    return F.when(seconds < 60, "<1 min").otherwise(F.concat(half_up(seconds / 60).cast("int").cast("string"), F.lit(" min")))


def age_words(ms: Column) -> Column:
    s = half_up(ms / 1000)
    number = lambda x: half_up(x).cast("long").cast("string")
    return F.when(s < 15, "just now").when(s < 60, F.concat(number(s), F.lit(" sec ago"))).when(s < 3600, F.concat(number(s / 60), F.lit(" min ago"))).otherwise(F.concat(number(s / 3600), F.lit(" hr ago")))


def score_cell(lat: Column, lng: Column, metres: float) -> Column:
    """A cell of about `metres` as text, longitude scaled at the latitude."""
    index = lambda x: half_up(x / metres).cast("long").cast("string")
    return F.concat(index(lat * LAT_METRES), F.lit(":"), index(lng * LNG_METRES * F.cos(F.radians(lat))))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def cardinal(degrees: Column) -> Column:
    names = F.array(*map(F.lit, ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]))
    return F.get(names, (half_up(degrees / 45).cast("int") % 8))


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Web Mercator x and y, in metres."""
    return EARTH * F.radians(lng), EARTH * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def heights_in(text: Column) -> Column:
    """The inches written before the first bracket: struct of least and greatest, each within 24 to 96."""
    found = F.transform(F.regexp_extract_all(F.split(text, r"\(")[0], F.lit('(?i)(\\d{2,3})\\s*(?:in|")'), F.lit(1)), lambda x: x.cast("int"))
    sane = lambda x: F.when(x.between(24, 96), x)
    return F.struct(sane(F.get(found, F.lit(0))).alias("least"), sane(F.get(found, F.lit(1))).alias("greatest"))
