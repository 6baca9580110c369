"""Queries of tag rules over tagged things derived from `part`, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tags as T
from ..runtime import materialize
from .registry import query, table

#: Values of each tag; a thing's place in a list follows from its number, and beyond the list it has no such tag.
VALUES = {
    "attraction": (29, 7, ["roller_coaster", "water_slide", "carousel"]),
    "roller_coaster": (31, 11, ["track", "station"]),
    "man_made": (23, 5, ["pier", "tower", "lighthouse", "water_slide"]),
    "floating": (3, 2, ["yes"]),
    "leisure": (19, 3, ["park", "garden", "swimming_pool", "playground", "golf_course", "firepit", "bandstand", "stadium"]),
    "sport": (37, 13, ["swimming", "tennis"]),
    "natural": (26, 17, ["water", "wood", "sand", "peak", "cliff"]),
    "landuse": (22, 9, ["reservoir", "forest", "meadow", "retail", "religious"]),
    "amenity": (21, 10, ["parking", "cafe", "toilets", "atm", "theatre", "ticket_booth", "marketplace", "school", "bench", "sanitary_dump_station"]),
    "building": (13, 4, ["yes", "cabin", "bungalow"]),
    "highway": (17, 6, ["footway", "steps", "service", "bus_stop", "primary", "motorway", "crossing"]),
    "public_transport": (41, 15, ["platform", "stop_position", "station"]),
    "railway": (43, 16, ["platform", "miniature", "abandoned"]),
    "tourism": (27, 8, ["theme_park", "zoo", "camp_site", "camp_pitch", "viewpoint", "hotel", "caravan_site"]),
    "shop": (33, 14, ["bakery", "gift"]),
    "barrier": (25, 12, ["gate", "toll_booth", "fence"]),
    "entrance": (35, 18, ["main", "yes"]),
    "boundary": (18, 19, ["administrative", "fence"]),
    "place": (15, 20, ["locality", "farm", "quarter"]),
    "name": (2, 1, ["Any Name"]),
    "bridge": (7, 21, ["yes", "no", "viaduct"]),
    "tunnel": (9, 22, ["no", "building_passage", "false"]),
    "oneway": (8, 23, ["yes", "-1", "no", "reverse"]),
    "access": (10, 24, ["no", "private", "customers"]),
    "layer": (12, 25, ["1", "-2", "99", "-40", "1.9", "x", "-0.5"]),
    "electricity": (5, 26, ["yes", "0", "maybe"]),
    "power_supply": (7, 27, ["no", "true", "x"]),
    "amperage": (6, 28, ["30;50", "50 A/30amp", "7", "20,20,15"]),
    "internet_access": (6, 29, ["wlan", "no", "yes", ""]),
    "drive_through": (4, 30, ["yes", "no"]),
    "backin": (3, 31, ["yes"]),
    "maxlength": (5, 32, ["12.5 m", "4", "about 40ft", "900"]),
    "capacity": (4, 33, ["12 tents", "0", "none"]),
}
_N = "(p_partkey + p_size * 7)"


def _case(name: str) -> str:
    size, factor, values = VALUES[name]
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f'CASE ({_N} * {factor} + p_size) % {size} {whens} END AS {{q}}{name}{{q}}'


def _tagged_sql() -> str:
    return "WITH t AS (SELECT p_partkey AS id, " + ", ".join(_case(n).format(q='"') for n in VALUES) + " FROM part) "


def tagged(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey as id", *[_case(n).format(q="`") for n in VALUES])
    return T.tag_map(rows, list(VALUES), "tags")


_LAYER = """CASE WHEN (attraction = 'roller_coaster' OR roller_coaster IS NOT NULL) AND roller_coaster IS DISTINCT FROM 'station' THEN 'coaster'
WHEN attraction = 'water_slide' OR man_made = 'water_slide' THEN 'slide' WHEN leisure = 'swimming_pool' OR sport = 'swimming' THEN 'pool'
WHEN "natural" = 'water' OR landuse = 'reservoir' THEN 'water' WHEN "natural" = 'wood' OR landuse = 'forest' THEN 'wood'
WHEN "natural" = 'sand' OR landuse = 'meadow' OR leisure IN ('garden', 'golf_course', 'park') THEN 'grass' WHEN amenity = 'parking' THEN 'parking' WHEN building IS NOT NULL THEN 'building'
WHEN highway IN ('footway', 'steps', 'crossing') OR man_made = 'pier' AND floating IS DISTINCT FROM 'yes' OR public_transport = 'platform' OR railway = 'platform' THEN 'path'
WHEN highway IN ('service', 'primary') OR railway = 'miniature' THEN 'service' END"""


@query(_tagged_sql() + f"SELECT id, {_LAYER} AS layer FROM t")
def tag_layers(spark, sf):
    return tagged(spark, sf).select("id", T.first_match(F.col("tags"), T.LAYERS).alias("layer"))


@query(_tagged_sql() + f"SELECT id, {_LAYER} AS label FROM t WHERE {_LAYER} IS NOT NULL")
def tag_layers_by_table(spark, sf):
    """The same rules as a table that the tags are joined to."""
    rules = spark.createDataFrame(T.rule_rows(T.LAYERS), T.RULE_SCHEMA)
    return T.match_rows(materialize(tagged(spark, sf)), "id", "tags", rules)


@query(_tagged_sql() + """SELECT id, CASE WHEN attraction = 'roller_coaster' OR roller_coaster IS NOT NULL THEN 'coaster' WHEN attraction IS NOT NULL OR leisure IN ('playground', 'swimming_pool') THEN 'ride'
WHEN amenity = 'cafe' OR shop = 'bakery' THEN 'food' WHEN amenity = 'toilets' THEN 'restroom'
WHEN tourism IN ('camp_site', 'caravan_site', 'camp_pitch') OR amenity = 'sanitary_dump_station' OR building IN ('cabin', 'bungalow') OR leisure = 'firepit' THEN 'campsite'
WHEN amenity = 'atm' THEN 'service' WHEN amenity = 'theatre' OR leisure = 'bandstand' THEN 'show'
WHEN entrance = 'main' OR amenity = 'ticket_booth' OR barrier = 'toll_booth' OR name IS NOT NULL AND (highway = 'bus_stop' OR public_transport IN ('platform', 'stop_position') OR barrier = 'gate' OR entrance IS NOT NULL) THEN 'gate'
WHEN shop IS NOT NULL OR amenity = 'marketplace' THEN 'shop' WHEN amenity = 'parking' THEN 'parking'
WHEN tourism = 'viewpoint' OR man_made IN ('tower', 'lighthouse') OR "natural" = 'peak' THEN 'landmark' END AS category FROM t""")
def tag_categories(spark, sf):
    return tagged(spark, sf).select("id", T.first_match(F.col("tags"), T.CATEGORIES).alias("category"))


@query(_tagged_sql() + """SELECT id, boundary IS DISTINCT FROM 'administrative' AND coalesce(tourism IN ('theme_park', 'zoo', 'camp_site', 'caravan_site') OR leisure IN ('park', 'stadium', 'golf_course') OR amenity = 'school' OR landuse = 'retail', false) AS outline,
boundary IS DISTINCT FROM 'administrative' AND name IS NOT NULL AND coalesce(tourism IN ('theme_park', 'zoo', 'camp_site', 'caravan_site') OR leisure IN ('park', 'stadium') OR landuse IN ('retail', 'religious') OR place IN ('locality', 'quarter') OR amenity IN ('school', 'marketplace'), false) AS land,
coalesce(tourism = 'camp_pitch' OR amenity = 'parking', false) AS pitch FROM t""")
def tag_outlines(spark, sf):
    tags = F.col("tags")
    return tagged(spark, sf).select("id", T.is_outline(tags).alias("outline"), T.is_land(tags).alias("land"), T.matches(tags, T.CAMP_PITCH).alias("pitch"))


@query(_tagged_sql() + """SELECT id, CAST((highway IS NOT DISTINCT FROM 'steps')::INT + 2 * (coalesce(bridge, 'no') <> 'no')::INT + 4 * (tunnel IS NOT DISTINCT FROM 'building_passage')::INT + 8 * (oneway IS NOT DISTINCT FROM 'yes')::INT
+ 16 * coalesce(oneway IN ('-1', 'reverse'), false)::INT + 32 * coalesce(access IN ('no', 'private'), false)::INT AS INTEGER) AS flags, CAST(greatest(-8, least(7, trunc(coalesce(TRY_CAST(layer AS DOUBLE), 0)))) AS INTEGER) AS level FROM t""")
def way_attributes(spark, sf):
    return T.way_attributes(tagged(spark, sf), "tags").select("id", "flags", "level")


@query(_tagged_sql() + """SELECT id, CASE WHEN power_supply = 'true' THEN true WHEN power_supply = 'no' THEN false WHEN electricity = 'yes' THEN true WHEN electricity = '0' THEN false END AS power,
CASE amperage WHEN '30;50' THEN '30,50' WHEN '50 A/30amp' THEN '30,50' WHEN '20,20,15' THEN '15,20' END AS amps, CASE WHEN internet_access <> '' THEN internet_access <> 'no' END AS wifi,
CASE WHEN drive_through = 'yes' THEN 'pull-through' WHEN drive_through = 'no' OR backin = 'yes' THEN 'back-in' END AS drive,
CAST(CASE maxlength WHEN '12.5 m' THEN 13 WHEN 'about 40ft' THEN 40 END AS BIGINT) AS length, CAST(CASE capacity WHEN '12 tents' THEN 12 END AS BIGINT) AS capacity FROM t""")
def camp_details(spark, sf):
    told = T.camp_details(tagged(spark, sf), "tags")
    return told.select("id", "power", F.array_join(F.col("amps").cast("array<string>"), ",").alias("amps"), "wifi", "drive", "length", "capacity")
