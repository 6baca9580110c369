"""Rules on map tags: layers, categories, districts, outlines, way flags, camp details.

A rule set is a list of (label, clauses) in order of priority: the first rule of which some clause holds gives
its label.  A clause maps keys to the values one of which the tag must have; no values means that the tag is
there, and a key with "!" in front must not have the values (a missing tag has none).  `first_match` makes one
expression of a rule set, for tags that are a map column; `match_rows` takes the rules as a table, for rule sets
that are data: tags meet conditions by key and value, and the least priority wins.

Defined results: null or empty tags match no rule (null label; flags and layer 0; all details null); repeated
rows give a row each; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ops import fresh

Clause = dict[str, list[str]]
Rules = list[tuple[str, list[Clause]]]

# The rule sets, the bits of way flags, and what words and numbers count in camp details.
LAYERS: Rules = [
    ("coaster", [{"attraction": ["roller_coaster"], "!roller_coaster": ["station"]}, {"roller_coaster": [], "!roller_coaster": ["station"]}]),
    ("slide", [{"attraction": ["water_slide"]}, {"man_made": ["water_slide"]}]),
    ("pool", [{"leisure": ["swimming_pool", "water_park"]}, {"sport": ["swimming"]}]),
    (
        "water",
        [
            {"natural": ["water", "bay", "wetland"]},
            {"waterway": ["riverbank", "dock", "canal", "stream", "river"]},
            {"landuse": ["reservoir", "basin"]},
            {"water": []},
        ],
    ),
    ("wood", [{"natural": ["wood", "scrub", "tree_row"]}, {"landuse": ["forest"]}]),
    (
        "grass",
        [
            {"natural": ["grassland", "heath", "sand", "beach"]},
            {"landuse": ["grass", "meadow", "village_green", "recreation_ground", "greenfield", "flowerbed"]},
            {"leisure": ["garden", "pitch", "golf_course", "miniature_golf", "common", "park"]},
        ],
    ),
    ("parking", [{"amenity": ["parking"]}, {"parking": []}]),
    ("building", [{"building": []}, {"building:part": []}]),
    (
        "path",
        [
            {"highway": ["footway", "path", "pedestrian", "steps", "corridor", "living_street", "cycleway", "track", "bridleway", "crossing"]},
            {"man_made": ["pier"], "!floating": ["yes"]},
            {"public_transport": ["platform"]},
            {"railway": ["platform"]},
        ],
    ),
    (
        "service",
        [
            {
                "highway": [
                    *("service", "residential", "unclassified", "tertiary", "tertiary_link", "secondary"),
                    *("secondary_link", "primary", "primary_link", "trunk", "trunk_link", "road"),
                ]
            },
            {"railway": ["rail", "narrow_gauge", "light_rail", "tram", "miniature", "funicular"]},
        ],
    ),
]
CAMPGROUND: list[Clause] = [{"tourism": ["camp_site", "caravan_site"]}]
CAMP_PITCH: list[Clause] = [{"tourism": ["camp_pitch"]}, {"service": ["parking_aisle"]}, {"amenity": ["parking"]}]
CATEGORIES: Rules = [
    ("coaster", [{"attraction": ["roller_coaster"]}, {"roller_coaster": []}]),
    ("ride", [{"attraction": []}, {"leisure": ["playground", "water_park", "amusement_arcade", "miniature_golf"]}, {"leisure": ["swimming_pool"]}]),
    (
        "food",
        [
            {"amenity": ["restaurant", "fast_food", "cafe", "ice_cream", "bar", "pub", "biergarten", "food_court"]},
            {"shop": ["bakery", "confectionery", "deli", "pastry", "coffee", "ice_cream"]},
        ],
    ),
    ("restroom", [{"amenity": ["toilets"]}]),
    (
        "campsite",
        [
            *CAMPGROUND,
            {"tourism": ["camp_pitch", "chalet", "wilderness_hut"]},
            {"amenity": ["sanitary_dump_station"]},
            {"building": ["cabin", "static_caravan", "bungalow"]},
            {"leisure": ["firepit"]},
        ],
    ),
    (
        "service",
        [
            {
                "amenity": [
                    *("first_aid", "hospital", "clinic", "doctors", "pharmacy", "police", "ranger_station", "drinking_water"),
                    *("charging_station", "atm", "bank", "locker", "baby_care", "shower", "bicycle_rental", "car_rental"),
                ]
            },
            {"healthcare": []},
            {"emergency": ["defibrillator", "phone", "ambulance_station"]},
            {"first_aid": []},
        ],
    ),
    ("show", [{"amenity": ["theatre", "cinema", "arts_centre"]}, {"leisure": ["bandstand", "amphitheatre"]}]),
    (
        "gate",
        [
            {"entrance": ["main", "primary"]},
            {"amenity": ["ticket_booth"]},
            {"barrier": ["toll_booth"]},
            {"name": [], "highway": ["bus_stop"]},
            {"name": [], "public_transport": ["platform", "stop_position"]},
            {"name": [], "barrier": ["gate", "entrance", "turnstile"]},
            {"name": [], "entrance": []},
        ],
    ),
    ("shop", [{"shop": []}, {"amenity": ["marketplace", "vending_machine"]}]),
    ("parking", [{"amenity": ["parking"]}]),
    (
        "landmark",
        [
            {"tourism": ["viewpoint", "artwork", "museum", "information", "picnic_site"]},
            {"historic": []},
            {"man_made": ["tower", "water_tower", "obelisk", "lighthouse", "monument"]},
            {"natural": ["peak"]},
            {"memorial": []},
        ],
    ),
]
CIVIC: list[Clause] = [{"boundary": ["administrative", "census", "statistical", "political", "historic", "postal_code"]}, {"admin_level": []}]
OUTLINES: list[Clause] = [
    {"tourism": ["theme_park", "zoo", "attraction", "camp_site", "caravan_site"]},
    {"leisure": ["park", "water_park", "nature_reserve", "stadium", "golf_course"]},
    {"amenity": ["university", "college", "school", "hospital"]},
    {"landuse": ["recreation_ground", "retail", "commercial", "education"]},
]
LANDS: list[Clause] = [
    {"tourism": ["theme_park", "zoo", "attraction"], "name": []},
    {"leisure": ["park", "water_park", "nature_reserve", "stadium"], "name": []},
    {"landuse": ["recreation_ground", "retail", "commercial", "education", "religious"], "name": []},
    {"place": ["neighbourhood", "suburb", "quarter", "city_block", "locality"], "name": []},
    {"amenity": ["university", "college", "school", "hospital", "marketplace"], "name": []},
    {"tourism": ["camp_site", "caravan_site"], "name": []},
]
STEPS, BRIDGE, TUNNEL, ONEWAY, ONEWAY_BACK, RESTRICTED = 1, 2, 4, 8, 16, 32
YES, NO = ["yes", "true", "1"], ["no", "false", "0"]
AMPERES = [15, 20, 30, 50]
DETAILS = {
    "power": ["power_supply", "electricity"],
    "water": ["water_point", "drinking_water", "water_supply"],
    "sewer": ["sanitary_dump_station", "sewer", "waste_disposal"],
    "wifi": ["internet_access"],
    "cable": ["television", "cable_tv"],
    "firepit": ["openfire", "fireplace", "firepit"],
    "picnic": ["picnic_table"],
    "caravans": ["caravans", "motorhome"],
    "tents": ["tents", "tent"],
}


def _condition(tags: Column, key: str, values: list[str]) -> Column:
    value = F.try_element_at(tags, F.lit(key.lstrip("!")))
    held = value.isin(values) if values else value.isNotNull()
    return ~F.coalesce(held, F.lit(False)) if key.startswith("!") else F.coalesce(held, F.lit(False))


def matches(tags: Column, clauses: list[Clause]) -> Column:
    """Whether some clause holds."""
    every = [reduce(lambda a, b: a & b, [_condition(tags, k, v) for k, v in c.items()]) for c in clauses]
    return reduce(lambda a, b: a | b, every)


def first_match(tags: Column, rules: Rules) -> Column:
    """The label of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for label, clauses in reversed(rules):
        out = F.when(matches(tags, clauses), label).otherwise(out)
    return out


def is_outline(tags: Column) -> Column:
    return matches(tags, OUTLINES) & ~matches(tags, CIVIC)


def is_land(tags: Column) -> Column:
    return matches(tags, LANDS) & ~matches(tags, CIVIC)


def rule_rows(rules: Rules) -> list[tuple[int, str, int, int, str, str | None, bool]]:
    """A rule set as rows (priority, label, clause, needed, key, value, denied): conditions with several values have a row for each."""
    out = []
    for priority, (label, clauses) in enumerate(rules):
        for number, clause in enumerate(clauses):
            needed = sum(not k.startswith("!") for k in clause)
            out += [(priority, label, number, needed, k.lstrip("!"), v, k.startswith("!")) for k, values in clause.items() for v in values or [None]]
    return out


RULE_SCHEMA = "priority int, label string, clause int, needed int, key string, value string, denied boolean"


def match_rows(df: DataFrame, id_column: str, tags: str, rules: DataFrame) -> DataFrame:
    """id and label of every row of df that a rule of the table `rules` (RULE_SCHEMA) holds for; the id is unique.

    Tags meet the conditions that name their key, with their value or any; a clause holds where as many
    different keys met as it needs and none that it denies.  Each clause needs at least one key.
    """
    row = df.select(F.col(id_column).alias("row_id"), F.explode(tags).alias("k", "v")).where("v is not null")
    met = row.join(rules, (F.col("k") == F.col("key")) & (F.col("value").isNull() | (F.col("value") == F.col("v"))))
    held = met.groupBy("row_id", "priority", "label", "clause", "needed").agg(
        F.countDistinct(F.when(~F.col("denied"), F.col("key"))).alias("n"), F.bool_or("denied").alias("bad")
    )
    best = held.where((F.col("n") == F.col("needed")) & ~F.col("bad")).groupBy("row_id").agg(F.min_by("label", "priority").alias("label"))
    return best.withColumnRenamed("row_id", id_column)


def way_attributes(df: DataFrame, tags: str) -> DataFrame:
    """df with flags (the bits that its tags set) and level (the tag `layer` as a whole number from -8 to 7, 0 if it is none)."""
    of = lambda key: F.try_element_at(F.col(tags), F.lit(key))
    bits = [
        (of("highway") == "steps", STEPS),
        (~of("bridge").isin(NO), BRIDGE),
        (~of("tunnel").isin(NO), TUNNEL),
        (of("oneway").isin(YES), ONEWAY),
        (of("oneway").isin("-1", "reverse"), ONEWAY_BACK),
        (of("access").isin("no", "private"), RESTRICTED),
    ]
    flags = reduce(lambda a, b: a + b, [F.when(F.coalesce(held, F.lit(False)), bit).otherwise(0) for held, bit in bits])
    number = F.trim(of("layer")).try_cast("double")
    whole = F.when(F.abs(number) < float("inf"), F.greatest(F.lit(-8.0), F.least(F.lit(7.0), number))).cast("int")
    return df.withColumns({"flags": flags, "level": F.coalesce(whole, F.lit(0))})


def camp_details(df: DataFrame, tags: str) -> DataFrame:
    """df with what tags say of a campground or pitch; null is unknown, which isn't false."""
    of = lambda key: F.try_element_at(F.col(tags), F.lit(key))
    told = lambda v: F.when(v.isin(YES), True).when(v.isin(NO), False)
    known = {name: F.coalesce(*[told(of(k)) for k in keys]) for name, keys in DETAILS.items()}
    known["wifi"] = F.coalesce(known["wifi"], F.nullif(of("internet_access"), F.lit("")) != "no")
    filled = lambda *keys: F.coalesce(*[F.nullif(of(k), F.lit("")) for k in keys])
    digits = lambda v, kept: F.nullif(F.regexp_replace(v, kept, ""), F.lit("")).try_cast("double")
    amps = F.transform(F.split(F.coalesce(filled("power_supply:amperage", "amperage"), F.lit("")), "[;,/]"), lambda x: digits(x, "[^0-9]"))
    amps = F.array_sort(F.array_distinct(F.filter(amps.cast("array<int>"), lambda n: n.isin(AMPERES))))
    known["amps"] = F.when(F.size(amps) > 0, amps)
    through = F.coalesce(of("drive_through").isin(YES), F.lit(False)) | F.coalesce(of("pull_through").isin(YES), F.lit(False))
    known["drive"] = F.when(through, "pull-through").when(of("drive_through").isin(NO), "back-in").when(of("backin").isin(YES), "back-in")
    metres = digits(filled("maxlength", "maxlength:caravan", "length"), "[^0-9.]")
    known["length"] = F.when((metres > 5) & (metres < 200), F.floor(metres + 0.5).cast("long"))
    people = digits(of("capacity"), "[^0-9]")
    known["capacity"] = F.when(people > 0, people.cast("long"))
    known["surface"], known["ref"] = filled("surface"), filled("ref")
    return df.withColumns(known)


def tag_map(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with the columns, which have a tag's name each, as one map of those that aren't null."""
    (pairs,) = fresh(df, "pairs")
    entries = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value"))) for c in columns])
    return df.withColumn(pairs, F.array_compact(entries)).withColumn(name, F.map_from_entries(pairs)).drop(pairs, *columns)
