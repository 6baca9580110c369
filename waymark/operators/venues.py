"""Operators on venues: where a fix belongs, which fixes stay, entrances, reviews, ladders, audits.

Defined results: rows with a null position lie in no box and near nothing; repeated rows count each; ties go
to the row that the named order puts first, and orders end in a key; an empty table gives an empty result, or
one row of zeros where the operator sums up a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import LAT_METRES, LNG_METRES, half_up, haversine
from ..functions.names import utc_day
from .folds import fold, verdict
from .ops import fresh, latest, within
from .spatial import first_near, in_boxes, nearest_anywhere

# Ranks with the points they take, and what an action earns.
RANK_LADDER = [("visitor", 0), ("scout", 50), ("ranger", 250), ("cartographer", 1000), ("steward", 3000)]
AWARDS = {"first": 12, "confirm": 2, "deny": 2, "live": 2}
DAY_BONUS, OVERTURNED_REPUTATION = 5, -10
# Confidence bands, the surest last.
BANDS = ["unknown", "low", "medium", "high", "verified"]
# Outlooks of a ride, the worst last.
OUTLOOKS = ["running", "watch", "hold", "closed"]


def in_box(lat: Column, lng: Column, box: Column) -> Column:
    """Whether a point lies in a box (south, north, west, east), its sides excluded; false where anything is null."""
    inside = (lat < box["north"]) & (lat > box["south"]) & (lng < box["east"]) & (lng > box["west"])
    return F.coalesce(inside, F.lit(False))


def venue_of(points: DataFrame, venues: DataFrame) -> DataFrame:
    """points with venue, inside and venue_metres: the nearest centre of the venues whose box holds the point, of all venues if none does.

    venues has venue, c_lat, c_lng and a box (south, north, west, east); of equals (to 0.1 mm) the least venue.
    Positions are judged once.  They meet boxes by cells; those in no box are searched for the nearest centre,
    however far (`spatial.nearest_anywhere`).  Points without a finite position have no venue.
    """
    box = F.struct("south", "north", "west", "east")
    spots = points.select("lat", "lng").where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    metres = F.hypot((F.col("c_lat") - F.col("lat")) * LNG_METRES, (F.col("c_lng") - F.col("lng")) * LNG_METRES * F.cos(F.radians("lat")))
    known = venues.select("venue", "c_lat", "c_lng", "south", "north", "west", "east")
    inside = in_boxes(spots, known, box).where(in_box(F.col("lat"), F.col("lng"), box))
    held = inside.groupBy("lat", "lng").agg(F.min(F.struct(F.round(metres, 4).alias("venue_metres"), "venue")).alias("b"))
    held = held.select("lat", "lng", "b.venue", F.lit(True).alias("inside"), "b.venue_metres")
    centres = known.select(F.col("venue").alias("place"), F.col("c_lat").alias("r_lat"), F.col("c_lng").alias("r_lng"))
    near = nearest_anywhere(spots.join(held, ["lat", "lng"], "left_anti"), centres, LNG_METRES)
    found = held.unionByName(near.select("lat", "lng", F.col("place").alias("venue"), F.lit(False).alias("inside"), F.col("metres").alias("venue_metres")))
    return points.join(found, ["lat", "lng"], "left").select(*points.columns, "venue", "inside", "venue_metres")


def fix_verdicts(fixes: DataFrame, key: str, seq: str, box: dict[str, float], metres: float = 8.0, accuracy: float = 35.0) -> DataFrame:
    """fixes with keep and reason, the first that holds: manual, invalid, outside, accuracy, first, too-close (to the last one kept), moved.

    One pass over each key's rows in order of seq (of equals by position) judges every row, repeated ones too;
    a null key is a key; a position or accuracy that isn't finite counts as missing.
    """
    (why,) = fresh(fixes, "verdict")
    told = fold(fixes, [key], [seq, "lat", "lng"], verdict(box, metres, accuracy), why, "string")
    return told.select(*fixes.columns, F.col(why).isin("first", "moved").alias("keep"), F.col(why).alias("reason"))


def best_entrance(entrances: DataFrame, order: str) -> DataFrame:
    """The located entrance of the surest band for each place; of equals the first in order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, BANDS)), F.coalesce("band", F.lit("unknown"))), F.lit(0))
    return latest(entrances.where("lat is not null and lng is not null"), ["place"], [F.desc(rank), F.asc(order)])


def sprawl(lines: DataFrame, key: str, metres: float = 60.0) -> DataFrame:
    """key and span (whole metres from the first to the last point of line) where it is more than `metres`, widest first."""
    a, b = F.get("line", F.lit(0)), F.element_at("line", -1)
    span = lines.where(F.size("line") > 0).select(key, haversine(a["lat"], a["lng"], b["lat"], b["lng"]).alias("m"))
    return span.where(F.col("m") > metres).select(key, half_up(F.col("m")).cast("long").alias("span")).orderBy(F.desc("span"), key)


def nearby(reports: DataFrame, points: DataFrame, key: str, metres: float = 150.0, k: int | None = None) -> DataFrame:
    """Reports (place, r_lat, r_lng) at most `metres` from each point, numbered nearest first; the first k, if k is given.

    With k, positions meet, each with its k least places: neither crowded places nor points at one position multiply pairs.
    """
    if k is None:
        near = within(points.select(key, "lat", "lng"), reports, metres, inclusive=True).withColumn("metres", F.round("metres", 4))
    else:
        near = points.select(key, "lat", "lng").join(first_near(points, reports, metres, k, inclusive=True).drop("rank"), ["lat", "lng"])
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("metres", "place")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select(key, "place", "metres", "rank")


def near_counts(points: DataFrame, places: DataFrame, witness: str, metres: float, inclusive: bool = False) -> DataFrame:
    """place, n_near and n_devices: points near each place, and their different witnesses; places near none have no row.

    Positions meet, not rows: points are counted and witnesses told apart by position before they are joined.
    """
    spots = places.select("r_lat", "r_lng").distinct()
    seen = points.groupBy("lat", "lng", witness).agg(F.count("*").alias("_n"))
    pairs = within(seen.select("lat", "lng").distinct(), spots, metres, inclusive)
    found = pairs.join(seen, ["lat", "lng"]).groupBy("r_lat", "r_lng").agg(F.sum("_n").alias("n_near"), F.countDistinct(witness).alias("n_devices"))
    return places.join(found, ["r_lat", "r_lng"]).select("place", "n_near", "n_devices")


def best_near(points: DataFrame, places: DataFrame, key: str, metres: float, first: Column, k: int) -> DataFrame:
    """key, place and rank: the k best places of each point, by `first` (a column of places), nearness and place; points at one position share them."""
    near = within(points.select("lat", "lng").distinct(), places.withColumn("_first", first), metres)
    order = W.partitionBy("lat", "lng").orderBy(F.desc("_first"), F.round("metres", 4), "place")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return points.join(ranked, ["lat", "lng"]).select(key, "place", "rank")


def rank_progress(profiles: DataFrame, xp: str = "xp") -> DataFrame:
    """profiles with rank, floor, next_rank, to_go and fraction: the highest rung that xp reaches, and the way to the next."""
    n = F.greatest(F.lit(0), F.coalesce(F.col(xp), F.lit(0)))
    rank, floor, following, at = (F.lit(None) for _ in range(4))
    for k, (name, least) in enumerate(RANK_LADDER):
        up = RANK_LADDER[k + 1] if k + 1 < len(RANK_LADDER) else (None, None)
        reached = n >= least
        rank, floor = F.when(reached, name).otherwise(rank), F.when(reached, least).otherwise(floor)
        following, at = F.when(reached, F.lit(up[0])).otherwise(following), F.when(reached, F.lit(up[1])).otherwise(at)
    fraction = F.coalesce((n - floor) / (at - floor), F.lit(1.0))
    return profiles.select("*", rank.alias("rank"), floor.cast("long").alias("floor"), following.cast("string").alias("next_rank"), (at - n).cast("long").alias("to_go"), half_up(fraction, 6).alias("fraction"))


def scored(events: DataFrame) -> DataFrame:
    """xp, reputation, awards and overturned of every profile, from events (profile, seq, action, key, has_profile, near, ms).

    A key earns once: the first event that has a profile, was near and names an award; on a day (UTC) other than
    that of the award before it earns the bonus too.  What is overturned takes back what its key earned before.
    """
    base = F.lit(0)
    for action, points in AWARDS.items():
        base = F.when(F.col("action") == action, points).otherwise(base)
    able = events.where("has_profile and near").withColumn("base", base).where("base > 0")
    by_key = F.row_number().over(W.partitionBy("profile", "key").orderBy("seq"))
    first = able.withColumn("_n", F.when(F.col("key").isNull(), 1).otherwise(by_key)).where("_n = 1").withColumn("day", utc_day(F.col("ms")))
    before = F.lag("day").over(W.partitionBy("profile").orderBy("seq"))
    earned = first.withColumn("points", F.col("base") + F.when(F.col("day").eqNullSafe(before), 0).otherwise(DAY_BONUS)).select("profile", "seq", "key", "points")
    lost = events.where("action = 'overturned'")
    taken = earned.join(lost.select(F.col("profile").alias("p"), F.col("key").alias("k"), F.col("seq").alias("s")), (F.col("profile") == F.col("p")) & (F.col("key") == F.col("k")) & (F.col("s") > F.col("seq")), "left_semi")
    parts = earned.select("profile", F.col("points").alias("xp"), F.lit(0).alias("rep"), F.lit(1).alias("a"), F.lit(0).alias("o"))
    parts = parts.unionByName(taken.select("profile", (-F.col("points")).alias("xp"), F.lit(0).alias("rep"), F.lit(0).alias("a"), F.lit(0).alias("o")))
    parts = parts.unionByName(lost.select("profile", F.lit(0).alias("xp"), F.lit(OVERTURNED_REPUTATION).alias("rep"), F.lit(0).alias("a"), F.lit(1).alias("o")))
    parts = parts.unionByName(events.select("profile", *[F.lit(0).alias(c) for c in ("xp", "rep", "a", "o")]))
    return parts.groupBy("profile").agg(*[F.sum(c).alias(n) for c, n in (("xp", "xp"), ("rep", "reputation"), ("a", "awards"), ("o", "overturned"))])


def status_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By key the rides reported down, and those at risk of the others (tone bad or warn): disjoint counts."""
    down = F.coalesce(F.col("status") == "down", F.lit(False))
    return rows.groupBy(*keys).agg(F.count_if(down).alias("reported_down"), F.count_if(~down & F.col("tone").isin("bad", "warn")).alias("at_risk"))


def outlook_tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By key how many rides have each outlook, the worst of them, how many are affected, and all."""
    order = F.array(*map(F.lit, OUTLOOKS))
    counts = [F.count_if(F.col("outlook") == o).alias(o) for o in OUTLOOKS]
    out = rows.groupBy(*keys).agg(*counts, F.max(F.array_position(order, F.col("outlook"))).alias("_w"), F.count_if(F.col("outlook").isin(*OUTLOOKS)).alias("total"))
    worst = F.coalesce(F.get(order, (F.col("_w") - 1).cast("int")), F.lit(OUTLOOKS[0]))
    return out.select(*keys, *OUTLOOKS, worst.alias("worst"), (F.col("total") - F.col("running")).alias("affected"), "total")


def evidence_summary(nodes: DataFrame) -> DataFrame:
    """One row: features, those with claims, published, of a high band or better, and the share published (0 without features)."""
    own = nodes.where(F.coalesce(~F.col("kind").isin("ride", "metadata"), F.lit(True)))
    high = F.col("band").isin(*BANDS[BANDS.index("high") :])
    out = own.agg(F.count("*").alias("features"), F.count_if(F.col("n_claims") > 0).alias("with_claims"), F.count_if("published").alias("published"), F.count_if(high).alias("high_band"))
    return out.withColumn("publish_rate", F.when(F.col("features") > 0, half_up(F.col("published") / F.col("features"), 6)).otherwise(0.0))


def trace_summary(fixes: DataFrame, keys: list[str], seq: str, ms: str) -> DataFrame:
    """By key (a session) the points, metres walked and duration, never below 0."""
    w = W.partitionBy(*keys).orderBy(seq)
    step = haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    out = fixes.withColumn("_m", step).groupBy(*keys).agg(F.count("*").alias("points"), half_up(F.coalesce(F.sum("_m"), F.lit(0.0)), 2).alias("metres"), F.min_by(ms, seq).alias("_a"), F.max_by(ms, seq).alias("_b"))
    return out.select(*keys, "points", "metres", F.greatest(F.lit(0), F.col("_b") - F.col("_a")).alias("duration_ms"))


def key_audit(places: DataFrame, key: str) -> DataFrame:
    """One row: places, keyed ones, those without a key (or an empty one), keys that more than one place has."""
    keyed = F.coalesce(F.length(key) > 0, F.lit(False))
    counts = places.groupBy(F.when(keyed, F.col(key)).alias("k")).agg(F.count("*").alias("n"))
    held = F.col("k").isNotNull()
    number = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return counts.agg(number("n").alias("total"), number(F.when(held, F.col("n"))).alias("keyed"), number(F.when(~held, F.col("n"))).alias("unkeyed"), F.count_if(held & (F.col("n") > 1)).alias("duplicate_keys"))


def duplicate_keys(places: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key another row has too."""
    n = places.where(F.length(key) > 0).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return places.join(n, key, "left_semi").select(key, name)


def apply_heights(places: DataFrame, rules: DataFrame, floor: str = "medium") -> DataFrame:
    """places (place, name, lowest) with lowest from the rule (term, least, confidence) of their name, and outcome: applied, skipped or none.

    A rule below the confidence floor is skipped; of several rules of one term the surest counts, then the least.
    """
    position = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, BANDS)), c), F.lit(0))
    known = latest(rules.withColumn("term", F.lower("term")), ["term"], [F.desc(position(F.col("confidence"))), F.asc("least")])
    both = places.join(known.select("term", "least", "confidence"), F.lower("name") == F.col("term"), "left")
    sure = position(F.col("confidence")) >= BANDS.index(floor) + 1
    outcome = F.when(F.col("term").isNull(), "none").when(sure, "applied").otherwise("skipped")
    return both.select(*[c for c in places.columns if c != "lowest"], F.when(outcome == "applied", F.col("least")).otherwise(F.col("lowest")).alias("lowest"), outcome.alias("outcome"))


def unmatched(left: DataFrame, right: DataFrame, name: str, other: str) -> DataFrame:
    """The distinct names of left, small letters, that right has not; null names are left out."""
    named = left.where(F.col(name).isNotNull()).select(F.lower(name).alias(name)).distinct()
    return named.join(right.select(F.lower(other).alias("_o")), F.col(name) == F.col("_o"), "left_anti")


def review_gate(required: DataFrame, decisions: DataFrame) -> DataFrame:
    """By venue pass and reason: any rejected key fails; else every required key must be approved.

    required has venue and key (null: nothing is required); decisions has venue, key and decision.
    """
    rejected = decisions.where("decision = 'reject'").groupBy("venue").agg(F.count("*").alias("rejected"))
    approved = decisions.where("decision = 'approve'").select("venue", "key").distinct().withColumn("ok", F.lit(True))
    open_keys = required.join(approved, ["venue", "key"], "left").groupBy("venue").agg(F.count_if(F.col("key").isNotNull() & F.col("ok").isNull()).alias("awaiting"))
    both = open_keys.join(rejected, "venue", "left").fillna(0, ["rejected"])
    reason = F.when(F.col("rejected") > 0, "rejected").when(F.col("awaiting") > 0, "awaiting approval")
    return both.select("venue", reason.isNull().alias("pass"), reason.alias("reason"), "rejected", "awaiting")


def boundary(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary of each key: named and tagged before named before the largest; of equals the least id."""
    named, tagged = F.col("named"), F.col("tagged")
    return latest(candidates, keys, [F.desc((named & tagged).cast("int")), F.desc(named.cast("int")), F.desc("area"), F.asc("id")])


def manifest_differences(claimed: DataFrame, actual: DataFrame, keys: list[str], slack: dict[str, int]) -> DataFrame:
    """Rows (keys, field, claimed, actual) where a count differs by more than the field's slack; a missing row counts 0."""
    rows = lambda df, as_name: df.select(*keys, F.explode(F.create_map(*[x for f in slack for x in (F.lit(f), F.col(f).cast("long"))])).alias("field", as_name))
    both = rows(claimed, "claimed").join(rows(actual, "actual"), [*keys, "field"], "full").fillna(0, ["claimed", "actual"])
    allowed = F.create_map(*[x for f, n in slack.items() for x in (F.lit(f), F.lit(n))])[F.col("field")]
    return both.where(F.abs(F.col("claimed") - F.col("actual")) > allowed)


def below_lock(measured: DataFrame, locks: DataFrame, keys: list[str], value: str, least: str) -> DataFrame:
    """Rows whose value is below its lock, or missing where one is locked."""
    both = locks.join(measured, keys, "left")
    return both.where(F.col(least).isNotNull() & (F.col(value).isNull() | (F.col(value) < F.col(least)))).select(*keys, value, least)


def selected(catalogue: DataFrame, existing: DataFrame | None = None, only: list | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows (id, rank, skip) of the ids asked for, with a rank in [first, last], not skipped, and not in existing (id)."""
    out = catalogue.where(~F.coalesce(F.col("skip"), F.lit(False)))
    if only:
        out = out.where(F.col("id").isin(*only))
    if first is not None:
        out = out.where(F.col("rank") >= first)
    if last is not None:
        out = out.where(F.col("rank") <= last)
    return out if existing is None else out.join(existing.select("id"), "id", "left_anti")


def live_members(members: DataFrame, now: int, ttl_ms: int = 45 * 60_000) -> DataFrame:
    """Members seen at most ttl_ms ago; those without a device stay."""
    return members.where(F.coalesce(F.col("device_less"), F.lit(False)) | (now - F.col("last_seen") <= ttl_ms))


def live_reports(reports: DataFrame, keys: list[str], seq: str, now: int, ttl_ms: int) -> DataFrame:
    """The last report of each key, unless it takes the one before back (null status) or is older than ttl_ms."""
    return latest(reports, keys, [F.desc(seq)]).where(F.col("status").isNotNull() & (now - F.col("ms") <= ttl_ms))


def trace_candidates(segments: DataFrame, vertices: DataFrame, gap: float = 12.0, size: float = 15.0) -> DataFrame:
    """Grid cells of walked segments that lie off the known paths, those that most sessions walked first.

    segments has seq (their order), session, mid_lat, mid_lng and metres; vertices (r_lat, r_lng) are the points of
    known paths.  Segments less than `gap` metres from a vertex are left out.  Of each cell of `size` metres, its
    numbers cut towards zero: its different sessions (null and empty ones aren't; without any, its segments),
    and of its first segment the session, the metres and the whole metres to the nearest vertex, however far
    (null if there is none).  Segments without a position are left out; of equal seq the least session is first.
    """
    cut = lambda v, k: (v * k / size).cast("long")
    mids = segments.where(F.col("mid_lat").isNotNull() & F.col("mid_lng").isNotNull())
    spots = mids.select(F.col("mid_lat").alias("lat"), F.col("mid_lng").alias("lng")).distinct()
    near = within(spots, vertices.select("r_lat", "r_lng").distinct(), gap).select(F.col("lat").alias("mid_lat"), F.col("lng").alias("mid_lng")).distinct()
    off = mids.join(near, ["mid_lat", "mid_lng"], "left_anti")
    named = F.nullif(F.col("session").cast("string"), F.lit(""))
    cells = off.groupBy(cut(F.col("mid_lat"), LAT_METRES).alias("cell_lat"), cut(F.col("mid_lng"), LNG_METRES).alias("cell_lng")).agg(
        F.countDistinct(named).alias("n"), F.count("*").alias("rows"), F.min(F.struct("seq", "session", "metres", "mid_lat", "mid_lng")).alias("s")
    )
    out = cells.select("cell_lat", "cell_lng", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("rows")).alias("sessions"), "s.*")
    gaps = nearest_anywhere(out.selectExpr("mid_lat as lat", "mid_lng as lng"), vertices.select("r_lat", "r_lng", F.lit(0).alias("place")))
    joined = out.join(gaps.select(F.col("lat").alias("mid_lat"), F.col("lng").alias("mid_lng"), F.bround("metres").cast("long").alias("gap_metres")), ["mid_lat", "mid_lng"], "left")
    return joined.select("cell_lat", "cell_lng", "sessions", "gap_metres", "seq", "session", "metres").orderBy(F.desc("sessions"), F.desc(F.coalesce("metres", F.lit(0.0))), "seq")
