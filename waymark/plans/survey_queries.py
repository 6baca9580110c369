"""Queries of the operators on venues, names and audits, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.exprs import half_up, haversine
from ..operators import ops as O
from ..operators import venues as U
from . import views as V
from .registry import query as _query
from .registry import view as _view
from .registry import with_views as _with

_NOW = 1706400000000  # 2024-01-28, in ms
_BOX = "c_lat - r AS south, c_lat + r AS north, c_lng - r AS west, c_lng + r AS east"
_BANDS = "['unknown', 'low', 'medium', 'high', 'verified']"


def _haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


@_query(
    _with(f=V.FIX, q=V.PLACE)
    + f""", o AS (SELECT device, seq, ms, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM f),
p AS (SELECT *, lag(lat) OVER w AS b_lat, lag(lng) OVER w AS b_lng, ms - lag(ms) OVER w AS dt FROM o WINDOW w AS (PARTITION BY device ORDER BY seq)),
s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt < 0 OR dt >= 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM p),
m AS (SELECT seq, CASE WHEN seq % 7 > 0 THEN device || '-' || session END AS session, (lat + b_lat) / 2 AS y, (lng + b_lng) / 2 AS x, {_haversine('b_lat', 'b_lng', 'lat', 'lng')} AS metres FROM s WHERE dt BETWEEN 0 AND 43199999),
g AS (SELECT seq, session, y, x, metres, min(sqrt(pow((r_lat - y) * 110540, 2) + pow((r_lng - x) * 111320 * cos(radians(y)), 2))) AS gap FROM m, (SELECT DISTINCT CAST(r_lat AS DOUBLE) AS r_lat, CAST(r_lng AS DOUBLE) AS r_lng FROM q WHERE place % 3 = 0) GROUP BY ALL),
k AS (SELECT *, CAST(trunc(y * 110540 / 15) AS BIGINT) AS cell_lat, CAST(trunc(x * 111320 / 15) AS BIGINT) AS cell_lng FROM g WHERE gap >= 12)
SELECT cell_lat, cell_lng, CASE WHEN count(DISTINCT session) > 0 THEN count(DISTINCT session) ELSE count(*) END AS sessions, CAST(round_even(arg_min(gap, seq), 0) AS BIGINT) AS gap_metres, min(seq) AS seq,
(arg_min(coalesce(session, '-'), seq)) AS session, floor(arg_min(metres, seq) * 100 + 0.5) / 100 AS metres FROM k GROUP BY 1, 2"""
)
def trace_candidates(spark, sf):
    """Midpoints of steps within a session, off the vertices that a third of the places are."""
    f = _view(spark, sf, V.FIX).selectExpr("device", "seq", "ms", "cast(lat as double) lat", "cast(lng as double) lng")
    w = O.W.partitionBy("device", "session").orderBy("seq")
    steps = O.sessions(f, "device", "ms", "seq", 12 * 3600 * 1000).withColumns({"b_lat": F.lag("lat").over(w), "b_lng": F.lag("lng").over(w)}).where("b_lat is not null")
    named = F.when(F.col("seq") % 7 > 0, F.concat_ws("-", "device", "session"))
    segments = steps.select("seq", named.alias("session"), ((F.col("lat") + F.col("b_lat")) / 2).alias("mid_lat"), ((F.col("lng") + F.col("b_lng")) / 2).alias("mid_lng"), haversine(F.col("b_lat"), F.col("b_lng"), F.col("lat"), F.col("lng")).alias("metres"))
    vertices = _view(spark, sf, V.PLACE).where("place % 3 = 0").selectExpr("cast(r_lat as double) r_lat", "cast(r_lng as double) r_lng")
    found = U.trace_candidates(segments, vertices)
    return found.withColumns({"session": F.coalesce("session", F.lit("-")), "metres": half_up(F.col("metres"), 2)})


@_query(_with(f=V.FIX, a=V.AREA) + f""", v AS (SELECT area AS venue, c_lat, c_lng, {_BOX} FROM a),
d AS (SELECT seq, venue, lat < north AND lat > south AND lng < east AND lng > west AS inside, round(sqrt(pow((c_lat - lat) * 111320, 2) + pow((c_lng - lng) * 111320 * cos(radians(lat)), 2)), 4) AS m FROM f, v)
SELECT seq, CAST(venue AS BIGINT) AS venue, inside, floor(m * 100 + 0.5) / 100 AS metres FROM d QUALIFY row_number() OVER (PARTITION BY seq ORDER BY inside DESC, m, venue) = 1""")
def venue_of_fix(spark, sf):
    venues = _view(spark, sf, V.AREA).selectExpr("cast(area as long) venue", "cast(c_lat as double) c_lat", "cast(c_lng as double) c_lng", "cast(c_lat - r as double) south", "cast(c_lat + r as double) north", "cast(c_lng - r as double) west", "cast(c_lng + r as double) east")
    found = U.venue_of(_view(spark, sf, V.FIX).selectExpr("seq", "cast(lat as double) lat", "cast(lng as double) lng"), venues)
    return found.select("seq", "venue", "inside", half_up(F.col("venue_metres"), 2).alias("metres"))


@_query()
def fix_verdicts(spark, sf):
    fixes = _view(spark, sf, V.FIX).selectExpr("device", "seq", "case when seq % 17 > 0 then lat end lat", "lng", "seq % 11 = 0 manual", "value / 4 acc")
    box = {"south": 39.3405, "north": 39.3495, "west": -84.2675, "east": -84.2585}
    return U.fix_verdicts(fixes, "device", "seq", box)


@_query(_with(c=V.CLAIM) + f""", e AS (SELECT feature_id AS place, seq, ({_BANDS})[CAST(weight // 10 AS INTEGER)] AS band, lat, lng FROM c WHERE lat IS NOT NULL)
SELECT place, seq, band FROM e QUALIFY row_number() OVER (PARTITION BY place ORDER BY coalesce(list_position({_BANDS}, coalesce(band, 'unknown')), 0) DESC, seq) = 1""")
def best_entrance(spark, sf):
    rows = _view(spark, sf, V.CLAIM).selectExpr("feature_id place", "seq", f"get(array{_BANDS.replace('[', '(').replace(']', ')')}, cast(floor(weight / 10) as int) - 1) band", "lat", "lng")
    return U.best_entrance(rows, "seq").select("place", "seq", "band")


@_query(_with(f=V.FIX) + f""", l AS (SELECT device, arg_min(lat, seq) AS a, arg_min(lng, seq) AS b, arg_max(lat, seq) AS c, arg_max(lng, seq) AS d FROM f GROUP BY device), m AS (SELECT device, {_haversine('a', 'b', 'c', 'd')} AS m FROM l)
SELECT device, CAST(floor(m + 0.5) AS BIGINT) AS span FROM m WHERE m > 60""")
def sprawling_walks(spark, sf):
    ends = lambda f: F.struct(f("lat", "seq").cast("double").alias("lat"), f("lng", "seq").cast("double").alias("lng"))
    lines = _view(spark, sf, V.FIX).groupBy("device").agg(F.array(ends(F.min_by), ends(F.max_by)).alias("line"))
    return U.sprawl(lines, "device")


@_query(_with(f=V.FIX, q=V.PLACE) + """, p AS (SELECT device, lat, lng FROM f QUALIFY row_number() OVER (PARTITION BY device ORDER BY seq DESC) = 1),
d AS (SELECT device, place, round(sqrt(pow((r_lat - lat) * 110540, 2) + pow((r_lng - lng) * 111320 * cos(radians(lat)), 2)), 4) AS m, sqrt(pow((r_lat - lat) * 110540, 2) + pow((r_lng - lng) * 111320 * cos(radians(lat)), 2)) AS raw FROM p, q)
SELECT device, place, m AS metres, row_number() OVER (PARTITION BY device ORDER BY m, place) AS rank FROM d WHERE raw <= 150 QUALIFY rank <= 8""")
def nearby_reports(spark, sf):
    last = O.latest(_view(spark, sf, V.FIX), ["device"], [F.desc("seq")])
    return U.nearby(_view(spark, sf, V.PLACE).select("place", "r_lat", "r_lng"), last, "device", 150.0, 8)


_LADDER = ", ".join(f"('{name}', {least}, {U.RANK_LADDER[k + 1][1] if k < 4 else 'NULL'}, {repr(U.RANK_LADDER[k + 1][0]) if k < 4 else 'NULL'})" for k, (name, least) in enumerate(U.RANK_LADDER))


@_query(_with(f=V.FIX) + f""", x AS (SELECT device, count(*) * 10 AS xp FROM f GROUP BY device), l(rank, floor, up, next_rank) AS (VALUES {_LADDER})
SELECT device, xp, rank, CAST(floor AS BIGINT) AS floor, next_rank, CAST(up - xp AS BIGINT) AS to_go, coalesce(floor((xp - floor) / (up - floor) * 1000000 + 0.5) / 1000000, 1.0) AS fraction FROM x JOIN l ON floor <= xp QUALIFY row_number() OVER (PARTITION BY device ORDER BY floor DESC) = 1""")
def rank_ladder(spark, sf):
    return U.rank_progress(_view(spark, sf, V.FIX).groupBy("device").agg((F.count("*") * 10).alias("xp")))


_EVENTS = "SELECT author AS profile, id AS seq, CASE kind WHEN 'height' THEN 'first' WHEN 'amenity' THEN 'confirm' WHEN 'geometry' THEN 'deny' WHEN 'poi_patch' THEN 'live' ELSE 'overturned' END AS action, CASE WHEN id % 13 > 0 THEN place END AS key, id % 7 > 0 AS has_profile, id % 5 > 0 AS near, ms FROM c"


@_query(_with(c=V.CONTRIBUTION) + f""", e AS ({_EVENTS}), b AS (SELECT *, CASE action WHEN 'first' THEN 12 WHEN 'confirm' THEN 2 WHEN 'deny' THEN 2 WHEN 'live' THEN 2 ELSE 0 END AS base FROM e),
n AS (SELECT *, CASE WHEN key IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY profile, key ORDER BY seq) END AS n FROM b WHERE has_profile AND near AND base > 0),
d AS (SELECT *, CAST(epoch_ms(ms) AS DATE) AS day FROM n WHERE n = 1), l AS (SELECT *, lag(day) OVER (PARTITION BY profile ORDER BY seq) AS yesterday FROM d),
w AS (SELECT profile, seq, key, base + CASE WHEN yesterday IS NOT NULL AND day = yesterday THEN 0 ELSE 5 END AS points FROM l),
t AS (SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.action = 'overturned' AND e.profile = w.profile AND e.key = w.key AND e.seq > w.seq))
SELECT profile, CAST(coalesce((SELECT sum(points) FROM w WHERE w.profile = p.profile), 0) - coalesce((SELECT sum(points) FROM t WHERE t.profile = p.profile), 0) AS BIGINT) AS xp, CAST(-10 * (SELECT count(*) FROM e WHERE action = 'overturned' AND e.profile = p.profile) AS BIGINT) AS reputation, (SELECT count(*) FROM w WHERE w.profile = p.profile) AS awards, (SELECT count(*) FROM e WHERE action = 'overturned' AND e.profile = p.profile) AS overturned FROM (SELECT DISTINCT profile FROM e) p""")
def score_first_per_key(spark, sf):
    return U.scored(spark.sql(_EVENTS.replace("FROM c", "FROM {c}"), c=_view(spark, sf, V.CONTRIBUTION)))


@_query(_with(r=V.REPORT) + f""", l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ride ORDER BY seq DESC) = 1), s AS (SELECT ride % 5 AS land, status, CASE ride % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'warn' WHEN 2 THEN 'good' END AS tone FROM l)
SELECT land, count(*) FILTER (status = 'down') AS reported_down, count(*) FILTER (status <> 'down' AND tone IN ('bad', 'warn')) AS at_risk FROM s GROUP BY land""")
def status_summary(spark, sf):
    last = O.latest(_view(spark, sf, V.REPORT), ["ride"], [F.desc("seq")])
    return U.status_summary(last.selectExpr("ride % 5 land", "status", "case ride % 4 when 0 then 'bad' when 1 then 'warn' when 2 then 'good' end tone"), ["land"])


_OUTLOOK = "CASE p_size % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'hold' WHEN 2 THEN 'watch' WHEN 5 THEN NULL ELSE 'running' END"


@_query(_with(q=V.PLACE) + f""", o AS (SELECT category, {_OUTLOOK} AS outlook FROM q), t AS (SELECT category, count(*) FILTER (outlook = 'running') AS running, count(*) FILTER (outlook = 'watch') AS watch, count(*) FILTER (outlook = 'hold') AS hold, count(*) FILTER (outlook = 'closed') AS closed FROM o GROUP BY category)
SELECT category, running, watch, hold, closed, CASE WHEN closed > 0 THEN 'closed' WHEN hold > 0 THEN 'hold' WHEN watch > 0 THEN 'watch' ELSE 'running' END AS worst, watch + hold + closed AS affected, running + watch + hold + closed AS total FROM t""")
def outlook_tally(spark, sf):
    return U.outlook_tally(_view(spark, sf, V.PLACE).selectExpr("category", f"{_OUTLOOK} outlook"), ["category"])


_NODES = f"SELECT feature_id, CASE feature_id % 9 WHEN 0 THEN 'ride' WHEN 1 THEN 'metadata' WHEN 2 THEN NULL ELSE 'gate' END AS kind, count(*) - 3 AS n_claims, feature_id % 4 = 0 AS published, CASE WHEN sum(weight) > 600 THEN 'high' WHEN sum(weight) > 300 THEN 'medium' END AS band FROM c GROUP BY feature_id"


@_query(_with(c=V.CLAIM) + f""", n AS ({_NODES}), f AS (SELECT * FROM n WHERE kind IS NULL OR kind NOT IN ('ride', 'metadata'))
SELECT count(*) AS features, count(*) FILTER (n_claims > 0) AS with_claims, count(*) FILTER (published) AS published, count(*) FILTER (band IN ('high', 'verified')) AS high_band, coalesce(floor(count(*) FILTER (published) / nullif(count(*), 0) * 1000000 + 0.5) / 1000000, 0.0) AS publish_rate FROM f""")
def evidence_summary(spark, sf):
    return U.evidence_summary(spark.sql(_NODES.replace("FROM c", "FROM {c}"), c=_view(spark, sf, V.CLAIM)))


@_query(_with(f=V.FIX) + f""", g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY device ORDER BY seq) AS dt FROM f),
s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt < 0 OR dt >= 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM g),
p AS (SELECT *, lag(lat) OVER w AS b_lat, lag(lng) OVER w AS b_lng FROM s WINDOW w AS (PARTITION BY device, session ORDER BY seq))
SELECT device, CAST(session AS BIGINT) AS session, count(*) AS points, floor(coalesce(sum({_haversine('b_lat', 'b_lng', 'lat', 'lng')}), 0) * 100 + 0.5) / 100 AS metres, CAST(greatest(0, arg_max(ms, seq) - arg_min(ms, seq)) AS BIGINT) AS duration_ms FROM p GROUP BY device, session""")
def trace_summary(spark, sf):
    return U.trace_summary(O.sessions(_view(spark, sf, V.FIX), "device", "ms", "seq", 12 * 3600 * 1000), ["device", "session"], "seq", "ms")


_KEYED = "SELECT place, name, CASE place % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(name) END AS k FROM q"


@_query(_with(q=V.PLACE) + f", k AS ({_KEYED}) SELECT count(*) AS total, count(*) FILTER (k <> '') AS keyed, count(*) FILTER (k IS NULL OR k = '') AS unkeyed, (SELECT count(*) FROM (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1)) AS duplicate_keys FROM k")
def key_audit(spark, sf):
    return U.key_audit(spark.sql(_KEYED.replace("FROM q", "FROM {q}"), q=_view(spark, sf, V.PLACE)), "k")


@_query(_with(q=V.PLACE) + f", k AS ({_KEYED}) SELECT k, place FROM k WHERE k <> '' AND k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)")
def duplicate_keys(spark, sf):
    return U.duplicate_keys(spark.sql(_KEYED.replace("FROM q", "FROM {q}"), q=_view(spark, sf, V.PLACE)), "k", "place")


@_query(_with(q=V.PLACE) + "SELECT DISTINCT category, lower(name) AS name FROM q")
def distinct_names(spark, sf):
    return _view(spark, sf, V.PLACE).select("category", F.lower("name").alias("name")).distinct()


_RULES = f"SELECT upper(name) AS term, 30 + place % 30 AS least, CASE place % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS confidence FROM q WHERE place % 3 = 0"


@_query(_with(q=V.PLACE) + f""", r AS (SELECT lower(term) AS term, least, confidence FROM ({_RULES}) QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY coalesce(list_position({_BANDS}, confidence), 0) DESC, least) = 1)
SELECT place, CASE WHEN term IS NULL THEN 'none' WHEN coalesce(list_position({_BANDS}, confidence), 0) >= 3 THEN 'applied' ELSE 'skipped' END AS outcome, CAST(CASE WHEN coalesce(list_position({_BANDS}, confidence), 0) >= 3 THEN least ELSE lowest END AS BIGINT) AS lowest FROM q LEFT JOIN r ON lower(name) = term""")
def heights_applied(spark, sf):
    places = _view(spark, sf, V.PLACE)
    rules = spark.sql(_RULES.replace("FROM q", "FROM {q}"), q=places)
    return U.apply_heights(places.select("place", "name", "lowest"), rules).select("place", "outcome", F.col("lowest").cast("long").alias("lowest"))


@_query(_with(q=V.PLACE) + "SELECT DISTINCT lower(name) AS name FROM q WHERE name IS NOT NULL AND lower(name) NOT IN (SELECT lower(name) FROM q WHERE p_size > 10)")
def tracks_without_place(spark, sf):
    places = _view(spark, sf, V.PLACE)
    return U.unmatched(places, places.where("p_size > 10"), "name", "name")


@_query(_with(q=V.PLACE) + """, o AS (SELECT name || CASE WHEN place % 5 = 0 THEN ' x' ELSE '' END AS term FROM q) SELECT DISTINCT lower(term) AS term FROM o WHERE lower(term) NOT IN (SELECT lower(name) FROM q)""")
def overrides_without_target(spark, sf):
    places = _view(spark, sf, V.PLACE)
    return U.unmatched(places.selectExpr("name || case when place % 5 = 0 then ' x' else '' end term"), places, "term", "name")


@_query(_with(q=V.PLACE) + "SELECT name FROM q WHERE p_size < 20 UNION SELECT name FROM q WHERE p_size % 2 = 0")
def drops_union(spark, sf):
    places = _view(spark, sf, V.PLACE)
    return places.where("p_size < 20").select("name").union(places.where("p_size % 2 = 0").select("name")).distinct()


_TYPED = "SELECT place, name || CASE place % 5 WHEN 0 THEN ' - Single Rider' WHEN 1 THEN ' queue Line' WHEN 2 THEN ' ENTRANCE' WHEN 3 THEN ' linen' ELSE '' END AS way, name || place AS raw FROM q"


@_query(_with(q=V.PLACE) + f""", t AS ({_TYPED}) SELECT place, lower(trim(regexp_replace(regexp_replace(way, '(?i)\\s*[-–—]?\\s*\\b({'|'.join(N.QUEUE_WORDS)})\\b', ' ', 'g'), '\\s+', ' ', 'g'))) AS ride, substring(regexp_replace(upper(raw), '[^A-HJ-NP-Z2-9]', '', 'g'), 1, 6) AS code FROM t""")
def normalised_names(spark, sf):
    typed = spark.sql(_TYPED.replace("FROM q", "FROM {q}"), q=_view(spark, sf, V.PLACE))
    return typed.select("place", N.queue_to_ride(F.col("way")).alias("ride"), N.invite_code(F.col("raw")).alias("code"))


@_query(_with(f=V.FIX) + """SELECT seq, floor((floor(lat / (50 / 110540.0) + 0.5) * (50 / 110540.0)) * 1e6 + 0.5) / 1e6 AS c_lat, floor((floor(lng / (50 / (111320.0 * cos(radians(lat)))) + 0.5) * (50 / (111320.0 * cos(radians(lat))))) * 1e6 + 0.5) / 1e6 AS c_lng, strftime(epoch_ms(ms), '%Y-%m-%d') AS day, CASE WHEN seq % 9 = 0 THEN 1.0 ELSE floor(greatest(0, least(1, value / 90)) * 100 + 0.5) / 100 END AS battery FROM f""")
def coarse_fixes(spark, sf):
    fixes = _view(spark, sf, V.FIX).selectExpr("seq", "cast(lat as double) lat", "cast(lng as double) lng", "ms", "value / 90 level", "seq % 9 = 0 charging")
    at = fixes.withColumn("c", N.coarse(F.col("lat"), F.col("lng")))
    return at.select("seq", half_up(F.col("c.lat"), 6).alias("c_lat"), half_up(F.col("c.lng"), 6).alias("c_lng"), N.utc_day(F.col("ms")).alias("day"), N.battery(F.col("level"), F.col("charging")).alias("battery"))


_LABELS = "SELECT place, CASE place % 5 WHEN 0 THEN 'over-' || p_size WHEN 1 THEN 'kid-friendly' WHEN 2 THEN 'thrill' ELSE NULL END AS a, CASE place % 3 WHEN 0 THEN 'over-40' WHEN 1 THEN 'fun-for-all' ELSE 'over-x' END AS b FROM q"


@_query(_with(q=V.PLACE) + f""", l AS ({_LABELS}), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(a, '^over-(\\d+)$', 1), '') AS INTEGER) AS x, TRY_CAST(nullif(regexp_extract(b, '^over-(\\d+)$', 1), '') AS INTEGER) AS y FROM l)
SELECT place, CASE WHEN x IS NOT NULL OR y IS NOT NULL THEN greatest(coalesce(x, y), coalesce(y, x)) WHEN coalesce(a = 'kid-friendly', false) OR b = 'fun-for-all' THEN 0 END AS least FROM n""")
def category_heights(spark, sf):
    labelled = spark.sql(_LABELS.replace("FROM q", "FROM {q}"), q=_view(spark, sf, V.PLACE))
    return labelled.select("place", N.category_height(F.array_compact(F.array("a", "b"))).alias("least"))


_REQUIRED = "SELECT place % 20 AS venue, CASE WHEN place % 20 = 7 THEN NULL ELSE p_size END AS key FROM q"
_DECIDED = "SELECT place % 20 AS venue, p_size AS key, CASE WHEN place % 20 = 3 AND p_size = 11 THEN 'reject' WHEN place % 20 <> 5 OR p_size > 4 THEN 'approve' ELSE 'defer' END AS decision FROM q"


@_query(_with(q=V.PLACE) + f""", r AS ({_REQUIRED}), d AS ({_DECIDED}), a AS (SELECT DISTINCT venue, key FROM d WHERE decision = 'approve'),
o AS (SELECT r.venue, count(*) FILTER (r.key IS NOT NULL AND a.key IS NULL) AS awaiting FROM r LEFT JOIN a ON r.venue = a.venue AND r.key = a.key GROUP BY r.venue), x AS (SELECT venue, count(*) AS rejected FROM d WHERE decision = 'reject' GROUP BY venue)
SELECT venue, coalesce(rejected, 0) = 0 AND awaiting = 0 AS pass, CASE WHEN coalesce(rejected, 0) > 0 THEN 'rejected' WHEN awaiting > 0 THEN 'awaiting approval' END AS reason, coalesce(rejected, 0) AS rejected, awaiting FROM o LEFT JOIN x USING (venue)""")
def review_gate(spark, sf):
    places = _view(spark, sf, V.PLACE)
    return U.review_gate(*(spark.sql(x.replace("FROM q", "FROM {q}"), q=places) for x in (_REQUIRED, _DECIDED)))


_RINGS = "SELECT p_size AS venue, place AS id, place % 4 = 0 AS named, place % 6 = 0 AS tagged, place * 31 % 1000 AS area FROM q"


@_query(_with(q=V.PLACE) + f", b AS ({_RINGS}) SELECT venue, id FROM b QUALIFY row_number() OVER (PARTITION BY venue ORDER BY named AND tagged DESC, named DESC, area DESC, id) = 1")
def boundary_choice(spark, sf):
    return U.boundary(spark.sql(_RINGS.replace("FROM q", "FROM {q}"), q=_view(spark, sf, V.PLACE)), ["venue"]).select("venue", "id")


_COUNTS = "SELECT p_size AS venue, count(*) AS rides, count(*) FILTER (place % 2 = 0) AS ways FROM q {w} GROUP BY p_size"


@_query(_with(q=V.PLACE) + f""", c AS ({_COUNTS.format(w='')}), a AS ({_COUNTS.format(w='WHERE place % 37 > 1')}), u AS (SELECT coalesce(c.venue, a.venue) AS venue, 'rides' AS field, coalesce(c.rides, 0) AS claimed, coalesce(a.rides, 0) AS actual, 2 AS slack FROM c FULL JOIN a USING (venue) UNION ALL SELECT coalesce(c.venue, a.venue), 'ways', coalesce(c.ways, 0), coalesce(a.ways, 0), 0 FROM c FULL JOIN a USING (venue))
SELECT venue, field, claimed, actual FROM u WHERE abs(claimed - actual) > slack""")
def manifest_differences(spark, sf):
    places = _view(spark, sf, V.PLACE)
    counted = lambda df: df.groupBy(F.col("p_size").alias("venue")).agg(F.count("*").alias("rides"), F.count_if(F.col("place") % 2 == 0).alias("ways"))
    return U.manifest_differences(counted(places), counted(places.where("place % 37 > 1")), ["venue"], {"rides": 2, "ways": 0})


@_query(_with(q=V.PLACE) + "SELECT place AS id, p_size AS rank FROM q WHERE p_size BETWEEN 5 AND 30 AND place % 9 <> 0 AND place NOT IN (SELECT place FROM q WHERE place % 4 = 0)")
def catalogue_selection(spark, sf):
    places = _view(spark, sf, V.PLACE)
    rows = places.selectExpr("place id", "p_size rank", "place % 9 = 0 skip")
    return U.selected(rows, places.where("place % 4 = 0").selectExpr("place id"), first=5, last=30).select("id", "rank")


@_query(_with(r=V.REPORT) + f""", l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ride, party ORDER BY seq DESC) = 1) SELECT ride, party, seq FROM l WHERE seq % 6 > 0 AND {_NOW} - ms <= 864000000""")
def live_reports(spark, sf):
    rows = _view(spark, sf, V.REPORT).selectExpr("ride", "party", "seq", "ms", "case when seq % 6 > 0 then status end status")
    return U.live_reports(rows, ["ride", "party"], "seq", _NOW, 864000000).select("ride", "party", "seq")


@_query(_with(f=V.FIX) + f"""SELECT device, max(ms) AS last_seen FROM f GROUP BY device HAVING device % 10 = 0 OR {_NOW} - max(ms) <= 86400000""")
def live_members(spark, sf):
    members = _view(spark, sf, V.FIX).groupBy("device").agg(F.max("ms").alias("last_seen")).withColumn("device_less", F.col("device") % 10 == 0)
    return U.live_members(members, _NOW, 86400000).select("device", "last_seen")


_POIS = "SELECT place, CASE WHEN place % 4 = 0 THEN 'k' || place END AS k, CASE place % 3 WHEN 0 THEN 'i' || place WHEN 1 THEN '' END AS i, name, CASE WHEN place % 5 > 0 THEN p_size END AS lat FROM q"


@_query(_with(q=V.PLACE) + f", p AS ({_POIS}) SELECT place, coalesce(nullif(k, ''), nullif(i, ''), name || '@' || lat || ',' || lat, name, '') AS identity FROM p")
def identities(spark, sf):
    pois = spark.sql(_POIS.replace("FROM q", "FROM {q}"), q=_view(spark, sf, V.PLACE))
    return pois.select("place", N.identity(F.col("k"), F.col("i"), F.col("name"), F.col("lat"), F.col("lat")).alias("identity"))


@_query(_with(q=V.PLACE) + "SELECT place, CASE WHEN place % 3 > 0 THEN CASE WHEN contains(name, 'tin') THEN name ELSE name || ' · tin' END WHEN place % 6 = 0 THEN category || ' · tin' ELSE 'tin' END AS credit FROM q")
def credit_lines(spark, sf):
    own, other = F.when(F.col("place") % 3 > 0, F.col("name")).otherwise(" "), F.when(F.col("place") % 6 == 0, F.col("category"))
    return _view(spark, sf, V.PLACE).select("place", N.credit_line(own, other, F.lit("tin")).alias("credit"))


@_query(_with(q=V.PLACE) + "SELECT place, k, v FROM (SELECT place, 'name' AS k, CASE WHEN place % 2 = 0 THEN upper(name) ELSE name END AS v FROM q UNION ALL SELECT place, 'size', CAST(p_size AS VARCHAR) FROM q UNION ALL SELECT place, 'note', 'seen' FROM q WHERE place % 2 = 0)")
def patched_facts(spark, sf):
    left = F.create_map(F.lit("name"), F.col("name"), F.lit("size"), F.col("p_size").cast("string"))
    right = F.when(F.col("place") % 2 == 0, F.create_map(F.lit("name"), F.upper("name"), F.lit("note"), F.lit("seen")))
    return _view(spark, sf, V.PLACE).select("place", F.explode(N.merged(left, right)).alias("k", "v"))
