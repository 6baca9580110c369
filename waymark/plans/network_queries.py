"""Queries of graphs, height grids and folds over fixes, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import rules as R
from ..operators import folds, graph, party, raster
from ..operators import ops as O
from ..operators.ops import W
from ..runtime import shared_folder
from ..sources import tables
from . import views as V
from .registry import ORACLES, query, table, view, with_views


def _edges(spark, sf):
    return view(spark, sf, V.EDGE)


def _checkpointed(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@query(with_views(e=V.EDGE).replace("WITH", "WITH RECURSIVE", 1) + ", g AS (SELECT DISTINCT venue, a, b FROM e UNION SELECT DISTINCT venue, b, a FROM e), r AS (SELECT DISTINCT venue, a AS node, a AS label FROM g UNION SELECT r.venue, g.b, r.label FROM r JOIN g ON g.venue = r.venue AND g.a = r.node) SELECT venue, node, min(label) AS component FROM r GROUP BY 1, 2")
def graph_components(spark, sf):
    _checkpointed(spark)
    return graph.components(_edges(spark, sf))


@query()
def graph_routes(spark, sf):
    ends = _edges(spark, sf).groupBy("venue").agg(F.min("a").alias("origin"), F.max("b").alias("target"))
    return graph.routes(_edges(spark, sf), ends, 2).select("venue", "origin", "target", X.half_up(F.col("metres"), 3).alias("metres"), F.size("path").alias("n_nodes"))


@query("""WITH l AS (SELECT c_nationkey AS party, c_custkey AS member, p_partkey AS candidate, abs(c_custkey * 37 % 500 - p_partkey * 53 % 500) AS metres FROM customer JOIN part ON p_partkey % 25 = c_nationkey), s AS (SELECT party, candidate, max(metres) AS longest, CAST(sum(metres) AS BIGINT) AS total FROM l GROUP BY 1, 2)
SELECT party, candidate, longest, total FROM s QUALIFY row_number() OVER (PARTITION BY party ORDER BY longest, total, candidate) = 1""")
def meeting_points(spark, sf):
    """Positions meet instead of rows: members of one position share a leg, and of candidates at one position the least wins."""
    people = table(spark, sf, "customer").select(F.col("c_nationkey").alias("party"), (F.col("c_custkey") * 37 % 500).alias("member"))
    places = table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("party"), (F.col("p_partkey") * 53 % 500).alias("at"), "p_partkey")
    legs = people.groupBy("party", "member").agg(F.count("*").alias("n")).join(places.groupBy("party", "at").agg(F.min("p_partkey").alias("candidate")), "party")
    return graph.meeting_point(legs.withColumn("metres", F.abs(F.col("member") - F.col("at"))), F.col("n"))


_SLOPES = """, s AS (SELECT *, coalesce((coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / nullif((coalesce(lead(col) OVER x, col) - coalesce(lag(col) OVER x, col)) * 10.0, 0), 0) AS dx, -coalesce((coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / nullif((coalesce(lead(row) OVER y, row) - coalesce(lag(row) OVER y, row)) * 10.0, 0), 0) AS dy FROM g WINDOW x AS (PARTITION BY venue, row ORDER BY col), y AS (PARTITION BY venue, col ORDER BY row))"""


@query(with_views(g=V.GRID) + _SLOPES + " SELECT venue, row, col, floor(greatest(0, (-dx * sin(radians(315)) * cos(radians(45)) - dy * cos(radians(315)) * cos(radians(45)) + sin(radians(45))) / sqrt(dx * dx + dy * dy + 1)) * 1e6 + 0.5) / 1e6 AS shade FROM s")
def hillshade(spark, sf):
    return raster.hillshade(view(spark, sf, V.GRID), 10.0).select("venue", "row", "col", X.half_up(F.col("shade"), 6).alias("shade"))


@query(with_views(f=V.FIX, g=V.GRID) + ", p AS (SELECT seq, 0 AS venue, (seq % 67) / 4.0 AS x, (seq % 23) / 8.0 AS y FROM f), m AS (SELECT seq, z, (1 - abs(y - row)) * (1 - abs(x - col)) AS w FROM p JOIN g ON g.venue = p.venue AND row IN (floor(y), floor(y) + 1) AND col IN (floor(x), floor(x) + 1)) SELECT seq, floor(sum(z * w) / nullif(sum(w), 0) * 1e4 + 0.5) / 1e4 AS z FROM m GROUP BY seq")
def terrain_samples(spark, sf):
    points = view(spark, sf, V.FIX).selectExpr("seq", "0 as venue", "cast((seq % 67) / 4.0 as double) x", "cast((seq % 23) / 8.0 as double) y")
    return raster.bilinear(points, view(spark, sf, V.GRID)).select("seq", X.half_up(F.col("z"), 4).alias("z"))


@query("SELECT p_type AS venue, p_size % 5 AS class, count(*) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size % 5) = 1")
def zonal_class(spark, sf):
    return raster.dominant_class(table(spark, sf, "part").select(F.col("p_type").alias("venue"), (F.col("p_size") % 5).alias("class")), "venue")


def _typed(spark, sf):
    return view(spark, sf, V.FIX).selectExpr("device", "seq", "ms", "cast(lat as double) lat", "cast(lng as double) lng", "event_type as target", "cast(seq * 29 % 360 as double) heading", "cast(5 + seq % 40 as double) acc")


@query()
def send_gate(spark, sf):
    return folds.fold(_typed(spark, sf), ["device"], ["seq"], folds.send_gate(), "why", "string").select("device", "seq", "why")


@query()
def smoothed_fixes(spark, sf):
    return folds.fold(_typed(spark, sf), ["device"], ["seq"], folds.smooth(), "estimate", "string").select("device", "seq", "estimate")


@query(with_views(f=V.FIX) + ", n AS (SELECT device, seq, ms, max(ms) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f) SELECT device, seq FROM n WHERE b IS NULL OR ms > b")
def monotone_fold(spark, sf):
    return folds.fold(_typed(spark, sf), ["device"], ["seq"], folds.newer(), "_k", "boolean").select("device", "seq")


@query(with_views(f=V.FIX) + ", n AS (SELECT device, seq, ms - lag(ms) OVER (PARTITION BY device ORDER BY seq) AS d FROM f) SELECT device, seq, CAST(sum(CASE WHEN d IS NULL OR d < 0 OR d >= 900000 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n")
def session_numbers(spark, sf):
    return folds.fold(_typed(spark, sf), ["device"], ["seq"], folds.session_number(900_000), "session", "long").select("device", "seq", "session")


@query(with_views(f=V.FIX) + "SELECT device, seq, ms FROM f WHERE 1706400000000 - ms BETWEEN 0 AND 864000000 QUALIFY row_number() OVER (PARTITION BY device ORDER BY ms DESC, seq DESC) <= 24")
def retained_log(spark, sf):
    log = view(spark, sf, V.FIX).where("ms <= 1706400000000")
    return tables.retained(log, "device", "ms", 1706400000000, 24, 10 * 86_400_000, "seq").select("device", "seq", "ms")


@query(with_views(f=V.FIX) + "SELECT device, seq FROM f WHERE seq > device * 3")
def mailbox_after_cursor(spark, sf):
    log = view(spark, sf, V.FIX).select("device", "seq")
    cursors = log.select("device", (F.col("device") * 3).alias("cursor")).distinct()
    return tables.after_cursor(log, cursors, "device", "seq").select("device", "seq")


@query("SELECT DISTINCT sha256(p_name || p_brand) AS key FROM part WHERE sha256(p_name || p_brand) NOT IN (SELECT sha256(p_name || p_brand) FROM part WHERE p_size < 10)")
def cache_misses(spark, sf):
    asked = table(spark, sf, "part").select(F.col("p_name").alias("prompt"), F.col("p_brand").alias("model"), "p_size")
    cache = asked.where("p_size < 10").select(tables.cache_key(F.col("prompt"), F.col("model")).alias("key")).distinct()
    return tables.cache_misses(asked, cache).select("key")


@query("SELECT coalesce(h.k, w.k) AS path, CASE WHEN w.k IS NULL THEN 'drop' WHEN h.v = w.v THEN 'keep' ELSE 'fetch' END AS action FROM (SELECT CAST(p_partkey AS VARCHAR) AS k, p_brand AS v FROM part WHERE p_size < 30) h FULL JOIN (SELECT CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS v FROM part WHERE p_size > 10) w ON h.k = w.k")
def bundle_plan(spark, sf):
    part = table(spark, sf, "part").withColumn("path", F.col("p_partkey").cast("string"))
    wanted = part.where("p_size > 10").select("path", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("sha256"))
    return tables.bundle_plan(part.where("p_size < 30").select("path", F.col("p_brand").alias("sha256")), wanted)


@query(with_views(f=V.FIX) + "SELECT device, seq, '{\"type\":\"Feature\",\"properties\":{\"device\":' || device || ',\"seq\":' || seq || '},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || (seq % 9 + 0.5)::DOUBLE || ',' || (seq % 7 + 0.25)::DOUBLE || ']}}' AS value FROM f")
def geojson_features(spark, sf):
    rows = view(spark, sf, V.FIX).withColumn("line", F.array(F.struct((F.col("seq") % 7 + 0.25).cast("double").alias("lat"), (F.col("seq") % 9 + 0.5).cast("double").alias("lng"))))
    return rows.select("device", "seq", tables.feature("line", "device", "seq").alias("value"))


@query(with_views(f=V.FIX) + ", s AS (SELECT device, seq, value - lag(value) OVER w AS rise FROM f WINDOW w AS (PARTITION BY device ORDER BY seq)), k AS (SELECT device, seq, CASE WHEN rise > 40 THEN 'climb' WHEN rise < -40 THEN 'drop' ELSE 'flat' END AS kind FROM s WHERE rise IS NOT NULL), c AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY device ORDER BY seq) AS fresh FROM k) SELECT device, kind, count(*) FILTER (fresh) AS n_runs, count(*) AS n_edges FROM c GROUP BY 1, 2")
def line_runs(spark, sf):
    w = W.partitionBy("device").orderBy("seq")
    rise = view(spark, sf, V.FIX).select("device", "seq", (F.col("value") - F.lag("value").over(w)).alias("rise")).where("rise is not null")
    kind = rise.select("device", "seq", F.when(F.col("rise") > 40, "climb").when(F.col("rise") < -40, "drop").otherwise("flat").alias("kind"))
    runs = kind.withColumn("fresh", ~F.col("kind").eqNullSafe(F.lag("kind").over(w)))
    return runs.groupBy("device", "kind").agg(F.count_if("fresh").alias("n_runs"), F.count("*").alias("n_edges"))


_MOVED = (
    ", n AS (SELECT device, seq, CASE WHEN seq % 4 = 0 THEN value / 400 END AS speed, seq % 9 = 0 AS background, ms - lag(ms) OVER w AS gap, "
    "2 * 6371000 * asin(sqrt(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lng - lag(lng) OVER w) / 2), 2))) AS metres, "
    "CASE WHEN seq % 3 > 0 THEN value / 500 END AS battery, seq % 5 = 0 AS charging FROM f WINDOW w AS (PARTITION BY device ORDER BY seq)), "
    "k AS (SELECT *, CASE WHEN background THEN 'background' WHEN coalesce(speed, CASE WHEN gap >= 750 THEN metres / (gap / 1000.0) END) >= 0.35 THEN 'walking' ELSE 'standing' END AS motion FROM n), "
    "c AS (SELECT *, CASE WHEN battery IS NULL OR charging THEN 0 ELSE greatest(0, least(1, (0.5 - battery) / 0.3)) END AS t FROM k) "
)


@query(with_views(f=V.FIX) + _MOVED + "SELECT device, seq, motion, CAST(floor(CASE motion WHEN 'walking' THEN 3000 + t * 2000 WHEN 'standing' THEN 15000 + t * 15000 ELSE 60000 + t * 60000 END + 0.5) AS BIGINT) AS next_ms FROM c")
def motion_cadence(spark, sf):
    w = W.partitionBy("device").orderBy("seq")
    metres = X.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    f = _typed(spark, sf).join(view(spark, sf, V.FIX).select("seq", "value"), "seq").select("*", metres.alias("metres"), (F.col("ms") - F.lag("ms").over(w)).alias("gap"))
    speed, battery = F.when(F.col("seq") % 4 == 0, F.col("value") / 400), F.when(F.col("seq") % 3 > 0, F.col("value") / 500)
    moved = f.withColumn("motion", R.motion(speed, F.col("seq") % 9 == 0, F.col("metres"), F.col("gap")))
    return moved.select("device", "seq", "motion", R.cadence_ms(F.col("motion"), battery, F.col("seq") % 5 == 0).alias("next_ms"))


@query(ORACLES["monotone_fold"])
def monotone_window(spark, sf):
    return O.monotone(view(spark, sf, V.FIX), "device", "seq", "ms").select("device", "seq")


@query(ORACLES["session_numbers"])
def session_windows(spark, sf):
    return O.sessions(view(spark, sf, V.FIX), "device", "ms", "seq", 900_000).select("device", "seq", F.col("session").cast("long").alias("session"))


@query()
def ride_report_log(spark, sf):
    """Reports by ride in order: which set its status, and which took it back."""
    r = view(spark, sf, V.REPORT).selectExpr("ride", "seq", "ms", "case when seq % 7 > 0 then status end status")
    return folds.fold(r, ["ride"], ["ms", "seq"], folds.reports(), "does", "string").select("ride", "seq", "status", "does")


@query(
    with_views(g=V.GRID)
    + """, e AS (SELECT venue, max(row) + 1 AS high, max(col) + 1 AS wide FROM g GROUP BY venue),
c AS (SELECT venue, r.i AS row, k.i AS col, greatest(0, least(high - 1.0, (r.i + 0.5::DOUBLE) / 12 * high - 0.5)) AS y, greatest(0, least(wide - 1.0, (k.i + 0.5::DOUBLE) / 7 * wide - 0.5)) AS x FROM e, range(12) r(i), range(7) k(i)),
u AS (SELECT venue, row, col, avg(z) AS z FROM g GROUP BY ALL),
m AS (SELECT c.venue, c.row, c.col, z, (1 - abs(y - u.row)) * (1 - abs(x - u.col)) AS w FROM c LEFT JOIN u ON u.venue = c.venue AND u.row IN (floor(y), floor(y) + 1) AND u.col IN (floor(x), floor(x) + 1))
SELECT venue, row, col, floor(coalesce(sum(z * w) / nullif(sum(w), 0), 0) * 1e4 + 0.5) / 1e4 AS z FROM m GROUP BY ALL"""
)
def terrain_grid(spark, sf):
    return raster.resampled(view(spark, sf, V.GRID), 12, 7).select("venue", "row", "col", X.half_up(F.col("z"), 4).alias("z"))


@query()
def party_hosts(spark, sf):
    """Customers of a nation are a party, led by the first of them."""
    people = table(spark, sf, "customer").selectExpr("c_nationkey as party", "concat('m', c_custkey) id", "(c_custkey * 37 % 101) / 100.0D as battery", "cast(c_custkey % 50 as int) join_order", "c_custkey % 13 = 0 as device_less")
    leaders = people.groupBy("party").agg(F.min("id").alias("leader"))
    return party.better_hosts(people.join(leaders, "party"))
