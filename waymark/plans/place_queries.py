"""Queries of the place, movement and evidence operators, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ops as O
from ..operators import spatial as S
from ..operators import venues as U
from . import views as V
from .registry import ORACLES, QUERIES, query as _query, table as _table, view as _view, with_views as _with  # noqa: F401

_NOW = 1706400000000  # 2024-01-28, in ms


@_query(_with(f=V.FIX) + """, g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY device ORDER BY seq) AS dt FROM f),
s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt < 0 OR dt >= 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT CAST(floor(lat * 110540 / 200) AS BIGINT) AS cell_lat, CAST(floor(lng * 111320 / 200) AS BIGINT) AS cell_lng, count(*) AS n_fixes, count(DISTINCT (device, session)) AS n_sessions, min(seq) AS sample_seq FROM s GROUP BY 1, 2""")
def trace_cell_clusters(spark, sf):
    return O.cell_clusters(O.sessions(_view(spark, sf, V.FIX), "device", "ms", "seq", 12 * 3600 * 1000), 200.0)


@_query(_with(c=V.CONTRIBUTION) + "SELECT id, author, place, kind FROM c WHERE status = 'accepted' AND length(kind) > 0 AND kind NOT IN ('experience', 'status', 'queue_band', 'ride_status')")
def accepted_durable(spark, sf):
    return O.durable_accepted(_view(spark, sf, V.CONTRIBUTION)).select("id", "author", "place", "kind")


@_query(_with(c=V.CONTRIBUTION) + "SELECT kind, place, id, author FROM c QUALIFY row_number() OVER (PARTITION BY kind, place ORDER BY ms DESC, id DESC) = 1")
def latest_per_place(spark, sf):
    return O.latest(_view(spark, sf, V.CONTRIBUTION), ["kind", "place"], [F.desc("ms"), F.desc("id")]).select("kind", "place", "id", "author")


@_query(_with(c=V.CONTRIBUTION) + "SELECT author, id, place FROM c QUALIFY row_number() OVER (PARTITION BY author ORDER BY id DESC) <= 20")
def keep_newest(spark, sf):
    return O.newest(_view(spark, sf, V.CONTRIBUTION), ["author"], [F.desc("id")], 20).select("author", "id", "place")


@_query(_with(r=V.REPORT) + f"SELECT ride, count(DISTINCT party) AS witnesses, count(*) AS n FROM r WHERE status = 'down' AND {_NOW} - ms BETWEEN 0 AND 1209600000 GROUP BY ride HAVING count(DISTINCT party) >= 2")
def park_wide_down(spark, sf):
    fresh = _view(spark, sf, V.REPORT).where((F.col("status") == "down") & F.col("ms").between(_NOW - 1209600000, _NOW))
    return O.independent(fresh, ["ride"], "party", 2)


@_query(_with(c=V.CLAIM) + """, v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY feature_id, source ORDER BY seq) = 1),
a AS (SELECT feature_id, lat AS a_lat, lng AS a_lng, weight AS a_weight, source AS anchor FROM v WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY weight DESC, seq) = 1),
j AS (SELECT v.*, a_weight, anchor, lat IS NULL OR sqrt(pow((lat - a_lat) * 110540, 2) + pow((lng - a_lng) * 111320 * cos(radians(a_lat)), 2)) <= 20 AS agrees FROM v JOIN a USING (feature_id)),
o AS (SELECT feature_id, anchor, a_weight, CAST(sum(CASE WHEN agrees THEN weight ELSE 0 END) AS BIGINT) AS agreed, count(*) FILTER (NOT agrees) AS dissenting, bool_or(NOT agrees AND weight >= a_weight) AS conflict FROM j GROUP BY 1, 2, 3)
SELECT feature_id, anchor, dissenting, conflict, CASE WHEN conflict THEN a_weight ELSE agreed END AS score FROM o""")
def fused_claims(spark, sf):
    return O.fused(_view(spark, sf, V.CLAIM))


@_query(_with(c=V.CLAIM) + "SELECT feature_id, CAST(max(shipped) AS VARCHAR)[1:10] AS newest, max(shipped) < TIMESTAMP '1998-01-01' AS stale FROM c GROUP BY feature_id")
def stale_features(spark, sf):
    return _view(spark, sf, V.CLAIM).groupBy("feature_id").agg(F.max("shipped").alias("m")).select("feature_id", F.date_format("m", "yyyy-MM-dd").alias("newest"), (F.col("m") < F.expr("timestamp_ntz'1998-01-01'")).alias("stale"))


@_query(_with(p=V.PERSON, q=V.PLACE) + """, v AS (SELECT party, place, person, CASE WHEN height IS NULL THEN 'eligible' WHEN lowest IS NULL AND alone IS NULL AND highest IS NULL THEN 'unknown' WHEN height > highest THEN 'no' WHEN height < lowest THEN 'no' WHEN height < alone THEN CASE WHEN with_adult THEN 'companion' ELSE 'no' END ELSE 'eligible' END AS verdict FROM p JOIN q ON q.place % 25 = p.party)
SELECT party, place, count(*) FILTER (verdict = 'no') AS n_no, count(*) FILTER (verdict = 'companion') AS n_companion, arg_min(verdict, CASE verdict WHEN 'no' THEN 0 WHEN 'companion' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END) AS strictest FROM v GROUP BY party, place""")
def eligibility_matrix(spark, sf):
    kinds = _view(spark, sf, V.PERSON).groupBy("party", "height", "with_adult").agg(F.count("*").alias("n"))  # a verdict knows no more of a person
    pairs = kinds.join(_view(spark, sf, V.PLACE), F.col("place") % 25 == F.col("party")).withColumn("verdict", O.verdict(F.col("height"), F.col("with_adult"), F.col("lowest"), F.col("alone"), F.col("highest")))
    _of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    rank = F.expr("case verdict when 'no' then 0 when 'companion' then 1 when 'unknown' then 2 else 3 end")
    return pairs.groupBy("party", "place").agg(_of("no").alias("n_no"), _of("companion").alias("n_companion"), F.min_by("verdict", rank).alias("strictest"))


_NEAR = "sqrt(pow((r_lat - lat) * 110540, 2) + pow((r_lng - lng) * 111320 * cos(radians(lat)), 2))"


@_query(_with(f=V.FIX, q=V.PLACE) + f"SELECT seq, place, floor(round({_NEAR}, 4) * 100 + 0.5) / 100 AS metres FROM f JOIN q ON {_NEAR} < 75 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY round({_NEAR}, 4), place) = 1")
def nearest_place(spark, sf):
    fixes = _view(spark, sf, V.FIX).select("seq", "lat", "lng")
    places = _view(spark, sf, V.PLACE).select("place", "r_lat", "r_lng")
    return S.nearest(fixes, places, "seq", 75.0).select("seq", "place", X.half_up(F.col("metres"), 2).alias("metres"))


@_query(_with(f=V.FIX, q=V.PLACE) + f"SELECT place, count(*) AS n_near, count(DISTINCT device) AS n_devices FROM f JOIN q ON {_NEAR} <= 50 GROUP BY place")
def radius_members(spark, sf):
    fixes = _view(spark, sf, V.FIX).select("device", "lat", "lng")
    return U.near_counts(fixes, _view(spark, sf, V.PLACE).select("place", "r_lat", "r_lng"), "device", 50.0, inclusive=True)


@_query(_with(f=V.FIX) + "SELECT device, seq FROM f QUALIFY ms > coalesce(max(ms) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")
def monotone_fixes(spark, sf):
    return O.monotone(_view(spark, sf, V.FIX), "device", "seq", "ms").select("device", "seq")


@_query(_with(f=V.FIX) + "SELECT device, seq, CAST(floor(ms / 86400000) AS BIGINT) AS bucket FROM f QUALIFY row_number() OVER (PARTITION BY device, CAST(floor(ms / 86400000) AS BIGINT) ORDER BY seq) <= 2")
def rate_limit_buckets(spark, sf):
    return O.rate_limited(_view(spark, sf, V.FIX), "device", "ms", "seq", 86400000, 2).select("device", "seq", "bucket")


@_query(_with(f=V.FIX) + """, c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(seq) OVER w IS NOT NULL THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY device ORDER BY seq)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c),
s AS (SELECT device, island, event_type, min(ms) AS from_ms, max(ms) AS to_ms, count(*) AS samples FROM i GROUP BY 1, 2, 3)
SELECT device, event_type, from_ms, to_ms, samples FROM s WHERE to_ms - from_ms >= 45000 AND samples >= 3 QUALIFY row_number() OVER (PARTITION BY device, event_type ORDER BY island) = 1""")
def dwell_islands(spark, sf):
    return O.dwells(_view(spark, sf, V.FIX), ["device"], "seq", "ms", "event_type", 45000, 3).select("device", "event_type", "from_ms", "to_ms", "samples")


@_query(_with(f=V.FIX) + """, p AS (SELECT *, lag(lat) OVER w AS b_lat, lag(lng) OVER w AS b_lng FROM f WINDOW w AS (PARTITION BY device ORDER BY seq))
SELECT device, floor(coalesce(sum(2 * 6371000 * asin(sqrt(pow(sin(radians(lat - b_lat) / 2), 2) + cos(radians(b_lat)) * cos(radians(lat)) * pow(sin(radians(lng - b_lng) / 2), 2)))), 0) * 100 + 0.5) / 100 AS metres, count(*) AS n_fixes FROM p GROUP BY device""")
def walk_lengths(spark, sf):
    return O.walk_lengths(_view(spark, sf, V.FIX), "device", "seq")


@_query(_with(r=V.REPORT) + f", l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ride ORDER BY ms DESC, seq DESC) = 1) SELECT k AS ride, coalesce(CASE WHEN status = 'down' THEN 'reported down' WHEN {_NOW} - ms > 1800000 THEN 'stale' ELSE status END, 'no report') AS live FROM range(50) t(k) LEFT JOIN l ON l.ride = k")
def ride_status(spark, sf):
    last = O.latest(_view(spark, sf, V.REPORT), ["ride"], [F.desc("ms"), F.desc("seq")])
    live = F.when(F.col("status") == "down", "reported down").when(_NOW - F.col("ms") > 1800000, "stale").otherwise(F.col("status"))
    return spark.range(50).withColumnRenamed("id", "ride").join(last, "ride", "left").select("ride", F.coalesce(live, F.lit("no report")).alias("live"))


@_query(_with(q=V.PLACE) + "SELECT place, name FROM q WHERE regexp_matches(lower(name), '\\bwid') OR contains(lower(category), 'econ')")
def search_places(spark, sf):
    return _view(spark, sf, V.PLACE).where(F.lower("name").rlike(r"\bwid") | F.contains(F.lower("category"), F.lit("econ"))).select("place", "name")


@_query(_with(q=V.PLACE) + "SELECT category, count(*) AS n, count(highest) AS n_highest, count(alone) AS n_alone, count(*) - count(alone) AS n_owed FROM q GROUP BY category")
def height_gaps(spark, sf):
    return _view(spark, sf, V.PLACE).groupBy("category").agg(F.count("*").alias("n"), F.count("highest").alias("n_highest"), F.count("alone").alias("n_alone"), F.count_if(F.col("alone").isNull()).alias("n_owed"))


@_query("SELECT p_type AS category, p_brand AS brand, count(*) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) = 1")
def class_dominant(spark, sf):
    return O.dominant(_table(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("brand")), ["category"], "brand")


@_query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def set_difference(spark, sf):
    orders = _table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(orders, "k", "left_anti")


@_query("SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2")
def drift_except(spark, sf):
    rows = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), "l_linenumber")
    return rows.where("l_linenumber <= 3").drop("l_linenumber").exceptAll(rows.where("l_linenumber = 2").drop("l_linenumber"))


@_query(_with(c=V.CONTRIBUTION) + "SELECT DISTINCT ON (place, author) place, author, id FROM c WHERE kind IN ('height', 'amenity') ORDER BY place, author, ms DESC, id DESC")
def union_latest(spark, sf):
    c = _view(spark, sf, V.CONTRIBUTION)
    return O.latest(c.where("kind = 'height'").unionByName(c.where("kind = 'amenity'")), ["place", "author"], [F.desc("ms"), F.desc("id")]).select("place", "author", "id")


@_query("""SELECT 'orders_without_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order_key_repeats', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'bad_discount', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1""")
def quality_checks(spark, sf):
    orders, items, people = (_table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    found = {
        "orders_without_customer": orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "order_key_repeats": orders.groupBy("o_orderkey").count().where("count > 1"),
        "lineitem_without_order": items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "bad_discount": items.where("l_discount < 0 or l_discount > 1"),
    }
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query(_with(q=V.PLACE) + """SELECT place, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(p_size & 7 AS INTEGER) AS flags, p_size & 2 = 2 AS bridge, CASE WHEN p_size & 24 = 24 THEN 0 WHEN p_size & 8 = 8 THEN 1 WHEN p_size & 16 = 16 THEN -1 ELSE 0 END AS direction FROM q""")
def place_flags(spark, sf):
    size = F.col("p_size")
    way = F.when(X.has_flag(size, 8) & X.has_flag(size, 16), 0).when(X.has_flag(size, 8), 1).when(X.has_flag(size, 16), -1).otherwise(0)
    return _view(spark, sf, V.PLACE).select("place", X.slug(F.col("name")).alias("slug"), size.bitwiseAND(7).alias("flags"), X.has_flag(size, 2).alias("bridge"), way.alias("direction"))


@_query(_with(q=V.PLACE) + ", n AS (SELECT lower(name) AS k, count(*) AS c, min(place) AS target FROM q GROUP BY 1) SELECT place, CASE WHEN c = 1 THEN target END AS target FROM q JOIN n ON n.k = lower(q.name)")
def unique_name_targets(spark, sf):
    places = _view(spark, sf, V.PLACE).select("place", F.lower("name").alias("k"))
    return places.join(O.unique_names(places, "k", "place").withColumnRenamed("place", "target"), "k", "left").select("place", "target")


@_query("SELECT page_id, count(DISTINCT u) AS n_links, min(u) AS first_link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS u FROM pages) GROUP BY page_id")
def page_assets(spark, sf):
    links = _table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1))).alias("u"))
    return links.groupBy("page_id").agg(F.countDistinct("u").alias("n_links"), F.min("u").alias("first_link"))


@_query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def conversation_fold(spark, sf):
    return _table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.max_by("role", "turn").alias("last_role"))


@_query("SELECT l_orderkey AS way, count(*) AS n, count(*) FILTER (l_linenumber & 1 = 1) AS n_steps, floor(sum(l_quantity) * 10 + 0.5) / 10 AS length FROM lineitem GROUP BY 1")
def coverage_rollup(spark, sf):
    return _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.count("*").alias("n"), F.count_if(X.has_flag(F.col("l_linenumber"), 1)).alias("n_steps"), X.half_up(F.sum("l_quantity"), 1).alias("length"))


@_query()
def thinned_fixes(spark, sf):
    return O.thinned(_view(spark, sf, V.FIX).select("device", "seq", "lat", "lng"), "device", "seq", 80.0)
