"""Places, fixes, reports, contributions, people and claims, derived from the shared test tables; as SQL for both engines."""

FIX = "SELECT user_id AS device, event_id AS seq, {ms} AS ms, 39.340 + ((event_id * 37) % 1000) / 100000.0 AS lat, -84.268 + ((event_id * 91) % 1000) / 100000.0 AS lng, event_type, value FROM events"
REPORT = "SELECT event_id % 50 AS ride, user_id AS party, CASE event_type WHEN 'error' THEN 'down' ELSE 'open' END AS status, event_id AS seq, {ms} AS ms FROM events WHERE event_type IN ('error', 'view')"
CONTRIBUTION = "SELECT event_id AS id, user_id AS author, event_id % 40 AS place, {ms} AS ms, CASE event_type WHEN 'click' THEN 'height' WHEN 'view' THEN 'amenity' WHEN 'signup' THEN 'geometry' WHEN 'purchase' THEN 'poi_patch' WHEN 'error' THEN 'experience' END AS kind, CASE WHEN value >= 100 THEN 'accepted' ELSE 'pending' END AS status, props AS payload FROM events"
PLACE = "SELECT p_partkey AS place, p_name AS name, p_type AS category, 36 + p_size % 20 AS lowest, CASE WHEN p_size % 3 = 0 THEN 44 + p_size % 20 END AS alone, CASE WHEN p_size % 7 = 0 THEN 76 END AS highest, p_size, 39.340 + ((p_partkey * 53) % 1000) / 100000.0 AS r_lat, -84.268 + ((p_partkey * 71) % 1000) / 100000.0 AS r_lng FROM part"
PERSON = "SELECT c_custkey AS person, c_nationkey AS party, 30 + c_custkey % 45 AS height, c_custkey % 3 <> 0 AS with_adult FROM customer"
CLAIM = "SELECT l_partkey AS feature_id, l_linenumber AS source, CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 25 WHEN 3 THEN 40 WHEN 4 THEN 40 ELSE 15 END AS weight, l_orderkey AS seq, CASE WHEN l_suppkey % 5 > 0 THEN 39.340 + (l_suppkey % 7) / 10000.0 END AS lat, CASE WHEN l_suppkey % 5 > 0 THEN -84.268 + (l_suppkey % 3) / 10000.0 END AS lng, l_shipdate AS shipped FROM lineitem"
WEATHER = "SELECT event_id AS seq, event_id * 7 % 100 AS code, value / 6 AS gust, 50 + value / 5 AS temp, (event_id * 13 % 10) / 100.0 AS precip, event_id * 31 % 101 AS chance, event_type = 'error' AND event_id % 3 = 0 AS lightning FROM events"
AREA = "SELECT n_nationkey AS area, n_name AS area_name, 39.341 + n_nationkey % 5 * 0.002 AS c_lat, -84.267 + n_nationkey * 2 % 9 * 0.001 AS c_lng, 0.0012037 + n_nationkey * 0.0000213 AS r FROM nation"
EDGE = "SELECT user_id AS venue, event_id * 13 % 40 AS a, event_id * 29 % 41 AS b, value AS metres FROM events"
GRID = "SELECT p_size % 2 AS venue, CAST(floor(p_partkey / 20.0) AS BIGINT) AS row, p_partkey % 20 AS col, CAST(p_size * 17 % 50 AS DOUBLE) AS z FROM part"
