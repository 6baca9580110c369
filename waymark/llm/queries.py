"""The queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, importance, language_mixture, license_scan, packing, periodic_runs, quality_classifier, quality_rules, simhash, substring_dedup, token_count, url_filter
from .common import table

#: Vocabulary that op6 counts with, by its name among the public tokenizers.
TOKENIZER = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    clash = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", clash), (-7, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digest_conversations(chat_format.format_turns(turns))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(periodic_runs.planted(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_simhash, op4_licenses, op5_urls, op6_tokens, op7_quality_rules, op8_substring_dedup, op9_classifier, op10_chat, op11_importance, op12_languages, op13_periodic_runs)}

_WORDS = [(name, license_scan.words_in(text)) for name, text in license_scan.TEMPLATES]
_SIZES = license_scan.window_sizes([len(words) for _, words in _WORDS])

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op4_licenses": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
t(license, words, n) AS (VALUES """
    + ", ".join(f"('{name}', '{' '.join(words)}', {_SIZES[len(words)]})" for name, words in _WORDS)
    + r"""),
ts AS (SELECT license, n, s FROM (SELECT license, words, n, unnest(list_transform(range(1, greatest(2, len(string_split(words, ' ')) - 3)), lambda i: array_to_string(string_split(words, ' ')[i : i + 4], ' '))) AS s FROM t)),
tn AS (SELECT license, n, n + greatest(1, n // 8) AS size, greatest(1, n // 8) AS step, count(DISTINCT s) AS k FROM ts GROUP BY ALL),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i : i + 4], ' ') AS s FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS r(i) WHERE len(w) > 0),
met AS (SELECT DISTINCT doc_id, license, s, i FROM ds JOIN (SELECT DISTINCT license, s FROM ts) USING (s)),
win AS (SELECT doc_id, license, start, count(DISTINCT s) AS got, any_value(k) AS k FROM met JOIN tn USING (license), unnest(range(greatest(0, i - size), i + 1)) AS r(start) WHERE start % step = 0 AND i + 5 <= start + size GROUP BY ALL),
best AS (SELECT doc_id, license, min(start) AS start FROM win WHERE got * 5 >= k * 4 GROUP BY ALL),
lists AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS l, min(start) AS f FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(l, '') AS licenses, CAST(coalesce(f, -1) AS INTEGER) AS first_start FROM d LEFT JOIN lists USING (doc_id)""",
    "op5_urls": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(action, h, p) AS (VALUES """
    + ", ".join(map(str, url_filter.RULES))
    + r""")
SELECT page_id, host, path, arg_max(h || p, len(h || p)) AS rule, coalesce(arg_max(action, len(h || p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path""",
    "op11_importance": r"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
split AS (
  SELECT 1 AS own, doc_id AS id, text FROM documents UNION ALL
  SELECT 2, CAST(row_number() OVER () AS BIGINT), text FROM benchmark),
ws AS (SELECT own, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM split),
f AS (
  SELECT own, id, unnest(w) AS f FROM ws UNION ALL
  SELECT own, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ws),
hex AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
bytes AS (SELECT f, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i : i + 1] AS BIGINT))) AS b FROM hex),
b AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
counts AS (SELECT bucket, count(*) FILTER (own = 1) AS s, count(*) FILTER (own = 2) AS t FROM f JOIN b USING (f) GROUP BY bucket),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g FROM counts, sums),
sized AS (SELECT id AS doc_id, len(w) AS n FROM ws WHERE own = 1),
weighed AS (SELECT id AS doc_id, count(*) AS m, sum(g) AS g FROM f JOIN b USING (f) JOIN gain USING (bucket) WHERE own = 1 GROUP BY id),
scored AS (
  SELECT doc_id, n, CAST(coalesce(m, 0) AS BIGINT) AS n_features, CAST(coalesce((g - ((g % m) + m) % m) // m, 0) AS BIGINT) AS weight,
    (CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296 AS u FROM sized LEFT JOIN weighed USING (doc_id)),
final AS (SELECT doc_id, n, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS k FROM final WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * k // 100 THEN r END AS rank FROM final LEFT JOIN ranked USING (doc_id)""",
}
