"""The queries of the general operators for training data, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.operators.badrows import failed_lines, loaded_lines, reconciled_counts
from seiche.operators.drift import schema_changes, unified_features
from seiche.operators.spikes import implausible
from seiche.operators.stamps import instants, observed_zones, offset_history, zone_evidence
from seiche.streaming.once import message_identity, repeated_deliveries


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(read(spark, sf_dir, "feed_features"))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features under their first names, the properties' texts as sorted JSON."""
    rows = unified_features(read(spark, sf_dir, "feed_features"))
    texts = F.transform(F.array_sort(F.map_keys("properties")), lambda k: F.struct(k.alias("key"), F.col("properties")[k]["text"].alias("value")))
    return rows.select("feature_id", "feed", "file_no", F.to_json(F.map_from_entries(texts)).alias("properties"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(read(spark, sf_dir, "series_epochs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_lines(read(spark, sf_dir, "fps_lines")).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lines(read(spark, sf_dir, "fps_lines"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled_counts(read(spark, sf_dir, "fps_lines"), read(spark, sf_dir, "sil_read_report"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(read(spark, sf_dir, "raw_stamps")).filter("utc_us is not null").select("stamp_id", "utc_us")


def _candidates(stamps: DataFrame) -> list[str]:
    zones = ["UTC", "Europe/Lisbon", "Europe/Berlin", "Europe/Helsinki", "America/New_York", "America/Chicago", "Asia/Kathmandu"]
    return list(dict.fromkeys([*zones, *observed_zones(stamps)]))


def p5_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for the offset history of stamps without a zone, by kind of stamp."""
    stamps = read(spark, sf_dir, "raw_stamps")
    return zone_evidence(stamps, _candidates(stamps))


def p5_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stamps, those without a zone converted by the offset history estimated by quarter of ingestion."""
    stamps = read(spark, sf_dir, "raw_stamps")
    zones = offset_history(zone_evidence(stamps, _candidates(stamps), period="quarter"))
    return instants(stamps, zones=zones).filter("utc_us is not null").select("stamp_id", "utc_us")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_deliveries(spark, f"{sf_dir}/quake_messages.parquet", key=["k_event", "k_instant"], event_time="k_instant", prepare=message_identity)
    return rows.select("delivery_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p2_found, p3_found, p3_loaded, p3_totals, p5_found, p5_zones, p5_estimated, p7_found)}

_BAD_ROWS = r"""
WITH l AS (SELECT line_id, file_path, coalesce(layout = 'csv', FALSE) c, raw_line r FROM fps_lines WHERE raw_line IS NOT NULL AND trim(regexp_replace(raw_line, '\s+', ' ', 'g')) <> '' AND NOT starts_with(raw_line, '#')),
q AS (SELECT line_id, file_path, NOT c OR regexp_full_match(r, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') sound,
  CASE WHEN c THEN list_transform(regexp_extract_all(',' || r, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda f: CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END)
       ELSE string_split_regex(regexp_replace(r, '^\s+|\s+$', '', 'g'), '\s+') END f FROM l),
x AS (SELECT line_id, unnest(f) v, generate_subscripts(f, 1) p, f[23] src FROM q WHERE sound AND len(f) = 33),
n AS (SELECT *, regexp_matches(v, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') num, TRY_CAST(v AS DOUBLE) d, p > 3 AND (regexp_matches(v, '^[*]+$') OR lower(v) = 'nan') miss FROM x),
b AS (SELECT DISTINCT line_id FROM n WHERE NOT coalesce(CASE
  WHEN p = 1 THEN regexp_matches(v, '^[0-9]+$')
  WHEN p = 2 THEN regexp_matches(v, '^[0-9]{8}$') AND try_strptime(v, '%Y%m%d') IS NOT NULL AND substr(v, 1, 4) <> '0000'
  WHEN p = 3 THEN regexp_matches(v, '^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9](\.[0-9]*)?$')
  WHEN p = 4 THEN num AND abs(d) <= 90
  WHEN p = 6 THEN num AND abs(d) <= 180
  WHEN p = 11 THEN starts_with(v, '/')
  WHEN p = 14 THEN regexp_matches(v, '^[A-Za-z]{2}$')
  WHEN p = 23 THEN v IN ('sp3', 'ap3', 'FILE')
  WHEN p IN (24, 27) THEN miss OR num AND abs(d) <= 360
  WHEN p IN (25, 28) THEN miss OR num AND (d BETWEEN 0 AND 90 OR d = -9)
  WHEN p IN (26, 29) THEN miss OR num AND (d BETWEEN -180 AND 180 OR d = -999 AND src = 'FILE')
  WHEN p IN (30, 31) THEN miss OR regexp_matches(v, '^[+]?[0-9]+$') OR regexp_matches(v, '^-0+$') OR regexp_matches(v, '^-0*9$')
  WHEN p = 33 THEN miss OR num AND d IN (0, 1, -9)
  ELSE miss OR num END, FALSE)),
s AS (SELECT q.line_id, file_path, f, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> 33 THEN 'columns' WHEN b.line_id IS NOT NULL THEN 'value' END reason FROM q LEFT JOIN b USING (line_id))
"""

SQL: dict[str, str] = {
    "p1_found": """
WITH f AS (SELECT feed, file_no, CASE WHEN json_valid(body) THEN json_extract(body, '$.properties') END p FROM feed_features),
o AS (SELECT feed, file_no, CASE WHEN json_type(p) = 'OBJECT' THEN p END p FROM f),
k AS (SELECT feed, file_no, p, json_extract_string(p, '$.event_id') ev, unnest(json_keys(p)) AS key FROM o WHERE p IS NOT NULL),
c AS (SELECT feed, file_no, ev, key, json_extract(p, '$."' || key || '"') v FROM k),
t AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END kind FROM c),
g AS (SELECT feed, file_no, key, kind, count(*) n FROM t GROUP BY ALL),
r AS (SELECT feed, file_no, key, arg_max(kind, n) FILTER (kind IS NOT NULL) kind FROM g GROUP BY ALL),
files AS (SELECT feed, file_no, lag(file_no) OVER w before, lead(file_no) OVER w after FROM (SELECT DISTINCT feed, file_no FROM feed_features) WINDOW w AS (PARTITION BY feed ORDER BY file_no)),
s AS (SELECT r.*, before, after, lag(file_no) OVER w kb, lead(file_no) OVER w ka, last_value(kind IGNORE NULLS) OVER (PARTITION BY feed, key ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) lk
  FROM r JOIN files USING (feed, file_no) WINDOW w AS (PARTITION BY feed, key ORDER BY file_no)),
h AS (SELECT feed, file_no, key, 'added' what FROM s WHERE before IS NOT NULL AND kb IS DISTINCT FROM before
  UNION ALL SELECT feed, after, key, 'removed' FROM s WHERE after IS NOT NULL AND ka IS DISTINCT FROM after
  UNION ALL SELECT feed, file_no, key, 'type_changed' FROM s WHERE before IS NOT NULL AND kb = before AND kind <> lk),
held AS (SELECT DISTINCT feed, file_no, ev FROM t WHERE ev IS NOT NULL),
ov AS (SELECT x.feed, x.file_no, x.key old, t.ev, list_sort(list(DISTINCT CAST(t.v AS VARCHAR)) FILTER (kind IS NOT NULL)) vals FROM h x JOIN files USING (feed, file_no) JOIN t ON t.feed = x.feed AND t.file_no = before AND t.key = x.key JOIN held e ON e.feed = x.feed AND e.file_no = x.file_no AND e.ev = t.ev WHERE what = 'removed' GROUP BY ALL),
nv AS (SELECT x.feed, x.file_no, x.key new, t.ev, list_sort(list(DISTINCT CAST(t.v AS VARCHAR)) FILTER (kind IS NOT NULL)) vals FROM h x JOIN t ON t.feed = x.feed AND t.file_no = x.file_no AND t.key = x.key WHERE what = 'added' GROUP BY ALL),
pairs AS (SELECT a.feed, a.file_no, a.key old, b.key new FROM h a JOIN h b USING (feed, file_no) WHERE a.what = 'removed' AND b.what = 'added'),
ren AS (SELECT p.feed, p.file_no, p.old, p.new FROM pairs p JOIN ov USING (feed, file_no, old) LEFT JOIN nv ON nv.feed = p.feed AND nv.file_no = p.file_no AND nv.new = p.new AND nv.ev = ov.ev
  WHERE len(ov.vals) > 0 GROUP BY ALL HAVING count(*) >= 2 AND count(*) = count(*) FILTER (ov.vals = nv.vals))
SELECT feed, file_no, old AS field_name, new AS new_name, 'renamed' AS change_kind FROM ren
UNION ALL SELECT feed, file_no, key, key, what FROM h WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.feed = h.feed AND ren.file_no = h.file_no AND (what = 'removed' AND old = key OR what = 'added' AND new = key))""",
    "p3_found": _BAD_ROWS + "SELECT line_id, reason FROM s WHERE reason IS NOT NULL",
    "p3_totals": _BAD_ROWS + """,
c AS (SELECT file_path, count(*) n_lines FROM fps_lines GROUP BY 1), k AS (SELECT file_path, count(*) n_records, count(reason) n_failed FROM s GROUP BY 1),
m AS (SELECT file_path, max(counts_n) FILTER (starts_with(counts_name, 'lines:')) said_lines, max(counts_n) FILTER (starts_with(counts_name, 'rows:')) said_records FROM sil_read_report GROUP BY 1),
u AS (SELECT file_path, n_lines, coalesce(n_records, 0) n_records, coalesce(n_failed, 0) n_failed FROM c LEFT JOIN k USING (file_path))
SELECT file_path, n_lines, n_records, n_records - n_failed AS n_valid, n_failed, said_lines, said_records, n_lines IS NOT DISTINCT FROM said_lines AND n_records IS NOT DISTINCT FROM said_records AS agree FROM u FULL JOIN m USING (file_path)""",
    "p7_found": """
WITH d AS (
  SELECT delivery_id, received_at, lower(trim(event_id)) k, CAST(updated_time AS TIMESTAMPTZ) u
  FROM quake_messages WHERE event_id IS NOT NULL AND updated_time IS NOT NULL)
SELECT delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY k, u ORDER BY received_at, delivery_id) n FROM d) WHERE n > 1""",
}
