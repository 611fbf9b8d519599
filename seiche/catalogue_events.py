"""Queries of event catalogues: linkage, archive assembly, alerts, fault planes, services, caches; with their SQL.

Greedy one-to-one linkage has a recursive SQL: it goes through the edges in order and keeps the ends
that are taken.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seiche.catalogue import SQL, _SIL_T, _sil, query
from seiche.functions import geo, mechanism, moment, text
from seiche.operators import alerts, joins, mechanisms, schema, windows
from seiche.plans import catalogue as plans
from seiche.queries import read
from seiche.sinks import text as sinks
from seiche.sources import archive, services, web
from seiche.streaming import series as streaming

D, L, S = F.col, F.lit, F.format_string

_OTHER = """SELECT row_id, epoch_us(origin_time) / 1000000.0::DOUBLE t, coordinates[1] lon, coordinates[2] lat, magnitude m, event_id FROM seiscomp_events WHERE origin_time IS NOT NULL AND coordinates[1] IS NOT NULL AND coordinates[2] IS NOT NULL"""
_KM = "sqrt(pow((b.lat - a.lat) * 111.19, 2) + pow((b.lon - a.lon) * 111.19 * cos(radians((a.lat + b.lat) / 2)), 2))"
_GREEDY = """, g AS (SELECT 0::BIGINT i, []::BIGINT[] ta, []::BIGINT[] tb UNION ALL SELECT g.i + 1, CASE WHEN list_contains(ta, e.a) OR list_contains(tb, e.b) THEN ta ELSE list_append(ta, e.a) END, CASE WHEN list_contains(ta, e.a) OR list_contains(tb, e.b) THEN tb ELSE list_append(tb, e.b) END FROM g JOIN e ON e.i = g.i + 1),
z AS (SELECT ta, tb FROM g ORDER BY i DESC LIMIT 1)"""

SQL["j09_match"] = f"""WITH RECURSIVE a AS MATERIALIZED ({_SIL_T}), b AS MATERIALIZED ({_OTHER}), c AS MATERIALIZED (SELECT a.row_id a, b.row_id b, abs(a.t - b.t) dt, {_KM} d FROM a JOIN b ON abs(a.t - b.t) <= 2), e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pow(dt / 2, 2) + pow(d / 10, 2), dt, d, a, b) i, a, b FROM c WHERE d <= 10){_GREEDY}
SELECT unnest(ta) AS a_id, unnest(tb) AS b_id, 'near' AS step FROM z"""


def _other(spark, d) -> DataFrame:
    from seiche.catalogue import _seconds

    e = read(spark, d, "seiscomp_events").select(D("row_id").alias("id"), _seconds("origin_time").alias("t"), F.try_element_at("coordinates", L(2)).alias("lat"), F.try_element_at("coordinates", L(1)).alias("lon"), "magnitude", "event_id")
    return e.filter("t is not null and lat is not null and lon is not null")


@query(f"""WITH RECURSIVE a AS MATERIALIZED ({_SIL_T}), b AS MATERIALIZED ({_OTHER}), c AS MATERIALIZED (SELECT a.row_id a, b.row_id b, abs(a.t - b.t) / CASE WHEN b.row_id % 3 = 0 THEN 5 ELSE 2 END + {_KM} / CASE WHEN b.row_id % 3 = 0 THEN 25 ELSE 10 END s FROM a JOIN b ON abs(a.t - b.t) <= CASE WHEN b.row_id % 3 = 0 THEN 5 ELSE 2 END
WHERE {_KM} <= CASE WHEN b.row_id % 3 = 0 THEN 25 ELSE 10 END AND b.row_id % 7 <> 0), e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s, a, b) i, a, b FROM c){_GREEDY} SELECT unnest(ta) AS a_id, unnest(tb) AS b_id FROM z""")
def j05_greedy(spark, d):
    """One to one by the sum of the shares of two tolerances, which depend on the row; one of 0 matches nothing."""
    a = _sil(spark, d).select(D("row_id").alias("id"), "t", "lat", "lon")
    wide, none = D("id") % 3 == 0, D("id") % 7 == 0
    b = _other(spark, d).withColumns({"s": F.when(none, 0.0).when(wide, 5.0).otherwise(2.0), "km": F.when(none, 0.0).when(wide, 25.0).otherwise(10.0)})
    return joins.near_pairs(a, b)


def _matches(spark, d):
    a = _sil(spark, d).select(D("row_id").alias("id"), "t", "lat", "lon", "magnitude", F.regexp_extract("event_id", r"(\d+)$", 1).alias("key"))
    b = _other(spark, d).withColumn("key", F.when(D("id") % 5 == 0, D("id").cast("string")))
    return joins.catalogue_matches(a.withColumn("key", F.when(D("id") % 5 == 0, D("id").cast("string"))), b, tolerances=[("near", 2.0, 10.0)], id_joins=[("number", "key", "key")])


_MATCH = f"""WITH RECURSIVE x AS ({_SIL_T}), y AS ({_OTHER}), i AS (SELECT x.row_id FROM x JOIN y USING (row_id) WHERE row_id % 5 = 0), a AS MATERIALIZED (SELECT * FROM x WHERE row_id NOT IN (SELECT row_id FROM i)), b AS MATERIALIZED (SELECT * FROM y WHERE row_id NOT IN (SELECT row_id FROM i)),
c AS MATERIALIZED (SELECT a.row_id a, b.row_id b, abs(a.t - b.t) dt, {_KM} d FROM a JOIN b ON abs(a.t - b.t) <= 2), e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pow(dt / 2, 2) + pow(d / 10, 2), dt, d, a, b) i, a, b FROM c WHERE d <= 10){_GREEDY},
p AS (SELECT unnest(ta) AS a_id, unnest(tb) AS b_id, 'near' AS step FROM z UNION ALL SELECT row_id, row_id, 'id:number' FROM i)"""


@query(_MATCH + """ SELECT a_id, b_id, step, round(y.t - x.t, 5) AS dt_s FROM p JOIN x ON x.row_id = a_id JOIN y ON y.row_id = b_id""")
def j10_pairs(spark, d):
    """Two catalogues matched by unique keys, then by time and place."""
    return _matches(spark, d)["pairs"].select("a_id", "b_id", "step", F.round("dt_s", 5).alias("dt_s"))


@query(_MATCH + """ SELECT step, count(*) AS n, round(quantile_cont(abs(y.t - x.t), 0.5), 4) AS dt_median, round(quantile_cont(abs(y.t - x.t), 0.95), 4) AS dt_p95 FROM p JOIN x ON x.row_id = a_id JOIN y ON y.row_id = b_id GROUP BY 1""")
def a04_match_steps(spark, d):
    """How well the pairs of each step agree."""
    return _matches(spark, d)["steps"].select("step", "n", F.round("dt_median", 4).alias("dt_median"), F.round("dt_p95", 4).alias("dt_p95"))


@query(_MATCH + """ SELECT 'n_a' AS what, count(*) AS n FROM x UNION ALL SELECT 'n_b', count(*) FROM y UNION ALL SELECT 'matched', count(*) FROM p UNION ALL SELECT 'unmatched_a', count(*) FROM x WHERE row_id NOT IN (SELECT a_id FROM p) UNION ALL SELECT 'unmatched_b', count(*) FROM y WHERE row_id NOT IN (SELECT b_id FROM p) UNION ALL SELECT 'ambiguous:number', 0""")
def j10_summary(spark, d):
    return _matches(spark, d)["summary"]


# The archive: reviewed and automatic rows of the same days, made of the catalogue's events.

_DAYS = """SELECT row_id k, '/2026/aug/' || lpad(CAST(row_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || row_id id, row_id % 86000 s, row_id % 28 + 1 dd FROM (SELECT DISTINCT row_id FROM sil_events)"""


def _assembled(spark, d) -> DataFrame:
    """Reviewed rows of every number; automatic ones of every third by id, of every fourth under another id 0.5 s off, of every fifth alone."""
    e = read(spark, d, "sil_events").select(D("row_id").alias("k")).distinct()
    day = (D("k") % 28 + 1).cast("int")
    base = F.make_timestamp_ntz(L(2026), L(8), day, L(0), L(0), L(0))
    at = lambda s: base + F.make_dt_interval(L(0), L(0), L(0), s.cast("decimal(18,6)"))
    ident = F.concat(L("/2026/aug/"), F.lpad(day.cast("string"), 2, "0"), L("/"), D("k").cast("string"))
    lat, lon = 63 + D("k") % 97 / L(50.0), -24 + D("k") % 89 / L(20.0)
    e = e.withColumns({"t": at(D("k") * 37 % 86000), "id": ident, "latitude": lat, "longitude": lon, "file": F.concat(L("/sil/2026/aug/"), day.cast("string"), L("/f")), "line_no": D("k").cast("int"), "num": D("k").cast("double")})
    nothing = {c: L(None).cast("double") for c in ("depth", "mlw", "ml", "q", "moment")}
    fps = e.withColumns(nothing | {"mlw": L(1.5), "event_type": L("qu"), "source_file": L("sp3")})
    lib = e.filter("k % 2 = 0").withColumns(nothing | {"mlw": L(2.5), "event_type": L("qu")})
    aut = e.filter("k % 3 = 0").withColumns(nothing | {"ml": L(3.0), "q": L(50.0)})
    near = e.filter("k % 3 = 1 and k % 4 = 0").withColumns(nothing | {"ml": L(4.0), "q": L(50.0), "id": F.concat(L("/other/"), D("k").cast("string")), "t": at(D("k") * 37 % 86000 + 0.5)})
    alone = e.filter("k % 3 = 2 and k % 5 = 0").withColumns(nothing | {"ml": L(5.0), "q": L(50.0), "id": L(None).cast("string"), "t": at(D("k") * 37 % 86000 + 200), "latitude": L(10.0)})
    return archive.assembled_events(fps, lib, aut.unionByName(near).unionByName(alone))


@query("""SELECT evaluation_mode, count(*) AS n, count(*) FILTER (auto) AS n_auto, sum(m) AS total FROM (SELECT 'manual' AS evaluation_mode, row_id % 3 = 0 OR (row_id % 3 = 1 AND row_id % 4 = 0) AS auto, CASE WHEN row_id % 2 = 0 THEN 2.5 ELSE 1.5 END m FROM (SELECT DISTINCT row_id FROM sil_events)
UNION ALL SELECT 'automatic', TRUE, 5.0 FROM (SELECT DISTINCT row_id FROM sil_events) WHERE row_id % 3 = 2 AND row_id % 5 = 0) GROUP BY 1""".replace("sum(m)", "CAST(sum(m) AS DOUBLE)"))
def j04_assembled(spark, d):
    """Days of an archive assembled: automatic solutions by id, then by time and place, the rest events of their own."""
    out = _assembled(spark, d)
    return out.groupBy("evaluation_mode").agg(F.count("*").alias("n"), F.count("mag_auto").alias("n_auto"), F.sum("magnitude").alias("total"))


@query("""WITH e AS (SELECT DISTINCT row_id k FROM sil_events), a AS (SELECT k, (k * 37) % 86000 + 0.0::DOUBLE t FROM e), c AS (SELECT k, (k * 37) % 86000 + 0.25::DOUBLE t FROM e WHERE k % 4 = 0),
p AS (SELECT c.k p, a.k r, abs(a.t - c.t) g, CASE WHEN a.k % 5 = c.k % 5 THEN 0 ELSE 1000 END d FROM c JOIN a ON abs(a.t - c.t) <= 0.5), o AS (SELECT p, min(r) r FROM p WHERE d = 0 GROUP BY 1)
SELECT r AS "row", CAST(arg_max(p % 7, p) AS DOUBLE) AS mag_pgv FROM o GROUP BY 1""")
def j07_nearest_velocity(spark, d):
    """Magnitudes of cleaned rows for the automatic rows nearest in place; of several the last stands."""
    e = read(spark, d, "sil_events").select(D("row_id").alias("k")).distinct()
    place = {"lat": 60 + D("k") % 5 * 1.0, "lon": L(-20.0)}
    a = e.withColumns({"row": D("k"), "t": D("k") * 37 % 86000 + 0.0} | place)
    c = e.filter("k % 4 = 0").withColumns({"position": D("k"), "t": D("k") * 37 % 86000 + 0.25, "ml": (D("k") % 7).cast("double")} | place)
    return alerts.nearest_velocity(a, c)


@query("""SELECT max_by(row_id, struct_pack(q := CASE WHEN isnan(magnitude) OR magnitude IS NULL THEN '-inf'::DOUBLE ELSE magnitude END, p := row_id)) AS row_id, event_id FROM sil_events WHERE evaluation_mode = 'automatic' AND origin_time >= TIMESTAMP '2026-08-15' AND origin_time < TIMESTAMP '2026-10-01' GROUP BY 2""")
def s35_automatic_only(spark, d):
    """The best automatic solution of each event of a range."""
    rows = read(spark, d, "sil_events").filter("evaluation_mode = 'automatic'").filter(plans.within("origin_time", "2026-08-15", "2026-10-01"))
    return windows.best_quality(rows.select("event_id", "row_id", "magnitude"), ["event_id"], "magnitude", "row_id").select("event_id", "row_id")


# Alerts.


def _alert_rows(spark, d) -> DataFrame:
    """Stations of the orders' detections: the lines of an order."""
    l = read(spark, d, "lineitem").select(D("l_orderkey").alias("alert"), D("l_linenumber").alias("station"), (D("l_partkey") % 200 + 1.0).alias("distance_km"), D("l_quantity").alias("pgv"), D("l_quantity").alias("after_s"), (D("l_suppkey") % 5 + 20).cast("int").alias("class_code"))  # noqa: E741
    return l.withColumn("station", F.concat(L("s"), D("station").cast("string")))


_AL = """SELECT l_orderkey alert, 's' || l_linenumber station, l_partkey % 200 + 1.0::DOUBLE d, l_quantity v, l_suppkey % 5 + 20 c FROM lineitem"""


@query(f"SELECT alert, count(*) FILTER (v > d / 7 - 2 AND v < d / 3 + 10) AS n_fit, count(*) AS n_total, count(*) FILTER (v > d / 7 - 2 AND v < d / 3 + 10) >= 3 AND count(*) FILTER (v > d / 7 - 2 AND v < d / 3 + 10) / count(*) >= 0.5 AS accepted FROM ({_AL}) GROUP BY 1")
def a18_travel_times(spark, d):
    """How many arrivals of a detection fit an origin."""
    return alerts.travel_time_fits(_alert_rows(spark, d), ["alert"])


_ST = f"""WITH s AS (SELECT *, (1.69 * log10(d) + log10(v * 1e-6) + 4.96) / 1.05 m, CASE WHEN station = 's7' THEN 'excluded_station' WHEN c = 22 THEN 'excluded_class_code' WHEN d > 180 THEN 'beyond_max_km' END f FROM ({_AL})),
q AS (SELECT alert, median(m) FILTER (f IS NULL) mm FROM s GROUP BY 1), k AS (SELECT s.*, CASE WHEN mm IS NULL OR mm < 3 THEN 5 WHEN mm < 4 THEN 10 WHEN mm < 5 THEN 20 ELSE 30 END lim FROM s JOIN q USING (alert)),
r AS (SELECT *, coalesce(f, CASE WHEN d <= lim THEN 'nearfield' END) reason FROM k)"""


def _stations(spark, d) -> DataFrame:
    settings = alerts.Velocity(exclude_stations=("s7",), max_km=180.0)
    return alerts.velocity_stations(_alert_rows(spark, d), ["alert"], settings)


@query(_ST + " SELECT alert, station, reason AS drop_reason, round(m, 6) AS mag_farfield FROM r")
def f13_velocity_stations(spark, d):
    """Each station's magnitude and why it is dropped, with a near field that goes by the others."""
    return _stations(spark, d).select("alert", "station", "drop_reason", F.round("mag_farfield", 6).alias("mag_farfield"))


@query(_ST + """, o AS (SELECT alert, m, row_number() OVER (PARTITION BY alert ORDER BY m) i, count(*) OVER (PARTITION BY alert) n FROM r WHERE reason IS NULL), t AS (SELECT alert, avg(m) tm FROM o WHERE n >= 3 AND i > n // 3 AND i <= n - n // 3 GROUP BY 1)
SELECT r.alert AS alert, round(median(m) FILTER (reason IS NULL), 5) AS magnitude, round(any_value(tm), 5) AS robust_mean, count(*) AS n_alert, count(*) FILTER (reason IS NULL) AS n_kept FROM r LEFT JOIN t USING (alert) GROUP BY 1""")
def a16_velocity_magnitude(spark, d):
    """A detection's magnitude from its kept stations."""
    out = alerts.velocity_magnitudes(_stations(spark, d), ["alert"])
    return out.select("alert", F.round("magnitude", 5).alias("magnitude"), F.round("robust_mean", 5).alias("robust_mean"), "n_alert", "n_kept")


@query(f"""WITH f AS (SELECT alert, count(*) FILTER (v > d / 7 - 2 AND v < d / 3 + 10) n_fit, count(*) n_total FROM ({_AL}) GROUP BY 1), c AS (SELECT o_custkey event, o_orderkey alert, (o_orderkey * 7) % 200 - 100.0::DOUBLE dt, n_fit, n_total, n_fit >= 3 AND n_fit / n_total >= 0.5 ok FROM orders JOIN f ON alert = o_orderkey),
w AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY abs(dt), dt, alert) i FROM c WHERE abs(dt) <= 60 AND ok) SELECT event, alert FROM w WHERE i = 1""")
def j26_associated(spark, d):
    """The detection of an origin: in the window, fitting, the nearest in time."""
    out = alerts.associated(_candidates(spark, d), "event", alert=["alert"])
    return out.filter("chosen").select("event", "alert")


def _candidates(spark, d) -> DataFrame:
    fits = alerts.travel_time_fits(_alert_rows(spark, d), ["alert"])
    o = read(spark, d, "orders").select(D("o_custkey").alias("event"), D("o_orderkey").alias("alert"), (D("o_orderkey") * 7 % 200 - 100.0).alias("dt_s"))
    return o.join(fits, "alert")


@query(f"""WITH f AS (SELECT alert, count(*) FILTER (v > d / 7 - 2 AND v < d / 3 + 10) n_fit, count(*) n_total FROM ({_AL}) GROUP BY 1), c AS (SELECT o_custkey event, o_orderkey alert, (o_orderkey * 7) % 200 - 100.0::DOUBLE dt, n_fit, n_total, n_fit >= 3 AND n_fit / n_total >= 0.5 ok FROM orders JOIN f ON alert = o_orderkey),
w AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY NOT ok, -(n_fit / n_total), -n_fit, abs(dt), dt, alert) i FROM c WHERE abs(dt) <= 30) SELECT event, alert FROM w WHERE i = 1""")
def j26_associated_by_fit(spark, d):
    """The same by fit, without requiring it, in a narrower window."""
    method = alerts.resolved_method("find_alert", rank="fit")
    return alerts.associated(_candidates(spark, d), "event", method=method, alert=["alert"]).filter("chosen").select("event", "alert")


@query("""SELECT * FROM (VALUES ('page', 60.0, TRUE, 'time'), ('find_alert', 30.0, FALSE, 'fit'), ('other', NULL, NULL, 'refused')) t(name, window_s, require_fit, rank)""")
def x12_methods(spark, d):
    """Methods by name with overrides; an unknown one is refused."""
    rows = [(m.name, m.window_s, m.require_fit, m.rank) for m in (alerts.resolved_method("page"), alerts.resolved_method("find_alert", rank="fit"))]
    try:
        alerts.resolved_method("other")
    except ValueError:
        rows.append(("other", None, None, "refused"))
    return spark.createDataFrame(rows, "name string, window_s double, require_fit boolean, rank string")


@query("""SELECT s_suppkey AS alert_id, CASE WHEN s_suppkey % 3 = 0 THEN 'GNSS-1' WHEN s_suppkey % 3 = 1 THEN 'broadband' END AS sensor, CASE WHEN s_suppkey % 2 = 0 THEN 'code22_' || CASE s_suppkey % 3 WHEN 0 THEN 'one_hz' WHEN 1 THEN 'other_sensor' ELSE 'unknown_sensor' END ELSE 'one_hz_without_code22' END AS issue FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def j25_sensor_report(spark, d):
    """Stations marked with a code and sensors of 1 Hz that are not."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier")
    at = lambda v: L(v).cast("timestamp_ntz")
    rows = s.select(k.alias("alert_id"), k.cast("string").alias("station"), F.when(k % 2 == 0, 22).otherwise(0).alias("class_code"), at("2020-06-01").alias("t"))
    sensors = s.filter("s_suppkey % 3 < 2").select(k.cast("string").alias("station"), F.when(k % 3 == 0, "GNSS-1").otherwise("broadband").alias("sensor"), at("2020-01-01").alias("start_time"), at(None).alias("end_time")).unionByName(
        s.filter("s_suppkey % 3 = 2").select(k.cast("string").alias("station"), L("GNSS-old").alias("sensor"), at("2010-01-01").alias("start_time"), at("2011-01-01").alias("end_time"))
    )
    return alerts.sensor_report(rows, sensors).select("alert_id", "sensor", "issue")


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN '/b' ELSE '/a' END AS root FROM orders WHERE year(o_orderdate) >= 1997 OR TRUE""")
def s63_alert_days(spark, d):
    """Files of days from ordered folders, year by year the first that has the year."""
    day = F.lower(F.date_format("o_orderdate", "yyyy/MMM/dd"))
    o = read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), day.alias("day"))
    name = lambda root: F.concat(L(f"{root}/"), D("day"), L("/"), D("o_orderkey").cast("string"), L(".event"))
    files = o.filter("y >= 1997").select(name("/a").alias("file")).unionByName(o.select(name("/b").alias("file")))
    out = alerts.alert_days(files, ["/a", "/b"])
    return out.select(F.regexp_extract("file", r"/(\d+)\.event$", 1).cast("long").alias("o_orderkey"), F.substring("file", 1, 2).alias("root"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-07-01') >= 2 AS kept FROM orders")
def st09_finished_days(spark, d):
    """Only days old enough are kept in a cache (ST09, S64)."""
    return read(spark, d, "orders").select("o_orderkey", alerts.finished(D("o_orderdate").cast("date"), L("1998-07-01").cast("date")).alias("kept"))


@query("SELECT * FROM (VALUES ('found', '1'), ('found', '3'), ('problem', 'b: no number')) t(kind, value)")
def s65_parsed_day(spark, d):
    """A day of files of which one cannot be read."""

    def parse(body: str) -> str:
        if not body.isdigit():
            raise ValueError("no number")
        return body

    found, problems = alerts.parsed_day({"a": "1", "b": "x", "c": "3"}, parse)
    return spark.createDataFrame([("found", f) for f in found] + [("problem", p) for p in problems], "kind string, value string")


# Fault planes.


def _list_rows(spark, d) -> DataFrame:
    q = read(spark, d, "skjalftalisa_quakes")
    return q.select("row_id", text.canonical_number(D("event_id")).cast("long").alias("event"), F.lower(F.trim("originating_system")).alias("system"), "strike", "dip", "slip", "origin_time", "depth_km", "latitude")


_LR = """WITH q AS (SELECT row_id, CAST(regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT) ev, CASE WHEN NOT isnan(strike) THEN strike END s, CASE WHEN NOT isnan(dip) THEN dip END d, CASE WHEN NOT isnan(slip) THEN slip END r FROM skjalftalisa_quakes WHERE lower(trim(originating_system)) = 'sil picks'),
o AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY row_id) n FROM q), p AS (SELECT *, CASE WHEN s IS NULL AND d IS NULL AND r IS NULL THEN 'no_plane' WHEN s IS NULL OR d IS NULL OR r IS NULL OR d NOT BETWEEN 0 AND 90 THEN 'bad_plane' ELSE 'planes' END st FROM o WHERE n = 1)"""


def _listed(spark, d):
    return mechanisms.from_list(_list_rows(spark, d), order=[D("row_id")], reviewed=D("system") == "sil picks")


@query(_LR + """ SELECT ev AS event, round(((s % 360) + 360) % 360, 5) AS strike1, round(d, 5) AS dip1, round(degrees(acos(greatest(-1, least(1, abs(sin(radians(r)) * sin(radians(d))))))), 3) AS dip2 FROM p WHERE st = 'planes'""")
def f66_listed_planes(spark, d):
    """Planes of list rows: the first reviewed one of an event, whole ones only."""
    rows, _ = _listed(spark, d)
    return rows.select("event", F.round("strike1", 5).alias("strike1"), F.round("dip1", 5).alias("dip1"), F.round("dip2", 3).alias("dip2"))


@query(_LR + " SELECT st AS what, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM q) - (SELECT count(*) FROM p)")
def s57_plane_counts(spark, d):
    return _listed(spark, d)[1]


def _detailed(spark, d) -> DataFrame:
    k = D("s_suppkey")
    s = read(spark, d, "supplier").select(k.alias("event"), (k * 37 % 360).cast("double").alias("s"), (20 + k % 50).cast("double").alias("d"), (k * 53 % 300 - 140).cast("double").alias("r"))
    other = mechanism.auxiliary_plane(D("s"), D("d"), D("r"))
    s = s.withColumn("o", other)
    whole = D("event") % 4 != 0
    return s.select("event", D("s").alias("strike_a"), F.when(D("event") % 9 == 0, 95.0).otherwise(D("d")).alias("dip_a"), D("r").alias("rake_a"), F.when(whole, D("o.strike") + F.when(D("event") % 3 == 0, 40.0).otherwise(0.0)).alias("strike_b"), F.when(whole, D("o.dip")).alias("dip_b"), F.when(whole, D("o.rake")).alias("rake_b"))


@query("SELECT s_suppkey AS event, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS strike1, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 3 <> 0 END AS consistent FROM supplier WHERE s_suppkey % 9 <> 0")
def f67_detail_planes(spark, d):
    """Planes of detail answers and whether they belong together."""
    return mechanisms.detail_planes(_detailed(spark, d)).select("event", F.round("strike1", 6).alias("strike1"), "consistent")


@query("SELECT s_suppkey AS event, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 9 <> 0 THEN 'detail' ELSE 'list' END AS planes_from, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 9 <> 0 THEN CAST((s_suppkey * 37) % 360 AS DOUBLE) ELSE 1.0 END AS strike1 FROM supplier")
def j30_overridden(spark, d):
    """List planes with those of the details in their place."""
    one = read(spark, d, "supplier").select(D("s_suppkey").alias("event"), *[L(1.0).alias(f"{c}{n}") for n in (1, 2) for c in mechanisms.PLANE], L("list").alias("planes_from"))
    out = mechanisms.overridden(one, mechanisms.detail_planes(_detailed(spark, d).filter("event % 2 = 0")))
    return out.select("event", "planes_from", F.round("strike1", 6).alias("strike1"))


def _archived(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _detailed(spark, d).filter("event % 9 <> 0 and event % 4 <> 0").withColumns({"id": D("event").cast("string"), "source_file": L("sp3"), "has_solution": D("event") % 5 != 0})
    blocks = rows.filter("event % 2 = 0").select("id", L(33.0).alias("acceptable_pct"), L("Normal faulting dominates").alias("faulting"), (D("strike_a") + F.when(D("event") % 7 == 0, 60.0).otherwise(0.0)).alias("strike_a"), "dip_a", "rake_a", "strike_b", "dip_b", "rake_b")
    return rows, blocks


_AR = "SELECT s_suppkey k FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 4 <> 0"


@query(f"SELECT k AS event, 'sil_sp3' AS method, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 33.0 END::DOUBLE AS quality, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'normal' END AS sil_faulting_class, k % 3 = 0 AS planes_inconsistent FROM ({_AR}) WHERE k % 5 <> 0")
def j28_archive_mechanisms(spark, d):
    """Solutions of archive rows with their block's label where the planes agree."""
    rows, blocks = _archived(spark, d)
    out = mechanisms.from_archive(rows, blocks.select("id", "acceptable_pct", "faulting", "strike_a", "dip_a", "rake_a"))
    return out.select("event", "method", "quality", "sil_faulting_class", "planes_inconsistent")


@query(f"SELECT k AS event, CAST((k * 37) % 360 + CASE WHEN k % 7 = 0 THEN 60 ELSE 0 END AS DOUBLE) % 360 AS strike1 FROM ({_AR}) WHERE k % 2 = 0")
def j29_block_mechanisms(spark, d):
    """Events with the planes of their block."""
    rows, blocks = _archived(spark, d)
    return mechanisms.from_blocks(rows.select("id", "event"), blocks).select("event", F.round("strike1", 6).alias("strike1"))


@query(f"SELECT 'warning' AS level, count(*) AS n FROM ({_AR}) WHERE k % 5 <> 0 AND k % 3 = 0")
def p29_marked(spark, d):
    """Inconsistent planes that are marked are warnings only."""
    rows, _ = _archived(spark, d)
    return mechanisms.checked(mechanisms.from_archive(rows))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN b > 60 THEN 'strike-slip' WHEN p > 60 THEN 'normal' WHEN t > 50 THEN 'reverse' ELSE 'odd' END AS class FROM (SELECT degrees(asin(least(1, abs(nz - uz) / sqrt(2)))) p, degrees(asin(least(1, abs(nx * uy - ny * ux)))) b, degrees(asin(least(1, abs(nz + uz) / sqrt(2)))) t FROM
(SELECT cos(r) * cos(s) + sin(r) * cos(d) * sin(s) ux, cos(r) * sin(s) - sin(r) * cos(d) * cos(s) uy, -sin(r) * sin(d) uz, -sin(d) * sin(s) nx, sin(d) * cos(s) ny, -cos(d) nz FROM (SELECT radians((s_suppkey * 37) % 360) s, radians(20 + s_suppkey % 50) d, radians((s_suppkey * 53) % 300 - 140) r FROM supplier WHERE s_suppkey % 9 <> 0)))) GROUP BY 1""")
def f21_classes(spark, d):
    """Classes of a frame's first planes."""
    out = mechanisms.classes(mechanisms.detail_planes(_detailed(spark, d)))
    return out.groupBy(D("faulting_class").alias("class")).agg(F.count("*").alias("n"))


# Services.


@query("""WITH q AS (SELECT row_id, CAST(regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT) ev, CASE WHEN lower(trim(originating_system)) = 'sil picks' THEN 'sil picks' ELSE 'auto' END s, origin_time, CASE WHEN NOT isnan(depth_km) THEN depth_km END dep FROM skjalftalisa_quakes),
o AS (SELECT *, row_number() OVER (PARTITION BY ev, s ORDER BY row_id) r FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY s <> 'sil picks') n FROM o WHERE r = 1)
SELECT ev AS event, row_id FROM k WHERE n = 1 AND ev IS NOT NULL AND origin_time >= TIMESTAMP '2015-01-01' AND dep BETWEEN 2 AND 9""")
def s54_resolved_events(spark, d):
    """Events of list rows: twins resolved, then cut and filtered."""
    rows = _list_rows(spark, d).filter("event is not null").withColumn("system", F.when(D("system") == "sil picks", "sil picks").otherwise("auto")).withColumn("time", D("origin_time").cast("timestamp_ntz"))
    out = services.resolved_events(rows, "2015-01-01", "2100-01-01", reviewed="sil picks", order=[D("row_id")], auto_value="depth_km", ranges={"depth_km": (2, 9)})
    return out.select("event", "row_id")


@query("SELECT count(DISTINCT CAST(regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT)) AS n_events FROM skjalftalisa_quakes")
def s55_event_count(spark, d):
    return services.event_count(_list_rows(spark, d))


@query("""WITH q AS (SELECT row_id, CAST(regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT) ev, lower(trim(originating_system)) s FROM skjalftalisa_quakes), m AS (SELECT min(ev) ev FROM q) SELECT row_id, CASE s WHEN 'sil picks' THEN 1 WHEN 'sil aut' THEN 2 ELSE 3 END AS place FROM q JOIN m USING (ev)""")
def s56_detail_origins(spark, d):
    """All origins of one event in the order of the systems."""
    rows = _list_rows(spark, d)
    first = rows.agg(F.min("event")).head()[0]
    return services.detail_origins(rows, first, ("sil picks", "sil aut")).select("row_id", D("place").cast("int").alias("place"))


@query("""SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31'), (TIMESTAMP '2024-01-31', TIMESTAMP '2024-03-01'), (TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-10')) t(since, until)""")
def s53_fixed_windows(spark, d):
    """The windows a list is asked for."""
    return spark.createDataFrame(services.fixed_windows(dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 10), dt.timedelta(days=30)), "since timestamp_ntz, until timestamp_ntz")


@query("""SELECT 'IMO' || s_suppkey AS event_id, 'o' || i AS origin_id, 64.0 + s_suppkey / 100.0::DOUBLE AS latitude, 5.2::DOUBLE AS depth_km, CAST(TIMESTAMP '2026-09-19 00:57:29.904' AS TIMESTAMP) AS time FROM supplier, (VALUES (1), (2)) v(i) WHERE i = 1 OR s_suppkey % 2 = 0""")
def s43_details(spark, d):
    """Detail answers whose children are an object or a list of objects."""
    k = D("s_suppkey")
    origin = lambda i: F.concat(L('{"publicID": "o'), L(str(i)), L('", "time": {"value": "2026-09-19T00:57:29.904Z"}, "latitude": {"value": '), (64.0 + k / L(100.0)).cast("string"), L('}, "depth": {"value": "5200"}, "evaluationMode": "manual"}'))
    origins = F.when(k % 2 == 0, F.concat(L("["), origin(1), L(", "), origin(2), L("]"))).otherwise(origin(1))
    body = F.concat(L('{"event": {"publicID": "smi:x/IMO'), k.cast("string"), L('", "origin": '), origins, L("}}"))
    return services.details(read(spark, d, "supplier").select(body.alias("body"))).select("event_id", "origin_id", F.round("latitude", 6).alias("latitude"), "depth_km", "time")


@query("SELECT * FROM (VALUES ('a', 'A', 1), ('c', 'C', 1)) t(id, body, absent)")
def s44_asked(spark, d):
    """One request an id, a cap on their number, missing ones counted."""
    found, absent = services.asked(["a", "b", "c"], lambda i: None if i == "b" else i.upper(), 3, missing="skip")
    try:
        services.asked(["a", "b"], str, 1)
    except ValueError:
        return spark.createDataFrame([(i, b, absent) for i, b in found], "id string, body string, absent int")
    raise AssertionError("more requests than allowed")


def _quakeml(spark, d) -> str:
    """QuakeML answers of the nations, two of which hold the same event, as text files of the shared folder."""
    from seiche.session import shared_dir

    k = D("n_nationkey")
    event = F.concat(
        L('<event publicID="smi:x/E'), k.cast("string"), L('"><type>earthquake</type><preferredOriginID>o2</preferredOriginID>'), L('<origin publicID="o1"><time><value>2026-09-19T00:00:00Z</value></time><latitude><value>1.5</value></latitude></origin>'),
        L('<origin publicID="o2"><time><value>2026-09-19T00:57:29.904Z</value></time><latitude><value>'), (k + 0.25).cast("string"), L("</value></latitude><depth><value>5200</value></depth><evaluationMode>manual</evaluationMode></origin>"),
        L('<magnitude publicID="m1"><mag><value>2.5</value></mag><type>Mlw</type></magnitude></event>'),
    )
    n = read(spark, d, "nation")
    rows = n.select((k % 3).alias("g"), event.alias("e")).unionByName(n.filter("n_nationkey < 5").select(L(7).alias("g"), event.alias("e")))
    answers = rows.groupBy("g").agg(F.concat(L("<quakeml><eventParameters>\n"), F.array_join(F.collect_list("e"), "\n"), L("\n</eventParameters></quakeml>")).alias("value"))
    path = shared_dir(spark, "quakeml")
    answers.write.partitionBy("g").text(path)  # one document a file
    return path


@query("SELECT 'E' || n_nationkey AS event_id, n_nationkey + 0.25::DOUBLE AS latitude, 5.2::DOUBLE AS depth_km, 2.5::DOUBLE AS magnitude, 'Mlw' AS magnitude_type FROM nation")
def s50_preferred_events(spark, d):
    """Events of XML answers, each once, with the preferred origin."""
    out = services.preferred_events(services.catalogue_frames(spark, _quakeml(spark, d)))
    return out.select("event_id", "latitude", "depth_km", "magnitude", "magnitude_type")


@query("SELECT 'events' AS frame, count(*) AS n FROM nation UNION ALL SELECT 'origins', 2 * count(*) FROM nation UNION ALL SELECT 'magnitudes', count(*) FROM nation UNION ALL SELECT 'picks', 0 UNION ALL SELECT 'mechanisms', 0")
def s51_catalogue_frames(spark, d):
    """The five frames of a catalogue."""
    out = None
    for name, df in services.catalogue_frames(spark, _quakeml(spark, d)).items():
        one = df.agg(L(name).alias("frame"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'key' AS field, count(*) FILTER (n_nationkey = 3) AS n, count(*) FILTER (n_nationkey = 3) AS only_a FROM nation UNION ALL SELECT 'n_regionkey', count(*) FILTER (n_nationkey % 7 = 0 AND n_nationkey <> 3), 0 FROM nation""")
def j32_cross_check(spark, d):
    """How two services differ, field by field."""
    n = read(spark, d, "nation").select(D("n_nationkey").alias("event_id"), "n_name", "n_regionkey")
    other = n.filter("event_id <> 3").withColumn("n_regionkey", D("n_regionkey") + F.when(D("event_id") % 7 == 0, 1).otherwise(0))
    return services.cross_checked(n, other, tolerances={"n_regionkey": 0.5}, exact=["n_name"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') WHERE n <= 40")
def s50_keyset_page(spark, d):
    """A page of a service by time and id."""
    o = read(spark, d, "orders").select(D("o_orderdate").cast("timestamp_ntz").alias("time"), D("o_orderkey").alias("event_id"))
    return services.keyset_page(o, ("1996-12-31 23:59:59.999999", 0), 40).select(D("event_id").alias("o_orderkey"))


# Caches, harvests, products.


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') <= 30 OR month(o_orderdate) = 3 AS read_again FROM orders")
def st03_recent_days(spark, d):
    """Which days are read again: recent ones always, others where they are not cached (ST03, S39)."""
    o = read(spark, d, "orders").select(D("o_orderdate").cast("date").alias("day"))
    cached = o.filter(F.month("day") != 3).withColumn("v", L(1))
    use, again = streaming.gathered_days(cached, o, "1998-08-01")
    return again.withColumn("read_again", L(True)).unionByName(use.select("day").distinct().withColumn("read_again", L(False)))


@query("SELECT s_suppkey AS k, s_suppkey % 3 = 1 OR s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 AS taken FROM supplier")
def st01_changed_files(spark, d):
    """Files that are new or changed since they were last taken (ST01)."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier")
    listing = s.select(k.cast("string").alias("file"), (k % 50).alias("size"), L(7).cast("long").alias("mtime"))
    state = s.filter("s_suppkey % 3 <> 1").select(k.cast("string").alias("file"), (k % 50).alias("size"), F.when((k % 3 == 2) & (k % 2 == 0), 6).otherwise(7).cast("long").alias("mtime"))
    new = streaming.changed_files(listing, state).select("file", L(True).alias("t"))
    return listing.join(new, "file", "left").select(D("file").cast("long").alias("k"), F.coalesce("t", L(False)).alias("taken"))


@query("SELECT o_orderkey AS date, o_orderpriority AS net, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM orders")
def k23_harvested(spark, d):
    """Rows of files read again replace those of the same date and network."""
    o = read(spark, d, "orders").select(D("o_orderkey").alias("date"), D("o_orderpriority").alias("net"))
    return streaming.harvested(o.withColumn("v", L("old")), o.filter("date % 4 = 0").withColumn("v", L("new")), ["date", "net"])


@query("""WITH e AS (SELECT s_suppkey k, DATE '2024-01-10' AS a, DATE '2024-01-19' AS b FROM supplier), d AS (SELECT s_suppkey k, DATE '2023-12-01' + CAST(i AS INT) AS day, CASE WHEN i BETWEEN 40 AND 49 THEN CASE s_suppkey % 4 WHEN 0 THEN 60.0 WHEN 1 THEN 60.0 ELSE 5.0 END WHEN i > 49 AND s_suppkey % 4 = 1 THEN 60.0 ELSE 0.0 END up FROM supplier, range(0, 80) t(i) WHERE s_suppkey % 4 <> 3 OR i < 50)
SELECT k, k % 4 = 0 OR k % 4 = 3 AS kept, k % 4 = 3 AS provisional FROM e""")
def w11_snow_bumps(spark, d):
    """Episodes that are bumps, steps, too small, and without data after them."""
    k = D("s_suppkey")
    rows = read(spark, d, "supplier").select(k.alias("k"), F.explode(F.sequence(L(0), L(79))).alias("i")).filter("k % 4 <> 3 or i < 50")
    inside, after = D("i").between(40, 49), D("i") > 49
    up = F.when(inside, F.when(D("k") % 4 <= 1, 60.0).otherwise(5.0)).when(after & (D("k") % 4 == 1), 60.0).otherwise(0.0)
    days = rows.select("k", F.date_add(L("2023-12-01").cast("date"), D("i")).alias("day"), up.alias("up"), L(1.5).alias("ratio"), L(2.0).alias("noise"))
    e = read(spark, d, "supplier").select(k.alias("k"), L("2024-01-10").cast("date").alias("first"), L("2024-01-19").cast("date").alias("last"))
    return windows.bumps(e, days, ["k"], "day", "up", "ratio", "noise").select("k", "kept", "provisional")


@query("""SELECT row_id FROM sil_events WHERE magnitude BETWEEN 0.5 AND 2 AND depth_km IS NOT NULL AND NOT isnan(depth_km) AND origin_time >= TIMESTAMP '2026-08-15'""")
def p08_legacy_subset(spark, d):
    """Bounds and a window, rows with a missing value dropped."""
    from seiche.operators.predicates import bounds

    e = read(spark, d, "sil_events").filter(bounds("magnitude", 0.5, 2)).filter(plans.within("origin_time", "2026-08-15", None))
    return e.filter(geo.number("depth_km").isNotNull()).select("row_id")


@query("SELECT row_id, CAST(row_number() OVER (ORDER BY origin_time, row_id) AS BIGINT) AS place FROM sil_events WHERE origin_time IS NOT NULL")
def o01_time_order(spark, d):
    """The place of every event in order of time: by the counts of the days before, then within the day."""
    from pyspark.sql import Window as W

    e = read(spark, d, "sil_events").filter("origin_time is not null").select("row_id", D("origin_time").cast("date").alias("day"), "origin_time")
    # One row a day.
    days = e.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("day")) - D("n")).drop("n")
    return e.join(days, "day").select("row_id", (D("before") + F.row_number().over(W.partitionBy("day").orderBy("origin_time", "row_id"))).alias("place"))


@query("SELECT k, v FROM (VALUES ('ends', 'k,a,b,z'), ('set', 'k,b,a,z')) t(k, v)")
def o04_column_order(spark, d):
    """Listed columns first, the others after them in their order."""
    df = spark.createDataFrame([(1, 2, 3, 4)], "z int, a int, k int, b int")
    rows = [("ends", ",".join(schema.ordered(df, ["k", "a", "b"]).columns)), ("set", ",".join(schema.ordered(df, ["k", "b"]).columns[:2] + ["a", "z"]))]
    return spark.createDataFrame(rows, "k string, v string")


@query("SELECT * FROM (VALUES ('csv', TRUE), ('gbis.txt', TRUE), ('gmt', TRUE), ('jsonl', TRUE), ('pdf', FALSE), ('xlsx', TRUE)) t(suffix, written)")
def k08_dispatch(spark, d):
    """A set of records goes to the writer of its suffix."""
    rows = []
    for suffix in ("csv", "gbis.txt", "gmt", "jsonl", "pdf", "xlsx"):
        try:
            sinks.writer_of(f"/x/set.{suffix}")
            rows.append((suffix, True))
        except ValueError:
            rows.append((suffix, False))
    return spark.createDataFrame(rows, "suffix string, written boolean")


@query("SELECT * FROM (VALUES ('STA,N,E', 1), ('AAAA,1,2', 2), ('BBBB,5,6', 3), ('CCCC,7,8', 4)) t(line, no)")
def k30_upserted_rows(spark, d):
    """A station's row of a CSV replaced, or added at its end."""
    text_ = sinks.upserted_row("STA,N,E\nAAAA,1,2\nBBBB,3,4\n", "BBBB,5,6")
    text_ = sinks.upserted_row(text_, "CCCC,7,8")
    return spark.createDataFrame([(line, n) for n, line in enumerate(text_.splitlines(), 1)], "line string, no int")


@query("""SELECT o_custkey, round(1.5::DOUBLE, 4) AS p0, round(0.25, 4) AS p1 FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) WHERE n >= 3""")
def x04_fitted_function(spark, d):
    """A user's model of any form, fitted to each group."""
    import numpy as np

    from seiche.models.trajectory import fitted_function

    o = read(spark, d, "orders").select("o_custkey", (D("o_orderkey") % 1000 / L(100.0)).alias("x")).withColumn("y", 1.5 * F.exp(-0.25 * D("x")))
    w = o.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 3").select("o_custkey")
    out = fitted_function(o.join(w, "o_custkey"), ["o_custkey"], "x", "y", lambda x, a, b: a * np.exp(-b * x), (1.0, 0.1))
    return out.select("o_custkey", F.round("p0", 4).alias("p0"), F.round("p1", 4).alias("p1"))


@query("SELECT rec_id, strftime(CAST(make_timestamp(CAST(floor(t) AS INT), 1, 1, 0, 0, 0.0) + to_seconds(CAST(round_even((t - floor(t)) * (CASE WHEN floor(t) % 4 = 0 THEN 366 ELSE 365 END) * 86400, 0) AS BIGINT)) AS TIMESTAMP), '%Y/%m/%d %H:%M:%S') AS time FROM series_epochs")
def f43_formatted_times(spark, d):
    """Times of a series in a user's format."""
    from seiche.functions import timeaxis

    return read(spark, d, "series_epochs").select("rec_id", F.date_format(timeaxis.instant_of(D("t")), "yyyy/MM/dd HH:mm:ss").alias("time"))


@query("SELECT row_id, round(log10(CASE WHEN NOT isnan(seismic_moment) THEN seismic_moment END), 6) AS log_m0 FROM skjalftalisa_quakes WHERE seismic_moment IS NOT NULL AND NOT isnan(seismic_moment)")
def x06_user_relation(spark, d):
    """A user's own relation of moment and magnitude beside the known ones."""
    mine = (*moment.RELATIONS, moment.Relation("mine", "Mine", 9.0, 1.5))
    q = read(spark, d, "skjalftalisa_quakes").filter(geo.number("seismic_moment").isNotNull())
    value, _ = moment.moment_estimate(L(None).cast("double"), L(None).cast("double"), (F.log10("seismic_moment") - 9.0) / 1.5, L("Mine"), mine)
    return q.select("row_id", F.round(F.log10(value), 6).alias("log_m0"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 20")
def x01_injected_reader(spark, d):
    """A reader registered by its name serves its part of a window."""
    n = read(spark, d, "nation")

    def reader(session, start, end):
        rows = n.filter("n_nationkey < 20")
        return rows.select(F.date_add(L("2020-01-01").cast("date"), D("n_nationkey")).cast("timestamp_ntz").alias("time"), D("n_nationkey").cast("string").alias("event_id"), L(64.0).alias("latitude"), L(-20.0).alias("longitude"), D("n_name").alias("extra_name"))

    from seiche.operators.predicates import Selection

    out = plans.catalogue_for(spark, Selection(box=(-25.0, -15.0, 60.0, 70.0)), "2019-01-01", "2021-01-01", sources=["mine"], seams=[], readers={"mine": reader})
    return out.select(D("event_id").cast("int").alias("k"), D("extra_name").alias("name"))


@query("SELECT CAST(strftime(TIMESTAMP '2024-01-01' + to_hours(i), '%Y-%m-%dT%H:00:00+00:00') AS VARCHAR) AS event_id FROM range(0, 48) t(i)")
def s42_paged_list(spark, d):
    """A service's list in windows halved until each is small enough, through a transport of our own."""
    spark.dataSource.register(web.PagedSource)
    df = spark.read.format("seiche_paged").option("transport", "seiche.catalogue_events:_transport").option("url", "x").option("start", "2024-01-01").option("end", "2024-01-03").option("limit", "10").load()
    return df.select("event_id")


def _transport(url: str, asked: dict[str, str]) -> str:
    start, end = (dt.datetime.fromisoformat(asked[k].replace("Z", "+00:00")) for k in ("starttime", "endtime"))
    events = [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=k) for k in range(48)]
    inside = [e for e in events if start <= e < end]
    return json.dumps({"count": len(inside)} if asked["format"] == "count" else {"features": [{"properties": {"event_id": e.isoformat()}} for e in inside]})
