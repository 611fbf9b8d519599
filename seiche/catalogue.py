"""The operators as queries over the driver's tables, and the SQL that gives the same rows.

Transcendental results and interpolated quantiles are rounded on both sides: the engines' last
bits differ. Sums that run over many rows are made on decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.functions import geo, moment, text, timeaxis
from seiche.operators import aggregates as agg
from seiche.operators import joins, predicates, schema, windows
from seiche.queries import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _placed(df: DataFrame, key: str) -> DataFrame:
    """Deterministic places for tables without coordinates."""
    return df.withColumns({"lat": (F.col(key) * 37 % 1800) / 10.0 - 90, "lon": (F.col(key) * 73 % 3600) / 10.0 - 180})


_PLACED = "((c_custkey * 37) % 1800) / 10.0::DOUBLE - 90 AS lat, ((c_custkey * 73) % 3600) / 10.0::DOUBLE - 180 AS lon"
_SPLACED = "((s_suppkey * 37) % 1800) / 10.0::DOUBLE - 90 AS lat, ((s_suppkey * 73) % 3600) / 10.0::DOUBLE - 180 AS lon"
_SECONDS = "(epoch_us(ts) / 1000000.0::DOUBLE)"


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


# Predicates


@query("SELECT event_id, user_id, value FROM events WHERE value BETWEEN 10 AND 50 AND event_type IN ('click', 'view')")
def p01_subset(spark, d):
    e = read(spark, d, "events")
    kept = e.filter(predicates.bounds("value", 10, 50) & predicates.one_of("event_type", ["click", "view"], known=["click", "error", "purchase", "signup", "view"]))
    return kept.select("event_id", "user_id", "value")


_RING = [(-60.0, -30.0), (80.0, -50.0), (120.0, 40.0), (10.0, 75.0), (-20.0, 10.0)]


def _ring_sql(x: str, y: str) -> str:
    out = "FALSE"
    for (x0, y0), (x1, y1) in zip(_RING, _RING[1:] + _RING[:1]):
        out = f"({out} <> ((({y} < {y0}) <> ({y} < {y1})) AND ({x} < ({y} - {y0}) * ({(x1 - x0) / (y1 - y0)!r}) + {x0})))"
    return out


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {_PLACED} FROM customer) WHERE {_ring_sql('lon', 'lat')}")
def p02_polygon(spark, d):
    c = _placed(read(spark, d, "customer"), "c_custkey")
    return c.filter(geo.in_polygon(F.col("lon"), F.col("lat"), _RING)).select("c_custkey")


@query(f"""SELECT c_custkey, round(km, 6) AS km FROM (
  SELECT c_custkey, sqrt(pow((lat - 10) * 111.19, 2) + pow((lon - 20) * 111.19 * cos(radians((lat + 10) / 2)), 2)) km
  FROM (SELECT c_custkey, {_PLACED} FROM customer)) WHERE km <= 3000""")
def p04_within_km(spark, d):
    """The equirectangular distance."""
    c = _placed(read(spark, d, "customer"), "c_custkey")
    km = geo.equirectangular_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return c.withColumn("km", km).filter("km <= 3000").select("c_custkey", F.round("km", 6).alias("km"))


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, {_PLACED} FROM customer)
WHERE lon BETWEEN -50 AND 60 AND lat BETWEEN -20 AND 45""")
def p05_selection(spark, d):
    c = _placed(read(spark, d, "customer"), "c_custkey").withColumn("event_type", F.lit(None).cast("string"))
    chosen = predicates.Selection(box=(-50.0, 60.0, -20.0, 45.0), event_types=("earthquake",))
    return c.filter(chosen.condition("lon", "lat")).select("c_custkey")


@query("""SELECT event_id, origin_time FROM sil_events
WHERE NOT (evaluation_mode = 'automatic' AND magnitude IS NOT NULL AND magnitude < 0.5)""")
def p12_quality_floor(spark, d):
    return read(spark, d, "sil_events").filter(predicates.quality_floor(0.5, quality="magnitude")).select("event_id", "origin_time")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN l_discount END AS l_discount,
CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN l_returnflag END AS l_returnflag FROM lineitem WHERE l_quantity BETWEEN 5 AND 45""")
def p09_range_guard(spark, d):
    rows = predicates.guarded(read(spark, d, "lineitem"), {"l_discount": (0.02, 0.08), "l_quantity": (5, 45)}, ["l_quantity"], {"l_discount": "l_returnflag"})
    return rows.select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def p14_half_open(spark, d):
    import datetime as dt

    at = F.col("ts").cast("timestamp_ntz")
    return read(spark, d, "events").withColumn("ts", at).filter(predicates.half_open("ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))).select("event_id", "ts")


@query("SELECT rec_id FROM series_epochs WHERE sigma < 5 AND NOT coalesce(component IN ('U'), false)")
def p15_noise_screen(spark, d):
    return read(spark, d, "series_epochs").filter(predicates.noise_screen(["sigma"], 5, "component", ["U"])).select("rec_id")


@query("SELECT n_nationkey FROM nation WHERE regexp_matches(n_name, '^NATION_1') OR regexp_matches(n_name, '^NAT.*_[2-4]$')")
def p19_glob(spark, d):
    return read(spark, d, "nation").filter(predicates.glob_match(F.col("n_name"), ["NATION_1*", "NAT*_[2-4]"])).select("n_nationkey")


@query("""SELECT count(*) FILTER (WHERE o_custkey IS NULL) AS missing_o_custkey,
count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 300000) AS outside_o_totalprice,
count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS unknown_o_orderstatus,
count(*) - count(DISTINCT o_orderkey) AS repeated_key, count(*) AS n_rows FROM orders""")
def p27_validate(spark, d):
    return schema.checks(read(spark, d, "orders"), required=["o_custkey"], ranges={"o_totalprice": (1000, 300000)}, allowed={"o_orderstatus": ["F", "O"]}, key=["o_orderkey"])


# Aggregates


@query("""
WITH f AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events WHERE value BETWEEN 1 AND 100),
s AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM f), (SELECT max(d) FROM f), INTERVAL 1 DAY)) AS DATE) AS d)
SELECT s.d AS d, k.event_type AS event_type, count(f.d) AS n
FROM s CROSS JOIN (SELECT DISTINCT event_type FROM f) k LEFT JOIN f ON f.d = s.d AND f.event_type = k.event_type
GROUP BY s.d, k.event_type""")
def a01_daily_counts_by(spark, d):
    return agg.daily_counts(read(spark, d, "events").filter(predicates.bounds("value", 1, 100)), "ts", by="event_type")


@query("""WITH f AS (SELECT CAST(ts AS DATE) d FROM events WHERE event_type = 'signup'),
s AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM f), (SELECT max(d) FROM f), INTERVAL 1 DAY)) AS DATE) AS d)
SELECT s.d AS d, count(f.d) AS n FROM s LEFT JOIN f USING (d) GROUP BY s.d""")
def a01_daily_counts(spark, d):
    return agg.daily_counts(read(spark, d, "events").filter("event_type = 'signup'"), "ts")


@query("""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) OVER (ORDER BY o_orderdate, o_orderkey
ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders""")
def a02_cumulative(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return agg.running_totals(o, "o_totalprice", "day", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "running")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) AS quantity,
count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a03_summary(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(28,2)")).cast("double").alias("quantity"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a25_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50,
round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY event_type""")
def a04_quantiles(spark, d):
    out = agg.quantile_summary(read(spark, d, "events"), "value", [0.05, 0.5, 0.95], ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("q05", "q50", "q95")])


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, median(value) AS value, count(*) AS n FROM events GROUP BY 1")
def a05_bucket_median(spark, d):
    return agg.bucket_medians(read(spark, d, "events"), "ts", "10 minutes", ["value"])


@query("""SELECT CAST(ts AS DATE) AS day, median(m) AS value, count(*) AS n FROM
(SELECT user_id, CAST(ts AS DATE) ts, median(value) m FROM events GROUP BY 1, 2) GROUP BY 1""")
def a07_cross_median(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    own = e.groupBy("user_id", "day").agg(F.median(agg.missing("value")).alias("m"))
    return own.groupBy("day").agg(F.median("m").alias("value"), F.count("*").alias("n"))


@query("""SELECT CAST(ts AS DATE) AS day, CASE WHEN count(value) >= 15 THEN round_even(median(value), 2) END AS common_mode,
count(value) AS n FROM events GROUP BY 1""")
def a10_common_mode(spark, d):
    return agg.common_mode(read(spark, d, "events").withColumn("day", F.col("ts").cast("date")), "day", "value")


@query("""WITH v AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_votes, count(*) FILTER (WHERE value > 60) AS n_dominant FROM events GROUP BY 1)
SELECT day, n_votes, n_dominant, round(n_dominant / n_votes, 9) AS share, CASE WHEN n_votes < 3 THEN 'incomplete' WHEN n_dominant / n_votes >= 0.5 THEN 'decided'
WHEN n_dominant > 0 THEN 'partial' ELSE '' END AS status FROM v""")
def a09_day_votes(spark, d):
    rows = read(spark, d, "events").select(F.col("ts").cast("date").alias("day"), (F.col("value") > 60).alias("dominant"))
    return agg.votes_by_day(rows, "day", "dominant").withColumn("share", F.round("share", 9))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY day DESC) k FROM c)
SELECT day, n FROM r WHERE k <= 3 AND n < 0.999 * (SELECT median(n) FROM r WHERE k BETWEEN 4 AND 17)
AND (SELECT count(*) FROM r WHERE k BETWEEN 4 AND 17) >= 7""")
def a11_incomplete_days(spark, d):
    """Newest days that are not yet whole (A11, ST06)."""
    counts = agg.daily_counts(read(spark, d, "events"), "ts")
    return agg.incomplete_newest(counts, "d", "n", share=0.999).select(F.col("d").alias("day"), "n")


@query("""SELECT l_suppkey, round(sum(l_extendedprice / pow(l_quantity, 2)) / sum(1 / pow(l_quantity, 2)), 4) AS mean,
round(sqrt(1 / sum(1 / pow(l_quantity, 2))), 6) AS sigma FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey""")
def a13_weighted_mean(spark, d):
    mean, sigma = agg.weighted_mean("l_extendedprice", "l_quantity")
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(mean, 4).alias("mean"), F.round(sigma, 6).alias("sigma"))


@query("""WITH e AS (SELECT l_suppkey k, epoch(l_shipdate) / 86400.0 t, l_extendedprice y, l_quantity s FROM lineitem),
b AS (SELECT k, min(t) a, max(t) z FROM e GROUP BY k)
SELECT k AS l_suppkey, round(sum(CASE WHEN t < a + 200 THEN y / (s * s) END) / sum(CASE WHEN t < a + 200 THEN 1 / (s * s) END), 4) AS start,
round(sum(CASE WHEN t > z - 200 THEN y / (s * s) END) / sum(CASE WHEN t > z - 200 THEN 1 / (s * s) END), 4) AS "end",
round(sqrt(1 / sum(CASE WHEN t < a + 200 THEN 1 / (s * s) END) + 1 / sum(CASE WHEN t > z - 200 THEN 1 / (s * s) END)), 6) AS sigma
FROM e JOIN b USING (k) GROUP BY k""")
def a14_end_displacement(spark, d):
    rows = read(spark, d, "lineitem").withColumn("t", _seconds("l_shipdate") / 86400.0)
    out = agg.end_displacement(rows, ["l_suppkey"], "t", "l_extendedprice", "l_quantity", 200.0)
    return out.select("l_suppkey", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("sigma", 6).alias("sigma"))


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) r,
count(*) OVER (PARTITION BY l_suppkey) n FROM lineitem)
SELECT l_suppkey, round(avg(v) FILTER (n >= 3 AND r > n // 3 AND r <= n - n // 3), 4) AS trimmed_mean, count(*) AS n FROM r GROUP BY l_suppkey""")
def a17_trimmed_mean(spark, d):
    out = agg.trimmed_mean(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return out.withColumn("trimmed_mean", F.round("trimmed_mean", 4))


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) m FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - m, 4) AS departure FROM lineitem JOIN m USING (l_returnflag)""")
def a19_group_departure(spark, d):
    out = agg.group_difference_from_median(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", F.round("departure", 4).alias("departure"))


@query("""WITH r AS (SELECT user_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) f,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) l FROM events)
SELECT user_id, round(avg(v) FILTER (l <= 5) - avg(v) FILTER (f <= 5), 6) AS shift FROM r GROUP BY user_id""")
def a22_shift(spark, d):
    return agg.end_shift(read(spark, d, "events"), ["user_id"], "value", ["ts", "event_id"], 5).withColumn("shift", F.round("shift", 6))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) r FROM orders) WHERE r > 1""")
def a23_drop_first(spark, d):
    o = read(spark, d, "orders")
    first = windows.first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return o.join(first.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


# Windows


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey) r FROM lineitem) WHERE r = 1""")
def w01_smallest_sigma(spark, d):
    rows = windows.first_per_key(read(spark, d, "lineitem"), ["l_orderkey"], [F.coalesce(geo.number("l_discount"), F.lit(float("inf"))), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return rows.select("l_orderkey", "l_linenumber")


@query("""SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id,
row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) r FROM events) WHERE r = 1""")
def w04_first_wins(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return windows.first_per_key(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "day", "event_id")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2""")
def w05_last_wins(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return e.groupBy("user_id", "day").agg(F.max(F.struct("ts", "event_id")).getField("event_id").alias("event_id"))


@query("""SELECT event_id, row_id, round(magnitude, 6) AS magnitude FROM (
  SELECT event_id, row_id, magnitude, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(depth_km, '-inf'::DOUBLE) DESC, row_id DESC) r FROM sil_events) WHERE r = 1""")
def w06_best_quality(spark, d):
    rows = read(spark, d, "sil_events").select("event_id", "row_id", "depth_km", "magnitude")
    return windows.best_quality(rows, ["event_id"], "depth_km", "row_id").select("event_id", "row_id", F.round("magnitude", 6).alias("magnitude"))


@query("""WITH v AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) v FROM events GROUP BY 1)
SELECT day, round(CASE WHEN count(v) OVER w >= 5 THEN quantile_cont(v, 0.25) OVER w END, 6) AS q FROM v
WINDOW w AS (ORDER BY day RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def w07_rolling_quantile(spark, d):
    v = read(spark, d, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    v = v.withColumn("k", F.lit(0))
    return v.withColumn("q", F.round(windows.rolling_quantile("v", 0.25, ["k"], "day", 5, 5), 6)).select("day", "q")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000
THEN 0 ELSE 1 END n FROM events),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS island, min(ts) AS "first", max(ts) AS "last", count(*) AS n FROM i GROUP BY 1, 2""")
def w09_islands(spark, d):
    return windows.islands(read(spark, d, "events"), ["user_id"], "ts", 6 * 3600.0, "event_id")


@query("""WITH s AS (SELECT *, last_value(CASE WHEN value > 90 THEN 1 WHEN value <= 60 THEN 0 END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM events)
SELECT event_id, coalesce(k, 0) = 1 AS inside FROM s""")
def w10_hysteresis(spark, d):
    e = read(spark, d, "events")
    flag = windows.hysteresis(F.col("value") > 90, F.col("value") > 60, F.col("value").isNotNull(), ["user_id"], ["ts", "event_id"])
    return e.select("event_id", flag.alias("inside"))


@query("SELECT event_id, round(value - first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS value FROM events")
def w15_rezero(spark, d):
    return read(spark, d, "events").select("event_id", F.round(windows.rezeroed(F.col("value"), ["user_id"], ["ts", "event_id"]), 6).alias("value"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY abs(date_diff('day', DATE '2024-01-15', CAST(ts AS DATE))), ts, event_id) r FROM events) WHERE r <= 3""")
def w16_nearest_days(spark, d):
    w = W.partitionBy("user_id").orderBy(F.abs(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-15").cast("date"))), "ts", "event_id")
    return read(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("user_id", "event_id")


@query("""SELECT user_id, round(max(g) / 1000000.0, 6) AS largest_gap_s FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER
(PARTITION BY user_id ORDER BY ts, event_id) g FROM events) GROUP BY 1""")
def w18_largest_gap(spark, d):
    return windows.largest_gap(read(spark, d, "events"), ["user_id"], "ts", "event_id").withColumn("largest_gap_s", F.round("largest_gap_s", 6))


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) m FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, m, 1.4826 * median(abs(l_extendedprice - m)) s FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN s USING (l_suppkey) WHERE abs(l_extendedprice - m) <= 1.5 * s""")
def w19_mad_reject(spark, d):
    return windows.mad_kept(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber")


@query(f"""SELECT event_id, round(value - 0.5 * ({_SECONDS} - min({_SECONDS}) OVER (PARTITION BY user_id)) / 31557600.0, 6) AS value FROM events""")
def w20_ramp(spark, d):
    e = read(spark, d, "events").withColumn("years", _seconds("ts") / 31557600.0)
    return e.select("event_id", F.round(windows.ramp_removed("value", F.lit(0.5), "years", ["user_id"]), 6).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25""")
def o02_top(spark, d):
    return read(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


# Joins


@query("""SELECT coalesce(c.c_custkey, o.o_custkey) AS custkey, c.c_mktsegment AS segment, o.n AS n FROM customer c
FULL OUTER JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def j01_full_outer(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "full_outer").select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), "n")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) k, o_orderstatus s FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) k, o_orderstatus s FROM orders WHERE o_orderkey % 2 = 1)
SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.s = b.s AND a.k = b.k""")
def j02_ordinal(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = o.filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "a_key")
    b = o.filter("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "b_key")
    return joins.ordinal_join(a, b, ["o_custkey", "o_orderstatus"], "a_key", "b_key").select("a_key", "b_key")


_SIL_T = """SELECT row_id, epoch_us(origin_time) / 1000000.0::DOUBLE t, coordinates[1] lon, coordinates[2] lat, evaluation_mode = 'automatic' a,
CASE WHEN magnitude IS NULL OR isnan(magnitude) THEN '-inf'::DOUBLE ELSE magnitude END q FROM sil_events WHERE origin_time IS NOT NULL AND coordinates[1] IS NOT NULL AND coordinates[2] IS NOT NULL"""


def _sil(spark, d):
    e = read(spark, d, "sil_events").withColumns({"t": _seconds("origin_time"), "lon": F.try_element_at("coordinates", F.lit(1)), "lat": F.try_element_at("coordinates", F.lit(2)), "automatic": F.col("evaluation_mode") == "automatic"})
    return e.filter("t is not null and lon is not null and lat is not null")


@query(f"""WITH e AS ({_SIL_T}) SELECT row_id AS "row", CASE WHEN a THEN EXISTS (SELECT 1 FROM e o WHERE o.row_id <> e.row_id AND abs(o.t - e.t) <= 2
AND sqrt(pow((o.lat - e.lat) * 111.19, 2) + pow((o.lon - e.lon) * 111.19 * cos(radians((o.lat + e.lat) / 2)), 2)) <= 10
AND (NOT o.a OR o.q > e.q OR (o.q = e.q AND o.row_id > e.row_id))) END AS possible_duplicate FROM e""")
def j06_duplicates(spark, d):
    return joins.duplicates_flagged(_sil(spark, d), row="row_id", t="t", lat="lat", lon="lon", automatic="automatic", quality="magnitude")


@query()
def j09_match(spark, d):
    """Greedy linkage of the two catalogues; tested against a sequential loop."""
    sil = _sil(spark, d).select(F.col("row_id").alias("id"), "t", "lat", "lon")
    other = read(spark, d, "seiscomp_events").select(F.col("row_id").alias("id"), _seconds("origin_time").alias("t"), F.try_element_at("coordinates", F.lit(2)).alias("lat"), F.try_element_at("coordinates", F.lit(1)).alias("lon")).filter("t is not null and lat is not null and lon is not null")
    return joins.catalogue_match(sil, other, seconds=2.0, km=10.0)


@query("""WITH a AS (SELECT o_custkey k, min(o_orderkey) a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) = 1),
b AS (SELECT o_custkey k, min(o_orderkey) b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) = 1)
SELECT a AS a_key, b AS b_key FROM a JOIN b USING (k)""")
def j10b_unique_key(spark, d):
    o = read(spark, d, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ka"), F.col("o_orderkey").alias("a_key"))
    b = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("kb"), F.col("o_orderkey").alias("b_key"))
    return joins.unique_key_join(a, b, "ka", "kb").select("a_key", "b_key")


@query(f"""WITH p AS (SELECT event_id a, user_id u, {_SECONDS} t FROM events WHERE event_type = 'purchase'),
c AS (SELECT event_id b, user_id u, {_SECONDS} s FROM events WHERE event_type = 'click')
SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY abs(t - s), s, b) r FROM p JOIN c USING (u) WHERE abs(t - s) < 86400) WHERE r = 1""")
def j11_nearest(spark, d):
    e = read(spark, d, "events").withColumn("s", _seconds("ts"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("t"))
    c = e.filter("event_type = 'click'").select("user_id", F.col("s").alias("t_b"), F.col("event_id").alias("b"))
    return joins.nearest_join(p, c, "t", "t_b", 86400.0, "a", ["user_id"]).select("a", "b")


@query("""SELECT o_orderkey, CAST(coalesce((SELECT sum(r.n) FROM (SELECT 'F' s, TIMESTAMP '1995-01-01' b, 3.0 n UNION ALL SELECT 'F', TIMESTAMP '1997-06-01', 5.0 UNION ALL
SELECT 'O', TIMESTAMP '1996-01-01', 7.0) r WHERE r.s = o.o_orderstatus AND r.b > o.o_orderdate), 0) AS DOUBLE) AS amount FROM orders o""")
def j12_step_sums(spark, d):
    rules = spark.createDataFrame([("F", "1995-01-01", 3.0), ("F", "1997-06-01", 5.0), ("O", "1996-01-01", 7.0)], "o_orderstatus string, before string, n double").withColumn("before", F.col("before").cast("timestamp_ntz"))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    # A month's orders of a status share a group of the cumulative sum with the rules.
    return joins.step_sums(o, rules, "at", "before", "n", ["o_orderstatus"], "amount").select("o_orderkey", "amount")


@query("""WITH m AS (SELECT CAST(ts AS DATE) d, median(value) m FROM events GROUP BY 1)
SELECT event_id, round(coalesce(value - m, value), 6) AS value FROM events LEFT JOIN m ON CAST(ts AS DATE) = d""")
def j14_day_subtract(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    mode = e.groupBy("day").agg(F.median("value").alias("m"))
    return e.join(mode, "day", "left").select("event_id", F.round(F.coalesce(F.col("value") - F.col("m"), "value"), 6).alias("value"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) d, avg(value) v FROM events WHERE user_id IN (1, 2) GROUP BY 1, 2),
j AS (SELECT a.d, a.v - b.v v FROM s a JOIN s b ON a.d = b.d AND a.user_id = 1 AND b.user_id = 2)
SELECT d, round(v - first_value(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS v FROM j""")
def j19_baseline(spark, d):
    s = read(spark, d, "events").filter("user_id in (1, 2)").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.avg("value").alias("v"))
    a, b = (s.filter(F.col("user_id") == k).select("d", F.col("v").alias(f"v{k}")) for k in (1, 2))
    ends = a.join(b, "d").withColumn("k", F.lit(0))
    return ends.select("d", F.round(windows.rezeroed(F.col("v1") - F.col("v2"), ["k"], ["d"]), 6).alias("v"))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) d, avg(value) v FROM events GROUP BY 1, 2),
j AS (SELECT a.user_id, a.d, a.v - b.v v FROM s a JOIN s b ON a.d = b.d AND b.user_id = (SELECT min(user_id) FROM events) AND a.user_id <> b.user_id)
SELECT user_id, d, round(v - first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS v FROM j""")
def j19_baseline_all(spark, d):
    """The baselines of every user against the first."""
    s = read(spark, d, "events").filter("user_id is not null").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.avg("value").alias("v"))
    reference = s.groupBy("d").agg(F.min_by(F.struct("user_id", "v"), "user_id").alias("r"))
    first = s.agg(F.min("user_id").alias("user"))
    reference = reference.join(first, F.col("r.user_id") == F.col("user")).select("d", "user", F.col("r.v").alias("v_ref"))
    ends = s.join(reference, "d").filter("user_id <> user")
    return ends.select("user_id", "d", F.round(windows.rezeroed(F.col("v") - F.col("v_ref"), ["user_id"], ["d"]), 6).alias("v"))


@query(f"""WITH s AS (SELECT s_suppkey, {_SPLACED} FROM supplier)
SELECT a, b, round(km, 6) AS km FROM (SELECT x.s_suppkey a, y.s_suppkey b, sqrt(pow((y.lat - x.lat) * 111.19, 2) + pow((y.lon - x.lon) * 111.19 * cos(radians((x.lat + y.lat) / 2)), 2)) km
FROM s x JOIN s y ON x.s_suppkey < y.s_suppkey) WHERE km <= 1500""")
def j22_pairs(spark, d):
    s = _placed(read(spark, d, "supplier"), "s_suppkey")
    return joins.pairs_within(s, station="s_suppkey", max_km=1500.0).withColumn("km", F.round("km", 6))


@query("""SELECT o_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ';' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines FROM orders
JOIN lineitem ON l_orderkey = o_orderkey AND o_orderdate <= l_shipdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY GROUP BY 1""")
def j24_valid_time(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")  # noqa: E741
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 60 days")).alias("until"))
    held = joins.valid_at(l, o, "l_shipdate", "o_orderdate", "until", ["o_orderkey"], closed=False)
    return held.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ";").alias("lines"))


@query("""WITH b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name || '!' ELSE n_name END n_name, n_regionkey + (n_nationkey % 7 = 0)::INT n_regionkey FROM nation WHERE n_nationkey <> 3)
SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, 'key' AS field, CAST(a.n_nationkey AS VARCHAR) AS a, CAST(b.n_nationkey AS VARCHAR) AS b FROM nation a FULL JOIN b USING (n_nationkey) WHERE a.n_name IS NULL OR b.n_name IS NULL
UNION ALL SELECT n_nationkey, 'n_name', a.n_name, b.n_name FROM nation a JOIN b USING (n_nationkey) WHERE a.n_name <> b.n_name
UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(a.n_regionkey AS VARCHAR), CAST(b.n_regionkey AS VARCHAR) FROM nation a JOIN b USING (n_nationkey) WHERE abs(a.n_regionkey - b.n_regionkey) > 0.5""")
def j31_compare(spark, d):
    n = read(spark, d, "nation")
    b = n.filter("n_nationkey <> 3").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("n_name"), (F.col("n_regionkey") + (F.col("n_nationkey") % 7 == 0).cast("int")).alias("n_regionkey"))
    return joins.compared(n, b, "n_nationkey", numbers={"n_regionkey": 0.5}, exact=["n_name"])


@query(f"""WITH s AS (SELECT s_suppkey, {_SPLACED} FROM supplier), c AS (SELECT c_custkey, {_PLACED} FROM customer)
SELECT c_custkey, station, round(km, 6) AS km, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY km, station) AS INT) r FROM (
SELECT c_custkey, s_suppkey station, sqrt(pow((s.lat - c.lat) * 111.19, 2) + pow((s.lon - c.lon) * 111.19 * cos(radians((s.lat + c.lat) / 2)), 2)) km FROM c, s)) WHERE r <= 3""")
def j33_k_nearest(spark, d):
    c, s = _placed(read(spark, d, "customer"), "c_custkey"), _placed(read(spark, d, "supplier"), "s_suppkey")
    return joins.k_nearest(c, s, 3, point="c_custkey", station="s_suppkey", start_km=4000.0, max_km=60000.0).withColumn("km", F.round("km", 6))


@query(f"""WITH s AS (SELECT s_suppkey, s_acctbal v, {_SPLACED} FROM supplier),
p AS (SELECT x.s_suppkey k, y.v, sqrt(pow((y.lat - x.lat) * 111.19, 2) + pow((y.lon - x.lon) * 111.19 * cos(radians((x.lat + y.lat) / 2)), 2)) km FROM s x JOIN s y ON x.s_suppkey <> y.s_suppkey)
SELECT k AS s_suppkey, round(sum(exp(-pow(km / 700, 2) / 2) * v) / sum(exp(-pow(km / 700, 2) / 2)), 4) AS s_acctbal, count(*) AS n FROM p WHERE km <= 2500 GROUP BY 1""")
def j36_kernel(spark, d):
    s = _placed(read(spark, d, "supplier"), "s_suppkey")
    out = joins.kernel_mean(s, s, station="s_suppkey", value="s_acctbal", length_km=700.0, radius_km=2500.0)
    return out.select("s_suppkey", F.round("s_acctbal", 4).alias("s_acctbal"), "n")


@query("""WITH q AS (SELECT row_id, CAST(regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT) ev, CASE WHEN lower(trim(originating_system)) = 'sil picks' THEN 'picks' ELSE 'auto' END s, depth_km FROM skjalftalisa_quakes),
o AS (SELECT *, row_number() OVER (PARTITION BY ev, s ORDER BY row_id) r FROM q), k AS (SELECT * FROM o WHERE r = 1)
SELECT ev AS event, coalesce(max(row_id) FILTER (s = 'picks'), max(row_id) FILTER (s = 'auto')) AS row_id, round(max(depth_km) FILTER (s = 'auto'), 6) AS auto_value, count(*) AS n_solutions FROM k GROUP BY ev""")
def j08_twins(spark, d):
    """Twins of an event with NaN kept as the value it is in the table."""
    return _twins(spark, d, nan_is_missing=False)


def _twins(spark, d, nan_is_missing: bool) -> DataFrame:
    q = read(spark, d, "skjalftalisa_quakes").select("row_id", text.canonical_number(F.col("event_id")).cast("long").alias("event"), F.when(F.lower(F.trim("originating_system")) == "sil picks", "picks").otherwise("auto").alias("system"), "depth_km")
    out = joins.resolved_twins(q, event="event", system="system", reviewed_system="picks", order=[F.col("row_id")], auto_value="depth_km", nan_is_missing=nan_is_missing)
    return out.select("event", "row_id", F.round("auto_value", 6).alias("auto_value"), "n_solutions")


@query("""WITH q AS (SELECT row_id, CAST(regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT) ev, CASE WHEN lower(trim(originating_system)) = 'sil picks' THEN 'picks' ELSE 'auto' END s,
CASE WHEN NOT isnan(depth_km) THEN depth_km END AS depth_km FROM skjalftalisa_quakes),
o AS (SELECT *, row_number() OVER (PARTITION BY ev, s ORDER BY row_id) r FROM q), k AS (SELECT * FROM o WHERE r = 1)
SELECT ev AS event, coalesce(max(row_id) FILTER (s = 'picks'), max(row_id) FILTER (s = 'auto')) AS row_id, round(max(depth_km) FILTER (s = 'auto'), 6) AS auto_value, count(*) AS n_solutions FROM k GROUP BY ev""")
def j08_twins_missing(spark, d):
    """As j08_twins, with NaN as a missing value."""
    return _twins(spark, d, nan_is_missing=True)


@query("""SELECT 'orders' AS source, o_orderkey AS k, o_orderdate AS at FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'lineitem', l_orderkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'""")
def u01_seam_union(spark, d):
    from seiche.plans.catalogue import seam_union

    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("at"))  # noqa: E741
    return seam_union([("orders", o), ("lineitem", l)], ["1996-01-01"], "at").select("source", "k", "at")


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT DISTINCT s_nationkey FROM supplier")
def u03_sets(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


# Functions


@query("""SELECT l_orderkey, l_linenumber, round(2.0::DOUBLE / 3 * log10(l_extendedprice * 1e9) - 6.0333, 6) AS mw,
round(1.5 * (l_quantity / 10 + 6.0333), 6) AS log_m0 FROM lineitem""")
def f01_moment(spark, d):
    """The moment magnitude and its inverse."""
    l = read(spark, d, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.round(moment.mw_from_moment(F.col("l_extendedprice") * 1e9), 6).alias("mw"), F.round(F.log10(moment.moment_from_mw(F.col("l_quantity") / 10)), 6).alias("log_m0"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity / 8 - 0.5 m FROM lineitem)
SELECT l_orderkey, l_linenumber, round(10 + m + (1 / 0.9::DOUBLE - 1) * greatest(m - 2, 0) + (1 / 0.8::DOUBLE - 1 / 0.9::DOUBLE) * greatest(m - 3, 0)
+ (1 / 0.7::DOUBLE - 1 / 0.8::DOUBLE) * greatest(m - 4.6, 0) + (1 / 0.5::DOUBLE - 1 / 0.7::DOUBLE) * greatest(m - 5.4, 0), 6) AS log_m0, round(m, 6) AS back FROM m""")
def f03_mlw(spark, d):
    """The piecewise relation and its inverse."""
    m = read(spark, d, "lineitem").withColumn("m", F.col("l_quantity") / 8 - 0.5)
    return m.select("l_orderkey", "l_linenumber", F.round(moment.log_moment_from_mlw(F.col("m")), 6).alias("log_m0"), F.round(moment.mlw_from_moment(moment.moment_from_mlw(F.col("m"))), 6).alias("back"))


@query("""SELECT row_id, round(log10(coalesce(CASE WHEN isnan(seismic_moment) THEN NULL ELSE seismic_moment END, pow(10, 10.41 + 1.045 * m))), 6) AS log_m0,
CASE WHEN seismic_moment IS NOT NULL AND NOT isnan(seismic_moment) THEN 'measured' WHEN m IS NOT NULL THEN 'seiscomp_ml_sil_m0' END AS relation FROM
(SELECT row_id, seismic_moment, CASE WHEN m_ml BETWEEN -3 AND 10 THEN m_ml END m FROM skjalftalisa_quakes)""")
def f06_moment_estimate(spark, d):
    q = read(spark, d, "skjalftalisa_quakes").withColumn("m", F.when(geo.number("m_ml").between(-3, 10), F.col("m_ml")))
    value, label = moment.moment_estimate(geo.number("seismic_moment"), F.lit(None).cast("double"), F.col("m"), F.lit("ML_SIL"))
    return q.select("row_id", F.round(F.log10(value), 6).alias("log_m0"), label.alias("relation"))


@query("""SELECT l_orderkey, l_linenumber, round(-1.69 * log10(r + 0.00299 * pow(10, 0.621 * m)) + 1.05 * m - 4.96, 6) AS log_pgv,
round((1.69 * log10(r) + log10(l_extendedprice * 1e-6) + 4.96) / 1.05, 6) AS far FROM (SELECT *, l_quantity r, l_tax * 50 m FROM lineitem)""")
def f07_ground_velocity(spark, d):
    """The ground-velocity model and its far-field inverse."""
    l = read(spark, d, "lineitem").withColumns({"r": F.col("l_quantity"), "m": F.col("l_tax") * 50})  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.round(F.log10(moment.ground_velocity(F.col("m"), F.col("r"))), 6).alias("log_pgv"), F.round(moment.magnitude_far(F.col("l_extendedprice"), F.col("r")), 6).alias("far"))


@query("""SELECT s_suppkey, round(m, 6) AS m FROM (SELECT s_suppkey, (s_suppkey % 80) / 10.0::DOUBLE m FROM supplier)""")
def f09_exact_inverse(spark, d):
    """The bisection finds the magnitude its forward model was given."""
    s = read(spark, d, "supplier").withColumns({"m": (F.col("s_suppkey") % 80) / F.lit(10.0), "r": 5.0 + F.col("s_suppkey") % 90})
    pgv = moment.ground_velocity(F.col("m"), F.col("r")) * 1e6
    return s.select("s_suppkey", F.round(moment.magnitude_exact(pgv, F.col("r")), 6).alias("m"))


@query("""SELECT row_id, CASE WHEN trim(event_code) = '' OR event_code IS NULL THEN NULL WHEN event_code IN ('qu', 'sm', 'te', 'un', 'ql') THEN 'earthquake' WHEN event_code = 'ex' THEN 'explosion'
WHEN event_code = 'ne' THEN 'not existing' ELSE 'other' END AS kind, regexp_extract(upper(trim(event_id)), '^(SIL)?0*([0-9]+)$', 2) AS number FROM skjalftalisa_quakes""")
def f24_event_type(spark, d):
    """Event types and numbers."""
    q = read(spark, d, "skjalftalisa_quakes")
    return q.select("row_id", text.event_type(F.col("event_code")).alias("kind"), text.canonical_number(F.col("event_id")).alias("number"))


@query("""SELECT event_id, round(year(ts) + (dayofyear(ts) - 1 + (hour(ts) * 3600 + minute(ts) * 60 + epoch_us(ts) % 60000000 / 1000000.0) / 86400.0) / CASE WHEN year(ts) % 4 = 0 THEN 366.0::DOUBLE ELSE 365 END, 9) AS yearf,
round(year(ts) + (dayofyear(ts) - 0.5) / CASE WHEN year(ts) % 4 = 0 THEN 366.0::DOUBLE ELSE 365 END, 9) AS noon FROM events""")
def f34_years(spark, d):
    """Fractional years and those of noon."""
    e = read(spark, d, "events")
    return e.select("event_id", F.round(timeaxis.fractional_year(F.col("ts")), 9).alias("yearf"), F.round(timeaxis.noon_year(F.col("ts").cast("date")), 9).alias("noon"))


@query("SELECT rec_id, CAST(round_even(t * 365.25, 0) AS BIGINT) AS k, CAST(floor(t) AS BIGINT) AS y FROM series_epochs")
def f36_day_keys(spark, d):
    return read(spark, d, "series_epochs").select("rec_id", timeaxis.day_key(F.col("t")).alias("k"), F.floor("t").alias("y"))


@query("""SELECT user_id, round(sqrt(sum(value * value)), 6) AS length, round(degrees(atan2(avg(value), max(value))), 6) AS angle FROM events GROUP BY 1""")
def f46_length_angle(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("length"), F.round(F.degrees(F.atan2(F.avg("value"), F.max("value"))), 6).alias("angle"))


@query("SELECT s_suppkey, round_even(s_acctbal / 10, 0) * 10 AS wrap FROM supplier")
def f52_wrap(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", text.wrap_correction(F.col("s_acctbal"), 10.0).alias("wrap"))


@query(f"""SELECT s_suppkey, round(lat, 6) AS lat, round(lon, 6) AS lon, round(h, 3) AS h FROM (SELECT s_suppkey, {_SPLACED}, s_acctbal h FROM supplier)""")
def f47_ellipsoid(spark, d):
    """To Cartesian coordinates and back."""
    s = _placed(read(spark, d, "supplier"), "s_suppkey").filter("true")
    x, y, z = geo.llh_to_xyz(F.col("lat"), F.col("lon"), F.col("s_acctbal"))
    xyz = s.select("s_suppkey", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, h = geo.xyz_to_llh(F.col("x"), F.col("y"), F.col("z"))
    return xyz.select("s_suppkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(h, 3).alias("h"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s58_json(spark, d):
    return read(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'long')").alias("k"))


# Models


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE / 86400 t, value y FROM events)
SELECT user_id, round(regr_slope(y, t), 6) AS rate, count(*) AS n FROM e WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""")
def m09_rate(spark, d):
    e = read(spark, d, "events").withColumn("t", _seconds("ts") / 86400.0)
    return agg.line_rate(e, ["user_id"], "t", "value").select("user_id", F.round("rate", 6).alias("rate"), "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE / 86400 - 19723 t, value y FROM events)
SELECT user_id, round(avg(y) FILTER (t >= 16 AND t < 24) - avg(y) FILTER (t >= 4 AND t < 12), 6) AS step, count(*) FILTER (t >= 4 AND t < 12) AS n_before,
count(*) FILTER (t >= 16 AND t < 24) AS n_after FROM e GROUP BY 1""")
def m17_step(spark, d):
    e = read(spark, d, "events").withColumns({"t": _seconds("ts") / 86400.0 - 19723, "one": F.lit(1.0)})
    out = agg.step_displacement(e, ["user_id"], "t", "value", "one", 12.0, 16.0, 8.0)
    return out.select("user_id", F.round("step", 6).alias("step"), "n_before", "n_after")


@query()
def m03_trajectory(spark, d):
    """Line, annual and semiannual terms of every series by weighted least squares."""
    from seiche.models.trajectory import fitted

    return fitted(read(spark, d, "series_epochs"), ["station", "session_code", "component"], "t", "y", "sigma")


@query()
def m25_decay(spark, d):
    """One relaxation time for all series from a grid of weighted fits."""
    from seiche.models.trajectory import shared_decay

    return shared_decay(read(spark, d, "series_epochs"), ["station", "session_code", "component"], "t", "y", "sigma", onset=2018.5, taus=[0.05, 0.1, 0.2, 0.5, 1.0])


# Streaming


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, median(value) AS value, count(*) AS n FROM events GROUP BY 1")
def st02_bucket_medians(spark, d):
    from seiche.streaming.series import streamed_bucket_medians

    return streamed_bucket_medians(spark, f"{d}/events.parquet", "ts", "10 minutes", "value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END n FROM events),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, min(ts) AS "first", count(*) AS n FROM i GROUP BY user_id, k""")
def st08_sessions(spark, d):
    from seiche.streaming.series import sessions

    return sessions(read(spark, d, "events"), "user_id", "ts", "6 hours")


# Further operators


@query(f"""WITH e AS ({_SIL_T}) SELECT count(*) AS n_pairs FROM e a JOIN e b ON a.row_id < b.row_id AND abs(a.t - b.t) <= 1.5""")
def j05_band_pairs(spark, d):
    """How many candidate pairs a band of time holds."""
    e = _sil(spark, d).select("row_id", "t")
    pairs = joins.band_join(e, e.select(F.col("row_id").alias("o_row"), F.col("t").alias("o_t")), "t", "o_t", 1.5).filter("row_id < o_row")
    return pairs.agg(F.count("*").alias("n_pairs"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN l_discount WHEN l_quantity > 25 THEN l_tax END AS v FROM lineitem""")
def j03_first_present(spark, d):
    l = read(spark, d, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_tax") > 0.04, geo.number("l_discount")), F.when(F.col("l_quantity") > 25, geo.number("l_tax"))).alias("v"))


@query("""SELECT e.user_id, s.day, round(e.v - s.v, 6) AS diff FROM (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) v FROM events GROUP BY 1, 2) e
JOIN (SELECT CAST(ts AS DATE) AS day, avg(value) v FROM events WHERE user_id = 1 GROUP BY 1) s USING (day) WHERE e.user_id <> 1""")
def j21_relative(spark, d):
    """Every series relative to one of them, day by day."""
    e = read(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    ref = e.filter("user_id = 1").select("day", F.col("v").alias("ref"))
    return e.filter("user_id <> 1").join(ref, "day").select("user_id", "day", F.round(F.col("v") - F.col("ref"), 6).alias("diff"))


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) v FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) v FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT user_id, round(median(b.v - a.v), 6) AS shift, count(*) AS n FROM a JOIN b USING (user_id, day) GROUP BY 1""")
def j44_window_shift(spark, d):
    from seiche.models.products import window_shift

    e = read(spark, d, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    out = window_shift(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "day", "v")
    return out.withColumn("shift", F.round("shift", 6))


@query("""SELECT station, session_code, component, count(*) FILTER (t >= 2018.3 AND t < 2018.8 AND y IS NOT NULL AND NOT isnan(y)) AS n,
round(max(t) FILTER (t >= 2018.3 AND t < 2018.8 AND y IS NOT NULL AND NOT isnan(y)) - min(t) FILTER (t >= 2018.3 AND t < 2018.8 AND y IS NOT NULL AND NOT isnan(y)), 9) AS span FROM series_epochs GROUP BY ALL""")
def p22_window_gates(spark, d):
    out = agg.window_gates(read(spark, d, "series_epochs"), ["station", "session_code", "component"], "t", "y", 2018.3, 2018.8)
    return out.select("station", "session_code", "component", "n", F.round("span", 9).alias("span"))


@query("""SELECT station, session_code, component, max(t) < 2018.6 AS ended FROM series_epochs GROUP BY ALL""")
def p21_span(spark, d):
    return read(spark, d, "series_epochs").groupBy("station", "session_code", "component").agg((F.max("t") < 2018.6).alias("ended"))


@query("""SELECT station, session_code, component, CAST(round_even(t * 365.25, 0) AS BIGINT) AS k, min(t) AS t FROM series_epochs GROUP BY ALL""")
def a21_unique_days(spark, d):
    s = read(spark, d, "series_epochs").withColumn("k", timeaxis.day_key(F.col("t")))
    return s.groupBy("station", "session_code", "component", "k").agg(F.min("t").alias("t"))


@query("""SELECT station, session_code, CAST(round_even(t * 365.25, 0) AS BIGINT) AS k, max(y) FILTER (component = 'N') AS north, max(y) FILTER (component = 'E') AS east,
max(y) FILTER (component = 'U') AS up FROM series_epochs WHERE abs(y) < 1e6 GROUP BY ALL""")
def s04_components(spark, d):
    """Three component tables joined on the day, as one pivot."""
    s = read(spark, d, "series_epochs").filter("abs(y) < 1e6").withColumn("k", timeaxis.day_key(F.col("t")))
    one = lambda c: F.max(F.when(F.col("component") == c, F.col("y")))
    return s.groupBy("station", "session_code", "k").agg(one("N").alias("north"), one("E").alias("east"), one("U").alias("up"))


@query("""SELECT station, arg_max(rec_id, struct_pack(t := t, r := rec_id)) AS rec_id FROM series_epochs WHERE sigma <= 3 AND sigma > 0 GROUP BY 1""")
def w22_last_good(spark, d):
    s = read(spark, d, "series_epochs").filter(predicates.bounds("sigma", None, 3) & (F.col("sigma") > 0))
    return s.groupBy("station").agg(F.max(F.struct("t", "rec_id")).getField("rec_id").alias("rec_id"))


@query("""SELECT rec_id, t > max(t) OVER (PARTITION BY station, session_code, component) - 0.1 AS provisional FROM series_epochs""")
def w13_provisional(spark, d):
    """Rows too young to be judged for good (W13, ST05)."""
    s = read(spark, d, "series_epochs")
    last = s.groupBy("station", "session_code", "component").agg(F.max("t").alias("t1"))
    return s.join(last, ["station", "session_code", "component"]).select("rec_id", (F.col("t") > F.col("t1") - 0.1).alias("provisional"))


@query("""WITH v AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) v FROM events GROUP BY 1, 2)
SELECT user_id, day, round(v - CASE WHEN count(v) OVER w >= 4 THEN quantile_cont(v, 0.2) OVER w END, 6) AS excursion FROM v
WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def w08_excursion(spark, d):
    v = read(spark, d, "events").groupBy("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    out = windows.excursion(v, ["user_id"], "day", "v", half_days=7, least=4)
    return out.select("user_id", "day", F.round("excursion", 6).alias("excursion"))


@query("""WITH r AS (SELECT rec_id, y - CASE WHEN t >= 2018.5 THEN 3 ELSE 0 END - CASE WHEN t >= 2018.7 THEN 4 ELSE 0 END AS y FROM series_epochs)
SELECT rec_id, round(CASE WHEN abs(y) < 1e6 THEN y END, 6) AS y FROM r""")
def m07_steps_removed(spark, d):
    from seiche.models.products import steps_removed

    s = read(spark, d, "series_epochs").select("rec_id", "station", "t", "y")
    steps = s.select("station").distinct().select("station", F.explode(F.array(F.struct(F.lit(2018.5).alias("epoch"), F.lit(3.0).alias("amplitude")), F.struct(F.lit(2018.7).alias("epoch"), F.lit(4.0).alias("amplitude")))).alias("s")).select("station", "s.*")
    out = steps_removed(s, steps, ["station"], "t", "y", "z")
    return out.select("rec_id", F.round(F.when(F.abs("z") < 1e6, F.col("z")), 6).alias("y"))


@query("""SELECT user_id, round(sum(1 / pow(1 + event_id % 5, 2) * (value - 2)) / sum(1 / pow(1 + event_id % 5, 2)), 6) AS offset FROM events GROUP BY 1""".replace("AS offset", 'AS "offset"'))
def m37_anchored_offset(spark, d):
    from seiche.models.products import anchored_offset

    e = read(spark, d, "events").withColumn("sigma", (1 + F.col("event_id") % 5).cast("double"))
    return e.groupBy("user_id").agg(F.round(anchored_offset("value", F.lit(2.0), "sigma"), 6).alias("offset"))


@query("""WITH e AS (SELECT user_id, regr_slope(value, epoch_us(ts) / 86400000000.0) r FROM events GROUP BY 1) SELECT user_id, round(r * 10, 5) AS displacement FROM e""")
def m18_displacement(spark, d):
    from seiche.models.products import to_displacement

    e = read(spark, d, "events").withColumn("t", _seconds("ts") / 86400.0)
    out = to_displacement(agg.line_rate(e, ["user_id"], "t", "value"), F.lit(10.0))
    return out.select("user_id", F.round("displacement", 5).alias("displacement"))


@query("""SELECT s_suppkey, round(1 + 0.5 * (t - 2020) + CASE WHEN t > 2021 THEN 3 * (1 - exp(-(t - 2021) * 365.25 / 100)) ELSE 0 END, 9) AS x FROM (SELECT s_suppkey, 2018 + (s_suppkey % 60) / 10.0::DOUBLE t FROM supplier)""")
def m41_apriori(spark, d):
    from seiche.models.products import apriori_at, transient_value

    s = read(spark, d, "supplier").withColumn("t", 2018 + (F.col("s_suppkey") % 60) / F.lit(10.0))
    x = apriori_at(F.lit(1.0), F.lit(0.5), F.lit(2020.0), F.col("t")) + transient_value("EXP", F.lit(3.0), F.lit(2021.0), F.lit(100.0), F.col("t"))
    return s.select("s_suppkey", F.round(x, 9).alias("x"))


@query("""SELECT s_suppkey, round(((90 + 37 * s_suppkey) % 360 + 360) % 360, 6) AS strike, round(dip, 6) AS dip FROM (SELECT s_suppkey, 5 + s_suppkey % 80 AS dip FROM supplier)""")
def f14_planes(spark, d):
    """The auxiliary of the auxiliary is the plane itself."""
    from seiche.functions import mechanism

    s = read(spark, d, "supplier").withColumns({"s": (90 + 37 * F.col("s_suppkey")).cast("double"), "d": (5 + F.col("s_suppkey") % 80).cast("double"), "r": (F.col("s_suppkey") * 53 % 350 - 170).cast("double")})
    one = s.select("s_suppkey", mechanism.auxiliary_plane(F.col("s"), F.col("d"), F.col("r")).alias("a"))
    two = one.select("s_suppkey", mechanism.auxiliary_plane(F.col("a.strike"), F.col("a.dip"), F.col("a.rake")).alias("b"))
    return two.select("s_suppkey", F.pmod(F.round("b.strike", 6), F.lit(360.0)).alias("strike"), F.round("b.dip", 6).alias("dip"))


@query("""SELECT row_id, round(greatest(depth_km * 111.19, m * 111.19 * cos(radians(latitude))), 6) AS h FROM (SELECT row_id, latitude, CASE WHEN isnan(depth_km) THEN NULL ELSE depth_km END depth_km,
CASE WHEN isnan(m_ml) THEN NULL ELSE m_ml END m FROM skjalftalisa_quakes)""")
def f26_horizontal_error(spark, d):
    q = read(spark, d, "skjalftalisa_quakes")
    return q.select("row_id", F.round(geo.horizontal_error_km(F.col("depth_km"), F.col("m_ml"), F.col("latitude")), 6).alias("h"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_id & 1 <> 0 THEN 'outlier' END, CASE WHEN event_id & 2 <> 0 THEN 'declared' END, CASE WHEN event_id & 4 <> 0 THEN 'icing' END,
CASE WHEN event_id & 8 <> 0 THEN 'snow' END, CASE WHEN event_id & 16 <> 0 THEN 'network' END) AS reasons FROM events""")
def f59_reasons(spark, d):
    return read(spark, d, "events").select("event_id", text.reason_names(F.col("event_id")).alias("reasons"))


@query("""SELECT o_orderkey, source FROM (SELECT o_orderkey, 'new' AS source FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)""")
def st07_upsert(spark, d):
    from seiche.streaming.series import upserted

    o = read(spark, d, "orders").select("o_orderkey", F.lit(1).alias("v"))
    old, new = o.filter("o_orderkey % 2 = 0").withColumn("source", F.lit("old")), o.filter("o_orderkey % 3 = 0").withColumn("source", F.lit("new"))
    return upserted(old, new, ["o_orderkey"], ["v"]).select("o_orderkey", "source")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN 'new' ELSE 'old' END AS source FROM orders""")
def st07_upsert_all(spark, d):
    """Every order: a third old only, a third new only, a third in both."""
    from seiche.streaming.series import upserted

    o = read(spark, d, "orders").select("o_orderkey", F.lit(1).alias("v"))
    old, new = o.filter("o_orderkey % 3 in (0, 1)").withColumn("source", F.lit("old")), o.filter("o_orderkey % 3 in (0, 2)").withColumn("source", F.lit("new"))
    return upserted(old, new, ["o_orderkey"], ["v"]).select("o_orderkey", "source")


@query("""SELECT event_id, max_by(row_id, struct_pack(m := evaluation_mode = 'manual', l := loaded_at, r := row_id)) AS row_id FROM sil_events GROUP BY 1""")
def st04_reviewed_over_automatic(spark, d):
    from seiche.streaming.series import reviewed_over_automatic

    rows = read(spark, d, "sil_events").select("event_id", "evaluation_mode", "loaded_at", "row_id")
    return reviewed_over_automatic(rows, "event_id", "evaluation_mode", ["loaded_at", "row_id"]).select("event_id", "row_id")


@query()
def m31_frames(spark, d):
    """Translation, rotation and scale of each day from residuals at the suppliers' places; tested by planted values."""
    from seiche.models.products import frame_parameters

    s = _placed(read(spark, d, "supplier"), "s_suppkey")
    x, y, z = geo.llh_to_xyz(F.col("lat"), F.col("lon"), F.lit(0.0))
    rows = s.select((F.col("s_suppkey") % 3).alias("day"), x.alias("x"), y.alias("y"), z.alias("z"))
    return frame_parameters(rows.withColumns({"dx": F.lit(0.01) + F.col("x") * 1e-9, "dy": F.lit(-0.02) + F.col("y") * 1e-9, "dz": F.lit(0.03) + F.col("z") * 1e-9}))
