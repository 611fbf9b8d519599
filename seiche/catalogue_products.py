"""Queries of the station products, networks, frames and stored models, with the SQL that gives the same rows.

The series of the tables begin at different times: they are moved to begin at 2020, so that one window
meets them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.catalogue import query
from seiche.functions import geo, timeaxis
from seiche.models import network, products, records, trajectory
from seiche.operators import joins, screens
from seiche.queries import read

D, L = F.col, F.lit
KEYS = ["station", "session_code"]
PART = [*KEYS, "component"]


def _rebased(spark, d, clean: bool = True) -> DataFrame:
    s = read(spark, d, "series_epochs").filter("t is not null")
    first = s.groupBy(*KEYS).agg(F.min("t").alias("_a"))
    s = s.join(first, KEYS).withColumn("t", F.round(D("t") - D("_a"), 6) + 2020.0).drop("_a")
    return s.filter("abs(y) < 100000 and sigma > 0 and sigma < 100") if clean else s


_ALL = "SELECT * REPLACE (round(t - min(t) OVER (PARTITION BY station, session_code), 6) + 2020 AS t) FROM series_epochs WHERE t IS NOT NULL"
_BASE = f"SELECT * FROM ({_ALL}) WHERE abs(y) < 100000 AND sigma > 0 AND sigma < 100"
_SUMS = """count(*) n, min(t) a, max(t) b, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * y) r0, sum(w * x * y) r1, sum(w * y * y) yy"""
_RATE = "(s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1)"
_CHI = f"greatest(yy - {_RATE} * r1 - (r0 - {_RATE} * s1) / s0 * r0, 0)"
_FORMAL = f"sqrt({_CHI} / (n - 2) * s0 / (s0 * s2 - s1 * s1))"

# Velocities.

_VEL = f"""WITH r AS ({_BASE}), w AS (SELECT *, t - 2020.15 x, 1 / (sigma * sigma) w FROM r WHERE t >= 2020.1 AND t < 2020.2),
f AS (SELECT station, session_code, component, {_SUMS} FROM w GROUP BY ALL), k AS (SELECT DISTINCT station, session_code FROM series_epochs),
g AS (SELECT station, session_code, min(n) n, min(a) a, max(b) b FROM f GROUP BY ALL),
e AS (SELECT station, session_code, max(t) FILTER (t < 2020.2) l, max(t) m FROM r GROUP BY ALL),
j AS (SELECT k.*, g.n, (g.b - g.a) / (CASE WHEN l < 2020.2 - 1.5 / 365.25 AND m < 2020.2 THEN l + 0.5 / 365.25 ELSE 2020.2 END - 2020.1) c FROM k LEFT JOIN g USING (station, session_code) LEFT JOIN e USING (station, session_code)),
z AS (SELECT station, session_code, CASE WHEN n IS NULL THEN 'no epochs' WHEN n < 25 AND coalesce(c, 0) < 0.8 THEN 'few epochs ' || n || '; cover' WHEN n < 25 THEN 'few epochs ' || n WHEN coalesce(c, 0) < 0.8 THEN 'cover' END refused FROM j)"""


@query(_VEL + f""" SELECT station, session_code, f.component, CASE WHEN refused IS NULL THEN round({_RATE}, 3) END AS rate, CASE WHEN refused IS NULL THEN round(2 * {_FORMAL}, 3) END AS sigma, f.n AS n, refused
FROM z LEFT JOIN f USING (station, session_code)""")
def m10_velocities(spark, d):
    """Station velocities of a window with the gates' refusals."""
    out = records.velocities(_rebased(spark, d), (2020.1, 2020.2), keys=KEYS, least=25, default_k=2.0)
    return out.select(*PART, F.round("rate", 3).alias("rate"), F.round("sigma", 3).alias("sigma"), "n", "refused")


@query(_VEL + " SELECT count(*) AS n_stations, count(*) FILTER (refused IS NULL) AS n_accepted FROM z")
def a20_acceptance(spark, d):
    """How many stations of a set are accepted."""
    return records.acceptance(records.velocities(_rebased(spark, d), (2020.1, 2020.2), keys=KEYS, least=25), KEYS)


@query(f"""WITH r AS ({_BASE}), l AS (SELECT station, session_code, max(t) FILTER (t < 2020.6) l, max(t) m FROM r GROUP BY ALL) SELECT station, session_code, CASE WHEN l < 2020.6 - 1.5 / 365.25 AND m < 2020.6 THEN l END AS data_end FROM l""")
def w21_data_end(spark, d):
    """Where the data stop before the window does."""
    return screens.data_ends(_rebased(spark, d), KEYS, "t", 2020.6)


_SCALE = f"""WITH r AS ({_BASE}), w AS (SELECT *, t - (i + 1) * 0.05 x, 1 / (sigma * sigma) w FROM r, (VALUES (0), (1)) v(o), LATERAL (SELECT CAST(floor(t / 0.05) AS BIGINT) - o AS i)),
f AS (SELECT station, session_code, component, i, {_SUMS} FROM w GROUP BY ALL), q AS (SELECT *, {_RATE} rate, {_FORMAL} formal FROM f WHERE n >= 5 AND b - a >= 0.06), q2 AS (SELECT * FROM q WHERE formal > 0),
c AS (SELECT station, session_code, component, median(rate) m, median(formal) fm, count(*) nw FROM q2 GROUP BY ALL HAVING count(*) >= 4),
k AS (SELECT station, session_code, component, 1.4826 * median(abs(rate - m)) / any_value(fm) k, any_value(nw) nw FROM q2 JOIN c USING (station, session_code, component) GROUP BY ALL)"""


@query(_SCALE + " SELECT station, session_code, component, round(k, 3) AS k, nw AS n_windows FROM k")
def m28_rate_scales(spark, d):
    """How much more the rates of windows scatter than their sigmas say."""
    return records.rate_scales(_rebased(spark, d), 0.1, keys=PART).withColumn("k", F.round("k", 3))


@query(_SCALE + " SELECT component, round(median(k), 3) AS k, count(*) AS n_stations FROM k GROUP BY 1")
def a12_k_table(spark, d):
    """The table of scales by length: medians over the stations."""
    out = records.k_table(_rebased(spark, d), [36.525], keys=KEYS)
    return out.select("component", F.round("k", 3).alias("k"), "n_stations")


# Displacements.


@query(f"""WITH r AS ({_BASE}), k AS (SELECT DISTINCT station, session_code, component FROM r), w AS (SELECT *, 1 / (sigma * sigma) w FROM r WHERE t >= 2020 AND t < 2020.3),
s AS (SELECT station, session_code, component, sum(w * y) FILTER (t < 2020 + 20 / 365.25) / sum(w) FILTER (t < 2020 + 20 / 365.25) a, sum(w * y) FILTER (t >= 2020.3 - 20 / 365.25) / sum(w) FILTER (t >= 2020.3 - 20 / 365.25) b,
sum(w * t) FILTER (t < 2020 + 20 / 365.25) / sum(w) FILTER (t < 2020 + 20 / 365.25) ta, sum(w * t) FILTER (t >= 2020.3 - 20 / 365.25) / sum(w) FILTER (t >= 2020.3 - 20 / 365.25) tb,
count(*) FILTER (t < 2020 + 20 / 365.25) na, count(*) FILTER (t >= 2020.3 - 20 / 365.25) nb FROM w GROUP BY ALL)
SELECT station, session_code, component, round(CASE WHEN na >= 3 AND nb >= 3 THEN b - a END, 4) AS displacement, round(CASE WHEN na >= 3 AND nb >= 3 THEN tb - ta END, 6) AS span,
nullif(concat_ws('; ', CASE WHEN coalesce(na, 0) < 3 THEN 'no epochs at the start' END, CASE WHEN coalesce(nb, 0) < 3 THEN 'no epochs at the end' END), '') AS refused FROM k LEFT JOIN s USING (station, session_code, component)""")
def m16_displacements(spark, d):
    """Displacements between the ends of a period."""
    out = records.displacements(_rebased(spark, d), (2020.0, 2020.3), keys=KEYS, ends_days=20.0, least=3)
    return out.select(*PART, F.round("displacement", 4).alias("displacement"), F.round("span", 6).alias("span"), "refused")


@query(f"""WITH r AS (SELECT * FROM ({_BASE}) WHERE t >= 2020 AND t < 2020.3), k AS (SELECT DISTINCT station, session_code, component FROM ({_BASE})),
s AS (SELECT station, session_code, component, min(struct_pack(t := t, y := y, s := sigma)) a, max(struct_pack(t := t, y := y, s := sigma)) b, count(*) n FROM r GROUP BY ALL)
SELECT station, session_code, component, round(CASE WHEN n > 1 THEN b.y - a.y END, 6) AS displacement, round(CASE WHEN n > 1 THEN sqrt(a.s * a.s + b.s * b.s) END, 6) AS sigma FROM k LEFT JOIN s USING (station, session_code, component)""")
def m16_points(spark, d):
    """Displacements between the first and the last epoch."""
    out = records.displacements(_rebased(spark, d), (2020.0, 2020.3), keys=KEYS, method="points")
    return out.select(*PART, F.round("displacement", 6).alias("displacement"), F.round("sigma", 6).alias("sigma"))


@query(f"""WITH r AS ({_BASE}), k AS (SELECT DISTINCT station, session_code FROM r), w AS (SELECT *, 1 / (sigma * sigma) w FROM r WHERE t >= 2020 AND t < 2020.3),
s AS (SELECT station, session_code, component, sum(w * t) FILTER (t < 2020 + 20 / 365.25) / sum(w) FILTER (t < 2020 + 20 / 365.25) ta, sum(w * t) FILTER (t >= 2020.3 - 20 / 365.25) / sum(w) FILTER (t >= 2020.3 - 20 / 365.25) tb FROM w GROUP BY ALL)
SELECT station, session_code, round(coalesce(avg(tb - ta), 2020.3::DOUBLE - 2020), 6) AS span FROM k LEFT JOIN s USING (station, session_code) GROUP BY ALL""")
def f68_spans(spark, d):
    """The years a displacement spans: between the mean times of its ends, else the period."""
    out = records.displacements(_rebased(spark, d), (2020.0, 2020.3), keys=KEYS, ends_days=20.0)
    return records.displacement_spans(out, KEYS, (2020.0, 2020.3)).withColumn("span", F.round("span", 6))


@query("SELECT s_suppkey AS k, round(s_acctbal / (1 + s_suppkey % 4), 6) AS rate, round(2.0 / (1 + s_suppkey % 4), 6) AS rate_sigma FROM supplier")
def m19_to_velocity(spark, d):
    s = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), D("s_acctbal").alias("displacement"), L(2.0).alias("sigma"), (1 + D("s_suppkey") % 4).cast("double").alias("years"))
    return products.to_velocity(s, D("years")).select("k", F.round("rate", 6).alias("rate"), F.round("rate_sigma", 6).alias("rate_sigma"))


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) v FROM orders GROUP BY 1, 2) SELECT o_custkey, round(max(v) FILTER (day = DATE '1997-06-03') - max(v) FILTER (day = DATE '1996-01-05'), 2) AS displacement FROM o GROUP BY 1""")
def m39_exact_dates(spark, d):
    """The value on one date less that on another; none where a date is missing."""
    o = read(spark, d, "orders").withColumn("day", D("o_orderdate").cast("date")).groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("v")).withColumn("s", L(1.0))
    return screens.exact_displacement(o, ["o_custkey"], "day", "v", "s", "1996-01-05", "1997-06-03").select("o_custkey", F.round("displacement", 2).alias("displacement"))


# Coordinates.

_STEPS = "(SELECT DISTINCT station, session_code, 2020.205::DOUBLE step FROM series_epochs WHERE ascii(station) % 2 = 0)"


def _steps(spark, d) -> DataFrame:
    return read(spark, d, "series_epochs").select(*KEYS).distinct().filter(F.ascii("station") % 2 == 0).withColumn("step", L(2020.205))


@query(f"""WITH r AS ({_BASE}), k AS (SELECT DISTINCT station, session_code, component FROM r), o AS (SELECT r.*, 1 / (sigma * sigma) w FROM r LEFT JOIN {_STEPS} s USING (station, session_code) WHERE abs(t - 2020.2) <= 10 / 365.25 AND (step IS NULL OR t < step)),
m AS (SELECT station, session_code, component, count(*) n, sum(w * y) / sum(w) v, sqrt(1 / sum(w)) * sqrt(greatest(1, greatest(sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w), 0) / greatest(count(*) - 1, 1))) s FROM o GROUP BY ALL)
SELECT station, session_code, component, n, round(v, 5) AS value, round(s, 4) AS sigma FROM m""")
def m21_coordinates(spark, d):
    """Levels at an epoch from the window about it, on its side of the steps."""
    out = records.coordinates(_rebased(spark, d), 2020.2, keys=KEYS, window_days=20.0, steps=_steps(spark, d))
    return out.filter("size(flags) = 0").select(*PART, "n", F.round("value", 5).alias("value"), F.round("sigma", 4).alias("sigma"))


@query(f"""WITH r AS ({_BASE}), l AS (SELECT station, session_code, component, max(t) l FROM r GROUP BY ALL), m AS (SELECT station, session_code, component, count(*) n, sum(y / (sigma * sigma)) / sum(1 / (sigma * sigma)) v, sum(t / (sigma * sigma)) / sum(1 / (sigma * sigma)) tm FROM r JOIN l USING (station, session_code, component) WHERE l - t <= 10 / 365.25 GROUP BY ALL)
SELECT station, session_code, component, n, round(v + 12 * (2022.5 - tm), 4) AS value, CAST(round((2022.5 - tm) * 365.25, 0) AS BIGINT) AS days FROM m""")
def m21_extrapolated(spark, d):
    """Levels beyond the data: the nearest window moved by a rate, flagged with the days between."""
    s = _rebased(spark, d)
    rates = s.select(*PART).distinct().withColumn("rate", L(12.0))
    out = records.coordinates(s, 2022.5, keys=KEYS, window_days=20.0, rates=rates)
    days = F.regexp_extract(F.array_join("flags", ","), r"extrapolated:(\d+)d", 1).cast("long")
    return out.select(*PART, "n", F.round("value", 4).alias("value"), days.alias("days"))


@query(f"SELECT rec_id FROM ({_BASE}) LEFT JOIN {_STEPS} s USING (station, session_code) WHERE abs(t - 2020.2) <= 0.05 AND (step IS NULL OR t < step)")
def p23_cut_at_steps(spark, d):
    return screens.cut_at_steps(_rebased(spark, d), KEYS, "t", _steps(spark, d), 2020.2, 0.05).select("rec_id")


@query(f"SELECT station, session_code, component, min(t) FILTER (g = m) AS t FROM (SELECT *, abs(t - 2020.333) g, min(abs(t - 2020.333)) OVER (PARTITION BY station, session_code, component) m FROM ({_BASE})) GROUP BY ALL")
def w17_nearest_epoch(spark, d):
    return screens.nearest_epoch(_rebased(spark, d).select(*PART, "t"), PART, "t", 2020.333)


@query(f"""WITH r AS ({_BASE}), n AS (SELECT DISTINCT station, session_code, t FROM r WHERE component = 'N'), e AS (SELECT DISTINCT station, session_code, t + 0.0002 v FROM r WHERE component = 'E' AND rec_id % 3 = 0)
SELECT station, session_code, t FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.station = n.station AND e.session_code = n.session_code AND abs(e.v - n.t) <= 0.0003)""")
def j11b_near_epochs(spark, d):
    """Positions that have an epoch of the view within a tolerance."""
    s = _rebased(spark, d)
    pos = s.filter("component = 'N'").select(*KEYS, "t").distinct()
    seen = s.filter("component = 'E' and rec_id % 3 = 0").select(*KEYS, (D("t") + 0.0002).alias("t")).distinct()
    return screens.with_nearby_epoch(pos, seen, KEYS, "t", 0.0003)


@query(f"""SELECT s.station, s.session_code, e AS epoch, CASE WHEN abs(e - 2020.205) <= 1e-3 THEN 2020.205 END::DOUBLE AS declared FROM (SELECT DISTINCT station, session_code FROM series_epochs) s, (VALUES (2020.2045::DOUBLE), (2020.3)) v(e) WHERE ascii(station) % 2 = 0
UNION ALL SELECT station, session_code, e, NULL FROM (SELECT DISTINCT station, session_code FROM series_epochs) s, (VALUES (2020.2045::DOUBLE), (2020.3)) v(e) WHERE ascii(station) % 2 = 1""")
def j42_declared_steps(spark, d):
    """Steps found, matched with the declared ones within a thousandth of a year."""
    found = read(spark, d, "series_epochs").select(*KEYS).distinct().withColumn("epoch", F.explode(F.array(L(2020.2045), L(2020.3))))
    return screens.step_declared(found, _steps(spark, d), KEYS)


# Views and exports.


@query(f"""WITH r AS ({_ALL}), m AS (SELECT *, (CASE WHEN sigma > 20 THEN 1 ELSE 0 END) + (CASE WHEN CAST(round_even(t * 1e5, 0) AS BIGINT) = 202010678 THEN 2 ELSE 0 END) + (CASE WHEN CAST(round_even(t * 365.25, 0) AS BIGINT) % 50 = 7 THEN 16 ELSE 0 END) b, CAST(round_even(t * 1e5, 0) AS BIGINT) e, max(t) OVER (PARTITION BY station, session_code) l FROM r),
k AS (SELECT *, bool_or(b <> 0) OVER (PARTITION BY station, session_code, e) bad FROM m)
SELECT rec_id, b AS reasons, NOT bad AS kept, b <> 0 AND t > l - 30 / 365.25 AS provisional, round(CASE WHEN NOT bad AND abs(y) < 100000 THEN y END, 6) + 0 AS y_clean FROM k""")
def m08_view(spark, d):
    """The raw, cleaned and provisional view of every row."""
    s = _rebased(spark, d, clean=False)
    outliers = s.filter("sigma > 20").select("rec_id")
    declared = s.select(*KEYS).distinct().withColumn("yearf", L(2020.10678))
    bad_days = s.select(timeaxis.day_key(D("t")).alias("day_key")).distinct().filter("day_key % 50 = 7")
    out = records.view(s, keys=KEYS, outliers=outliers, declared=declared, bad_days=bad_days, provisional_days=30.0)
    return out.select("rec_id", "reasons", "kept", "provisional", (F.round(F.when(F.abs("y_clean") < 100000, D("y_clean")), 6) + 0.0).alias("y_clean"))


@query(f"""WITH r AS ({_BASE}), m AS (SELECT *, CASE WHEN sigma > 20 THEN 1 ELSE 0 END b, CAST(round_even(t * 1e5, 0) AS BIGINT) e FROM r), k AS (SELECT *, bool_or(b <> 0) OVER (PARTITION BY station, session_code, e) bad FROM m)
SELECT rec_id, CASE WHEN b = 1 THEN 'outlier' ELSE '' END AS reason_names, round(y - 12 * (t - 2020), 4) AS y_detrended FROM k WHERE t >= 2020.1 AND t < 2020.3""")
def m23_series_export(spark, d):
    """A period of a series with what was dropped and why, and its detrended values."""
    s = _rebased(spark, d)
    model = s.select(*PART).distinct().withColumn("rate", L(12.0))
    out = records.view(s, keys=KEYS, outliers=s.filter("sigma > 20").select("rec_id"), model=model)
    return records.exported(out, (2020.1, 2020.3), dropped=True).select("rec_id", "reason_names", F.round("y_detrended", 4).alias("y_detrended"))


@query(f"""SELECT rec_id, round(y - 2 * (t - 2020) - 3 * cos(2 * pi() * t), 4) + 0 AS y FROM ({_BASE}) WHERE component <> 'U' UNION ALL SELECT rec_id, round(y, 4) + 0 FROM ({_BASE}) WHERE component = 'U'""")
def m05_stored_detrend(spark, d):
    """Stored parameters taken off; a series without a record stays as it is."""
    s = _rebased(spark, d)
    stored = s.select(*PART).distinct().filter("component <> 'U'").withColumns({"rate": L(2.0), "annual_cos": L(3.0), "annual_sin": L(0.0), "semiannual_cos": L(0.0), "semiannual_sin": L(0.0)})
    out = trajectory.detrended(s, stored, PART, "t", "y", out="z")
    return out.select("rec_id", (F.round("z", 4) + 0.0).alias("y"))


@query(f"""WITH r AS ({_BASE}), w AS (SELECT *, t - 2020.0 x, 1 / (sigma * sigma) w FROM r), f AS (SELECT station, session_code, component, {_SUMS} FROM w GROUP BY ALL) SELECT station, session_code, component, n, round({_RATE}, 3) AS rate, round((r0 - {_RATE} * s1) / s0, 3) AS "offset" FROM f WHERE n >= 20""")
def m03_line(spark, d):
    """A trajectory of a line only: the closed form of the weighted fit."""
    out = trajectory.fitted(_rebased(spark, d), PART, "t", "y", "sigma", seasons=(), origin=2020.0)
    return out.select(*PART, "n", F.round("rate", 3).alias("rate"), F.round("offset", 3).alias("offset"))


@query("""SELECT rec_id, round(2 * cos(2 * pi() * t) + 3 * sin(2 * pi() * t) + 0.5 * cos(4 * pi() * t) - sin(4 * pi() * t), 6) AS periodic, round(1 - exp(-greatest(t - 2012.5, 0) / 0.7), 6) AS relaxation FROM series_epochs""")
def m02_terms(spark, d):
    """The shapes a trajectory is made of."""
    from seiche.plans.grammar import Term

    c = trajectory.terms(D("t"), extra=(Term("exp", 2012.5, 0.7),))
    value = 2 * c["annual_cos"] + 3 * c["annual_sin"] + 0.5 * c["semiannual_cos"] - c["semiannual_sin"]
    return read(spark, d, "series_epochs").select("rec_id", F.round(value, 6).alias("periodic"), F.round(c["exp0"], 6).alias("relaxation"))


# Screens.


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY station, session_code, component ORDER BY t, rec_id) n FROM ({_BASE}) WHERE sigma < 10), o AS (SELECT station, session_code, component, sum(y / sigma) / sum(1 / sigma) o FROM r WHERE n <= 5 GROUP BY ALL)
SELECT rec_id, round((y - o) * 1000, 3) AS y FROM r JOIN o USING (station, session_code, component)""")
def p16_screened(spark, d):
    """Sigma screen, scale and the offset of the first samples."""
    s = _rebased(spark, d).withColumn("t", D("t") + D("rec_id") * 1e-12)  # one order for rows of one epoch
    out = screens.screened(s, PART, "t", "y", "sigma", most=10_000.0, scale=1000.0)
    return out.select("rec_id", F.round("y", 3).alias("y"))


@query(f"""WITH r AS (SELECT * FROM ({_BASE}) WHERE sigma < 10), o AS (SELECT station, session_code, component, sum(y / sigma) / sum(1 / sigma) o FROM r WHERE t >= 2020.05 AND t < 2020.1 GROUP BY ALL)
SELECT rec_id, round(y - coalesce(o, 0), 5) + 0 AS y FROM r LEFT JOIN o USING (station, session_code, component)""")
def p17_screened_window(spark, d):
    """The screen with the reference of a window."""
    out = screens.screened(_rebased(spark, d), PART, "t", "y", "sigma", most=10.0, window=(2020.05, 2020.1))
    return out.select("rec_id", (F.round("y", 5) + 0.0).alias("y"))


@query(f"""SELECT station, session_code, component, round(sum(y / sigma) / sum(1 / sigma), 5) AS "offset" FROM ({_BASE}) WHERE t >= 2020.05 AND t < 2020.1 GROUP BY ALL""")
def a15_offsets(spark, d):
    return screens.offsets(_rebased(spark, d), PART, "t", "y", "sigma", window=(2020.05, 2020.1)).withColumn("offset", F.round("offset", 5))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'clash' WHEN s_suppkey % 3 = 1 AND 2005 + s_suppkey % 10 < 2010 THEN 'early' END AS excluded FROM supplier""")
def p20_exclusions(spark, d):
    """Segments excluded by folder or by their last epoch, with the first reason."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier")
    segments = s.select(k.cast("string").alias("station"), F.concat(L("/seg/"), F.when(k % 3 == 0, "rap").otherwise("pre"), L("/mb_x.dat1")).alias("file"), (2005 + k % 10).cast("double").alias("last_epoch"))
    none = L(None)
    rules = s.filter("s_suppkey % 3 = 0").select(L(2).alias("rule_no"), k.cast("string").alias("station"), L("rap").alias("drop_dir"), none.cast("double").alias("drop_before_year"), L("clash").alias("reason")).unionByName(
        s.filter("s_suppkey % 3 < 2").select(L(3).alias("rule_no"), k.cast("string").alias("station"), none.cast("string").alias("drop_dir"), L(2010.0).alias("drop_before_year"), L("early").alias("reason"))
    )
    return screens.segments_excluded(segments, rules).select(D("station").cast("long").alias("k"), "excluded")


@query(f"""SELECT rec_id, round(y + CASE WHEN component = 'N' AND t < 2020.2 THEN 5 ELSE 0 END + CASE WHEN component = 'N' AND t < 2020.4 THEN 2.5 ELSE 0 END, 5) AS y FROM ({_BASE})""")
def j13_junctions(spark, d):
    """Reviewed offsets before junctions, summed."""
    s = _rebased(spark, d)
    rules = s.select("station").distinct().select("station", L("N").alias("component"), F.explode(F.array(F.struct(L(2020.2).alias("before_year"), L(5.0).alias("offset_m")), F.struct(L(2020.4).alias("before_year"), L(2.5).alias("offset_m")))).alias("r")).select("station", "component", "r.*")
    return screens.junctions_applied(s, rules).select("rec_id", F.round("y", 5).alias("y"))


@query("SELECT * FROM (VALUES ('plate', 24, TRUE), ('itrf2008', 24, TRUE), ('plate', 8, FALSE), ('other', 24, FALSE)) t(product, hours, applies)")
def p33_junction_products(spark, d):
    rows = [(p, h, screens.junctions_apply(p, h)) for p, h in (("plate", 24), ("itrf2008", 24), ("plate", 8), ("other", 24))]
    return spark.createDataFrame(rows, "product string, hours int, applies boolean")


@query("SELECT DISTINCT user_id FROM events e WHERE EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'click') AND EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type <> 'click')")
def p30_same_view(spark, d):
    """Baselines whose ends are of different views."""
    return screens.same_view(read(spark, d, "events").select("user_id", (D("event_type") == "click").alias("detrended")), "user_id", "detrended")


@query("SELECT o_custkey, min(o_orderdate) < TIMESTAMP '1995-06-01' AND max(o_orderdate) >= TIMESTAMP '1998-01-01' AS inside FROM orders GROUP BY 1")
def p21_within_span(spark, d):
    at = lambda s: L(s).cast("timestamp_ntz")
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.min(D("o_orderdate").cast("timestamp_ntz")).alias("a"), F.max(D("o_orderdate").cast("timestamp_ntz")).alias("b"))
    return o.select("o_custkey", screens.within_span(D("a"), D("b"), at("1995-06-01"), at("1998-01-01")).alias("inside"))


@query("SELECT n_nationkey AS station, 'E' || n_regionkey AS name FROM nation WHERE n_regionkey IN (0, 2)")
def j23_station_events(spark, d):
    """Events of certain kinds that touch a station's areas."""
    n = read(spark, d, "nation")
    areas = n.select(D("n_regionkey").cast("string").alias("area"), D("n_nationkey").cast("string").alias("station"))
    events = spark.createDataFrame([("E0", "dike", "2020-01-01", ["0"]), ("E1", "swarm", "2020-01-01", ["1"]), ("E2", "eruption", "2020-01-01", ["2", "none"])], "name string, kind string, onset string, regions array<string>")
    out = screens.station_events(n.select(D("n_nationkey").cast("string").alias("station")), events, areas, ("dike", "eruption"))
    return out.select(D("station").cast("int").alias("station"), "name")


@query("""SELECT CASE WHEN s_suppkey % 10 < 2 THEN 'J' || (s_suppkey - s_suppkey % 10) ELSE 'S' || s_suppkey END AS station, max(CASE WHEN s_suppkey % 10 < 2 THEN s_suppkey - s_suppkey % 10 + 1 ELSE s_suppkey END) + 0.5 AS lon, CAST(min(s_suppkey) AS DOUBLE) AS "first", CAST(max(s_suppkey) AS DOUBLE) AS "last" FROM supplier WHERE s_suppkey >= 10 AND s_suppkey < 100 GROUP BY 1""")
def j35_joined_candidates(spark, d):
    """Members of a moved station as one, at the last of them."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier").filter("s_suppkey >= 10 and s_suppkey < 100")
    cands = s.select(F.concat(L("S"), k.cast("string")).alias("station"), (k + 0.5).alias("lon"), L(64.0).alias("lat"), k.cast("double").alias("first"), k.cast("double").alias("last"))
    rules = s.filter("s_suppkey % 10 < 2").select(F.concat(L("J"), (k - k % 10).cast("string")).alias("joined"), F.concat(L("S"), k.cast("string")).alias("member"), (k % 10).alias("place"))
    return screens.joined_candidates(cands, rules).select("station", "lon", "first", "last")


# Networks.

_GRID = "SELECT s_suppkey k, 64 + (s_suppkey % 10) / 50.0::DOUBLE lat, -21 + CAST(floor(s_suppkey / 10) AS DOUBLE) / 20.0::DOUBLE lon, s_acctbal v FROM supplier"
_KM = "sqrt(pow((b.lat - a.lat) * 111.19, 2) + pow((b.lon - a.lon) * 111.19 * cos(radians((b.lat + a.lat) / 2)), 2))"


def _grid(spark, d) -> DataFrame:
    k = D("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("station"), (64 + k % 10 / L(50.0)).alias("lat"), (-21 + F.floor(k / 10) / L(20.0)).alias("lon"), D("s_acctbal").alias("v"))


_RES = "SELECT s_suppkey station, i AS day, ((s_suppkey * 7 + i * 13) % 11 - 5) / 2.0::DOUBLE + (i * i) % 5 r FROM supplier, range(0, 20) t(i) WHERE (s_suppkey + i) % 6 <> 0"


def _residuals(spark, d) -> DataFrame:
    rows = read(spark, d, "supplier").select(D("s_suppkey").alias("station"), F.explode(F.sequence(L(0), L(19))).alias("day")).filter((D("station") + D("day")) % 6 != 0)
    return rows.select("station", "day", L("N").alias("component"), (((D("station") * 7 + D("day") * 13) % 11 - 5) / L(2.0) + (D("day") * D("day")) % 5).alias("r"), L(2.0).alias("sigma"))


@query(f"""WITH g AS ({_GRID}), p AS (SELECT a.k a, b.k b, {_KM} km FROM g a JOIN g b ON a.k < b.k), r AS ({_RES}) SELECT p.a AS a, p.b AS b, count(*) AS n, round(corr(x.r, y.r), 6) AS rho FROM p JOIN r x ON x.station = p.a JOIN r y ON y.station = p.b AND y.day = x.day WHERE km <= 4 GROUP BY 1, 2""")
def a24_shared_fraction(spark, d):
    """The share of their noise that two stations have in common, from their common days."""
    pairs = joins.pairs_within(_grid(spark, d), station="station", max_km=4.0)
    out = network.pair_correlations(_residuals(spark, d), pairs)
    return out.select("a", "b", "n", F.round("rho", 6).alias("rho"))


_LAW = f"""g AS ({_GRID}), p AS (SELECT a.k a, b.k b, {_KM} km FROM g a JOIN g b ON a.k < b.k), r AS ({_RES}), c AS (SELECT p.a, p.b, any_value(km) km, corr(x.r, y.r) rho FROM p JOIN r x ON x.station = p.a JOIN r y ON y.station = p.b AND y.day = x.day WHERE km <= 6 GROUP BY 1, 2),
l AS (SELECT count(*) n_pairs, regr_slope(ln(rho), km) s, regr_intercept(ln(rho), km) i FROM c WHERE rho > 0)"""


@query(f"WITH {_LAW} SELECT n_pairs, round(least(exp(i), 1), 4) AS rho0, CASE WHEN s < 0 THEN round(-1 / s, 3) END AS length_km FROM l")
def m29_noise_law(spark, d):
    """How the noise of baselines falls off with distance."""
    _, law = network.noise_law(_residuals(spark, d), _grid(spark, d), max_km=6.0)
    return law.select("n_pairs", F.round("rho0", 4).alias("rho0"), F.round("length_km", 3).alias("length_km"))


@query(f"WITH {_LAW}, k AS (SELECT station, sqrt(avg(r * r / 4)) k FROM r GROUP BY 1) SELECT p.a AS a, p.b AS b, round(x.k, 6) AS k_a, round(y.k, 6) AS k_b, CASE WHEN p.a % 2 = 0 THEN round(c.rho, 5) WHEN s < 0 THEN round(least(exp(i), 1) * exp(p.km * s), 4) ELSE 0 END AS rho FROM p JOIN c USING (a, b) JOIN k x ON x.station = p.a JOIN k y ON y.station = p.b, l")
def m30_pair_inputs(spark, d):
    """What the sigma of a baseline needs: a pair's own correlation, else that of the law."""
    grid, res = _grid(spark, d), _residuals(spark, d)
    own, law = network.noise_law(res, grid, max_km=6.0)
    pairs = joins.pairs_within(grid, station="station", max_km=6.0)
    rho = network.pair_correlations(res, pairs)
    out = network.pair_inputs(pairs, own, law, rho.filter("a % 2 = 0"))
    return out.select("a", "b", F.round("k_a", 6).alias("k_a"), F.round("k_b", 6).alias("k_b"), F.when(D("a") % 2 == 0, F.round("rho", 5)).otherwise(F.round("rho", 4)).alias("rho"))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, avg(value) v FROM events WHERE user_id = 3 GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS day, avg(value) v FROM events WHERE user_id = 7 GROUP BY 1), j AS (SELECT day, a.v - b.v v FROM a JOIN b USING (day) WHERE a.v - b.v IS NOT NULL)
SELECT day, round(v - first_value(v) OVER (ORDER BY day), 6) AS y, round(sqrt(4 + 9 - 2 * 0.5 * 2 * 3), 6) AS sigma FROM j""")
def j20_baseline_series(spark, d):
    """One series less another from its first value, with sigmas that share a part."""
    e = read(spark, d, "events").groupBy("user_id", D("ts").cast("date").alias("day")).agg(F.avg("value").alias("y"))
    out = network.baseline_series(e.filter("user_id = 3").withColumn("sigma", L(2.0)), e.filter("user_id = 7").withColumn("sigma", L(3.0)), key="day", rho=0.5)
    return out.filter("y is not null").select("day", F.round("y", 6).alias("y"), F.round("sigma", 6).alias("sigma"))


@query(f"""WITH g AS ({_GRID}), p AS (SELECT a.k, b.v, {_KM} km FROM g a JOIN g b ON a.k <> b.k WHERE a.k % 4 = 0 AND b.k % 4 <> 0), o AS (SELECT * FROM p WHERE km <= 8)
SELECT k AS station, round(sum(exp(-km * km / 18) * v) / sum(exp(-km * km / 18)), 4) AS v, count(*) AS n_donors FROM o GROUP BY 1 HAVING count(*) >= 2""")
def m34_regional_seasons(spark, d):
    """Seasons for stations without one of their own, from the donors near them."""
    grid = _grid(spark, d)
    given = network.donors(grid.select("station", "v", (D("station") % 4 != 0).alias("own_seasonal")), grid.select("station", "lat", "lon"))
    out = network.regional_seasonals(grid.filter("station % 4 = 0"), given, parameters=("v",), length_km=3.0, radius_km=8.0)
    return out.select("station", F.round("v", 4).alias("v"), "n_donors")


@query(f"""WITH g AS ({_GRID}), p AS (SELECT a.k, a.v own, b.v, {_KM} km FROM g a JOIN g b ON a.k <> b.k), o AS (SELECT k, any_value(own) own, sum(exp(-km * km / 18) * v) / sum(exp(-km * km / 18)) e FROM p WHERE km <= 8 GROUP BY 1 HAVING count(*) >= 2) SELECT round(median(abs(e - own)), 4) AS median_error, count(*) AS n FROM o""")
def m35_left_out(spark, d):
    """Each donor against what the others would give it."""
    out = network.left_out_errors(_grid(spark, d), parameters=("v",), length_km=3.0, radius_km=8.0)
    return out.select(F.round("median_error", 4).alias("median_error"), "n")


@query("""SELECT n_regionkey AS day, CAST(s_suppkey AS VARCHAR) AS site, 0.0::DOUBLE AS left_over, s_suppkey % 17 <> 3 AND s_suppkey % 10 <> 0 AS used FROM supplier, (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 3) WHERE s_suppkey % 17 <> 3 AND s_suppkey % 10 <> 0
UNION ALL SELECT n_regionkey, CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 10 <> 0 THEN 0.5 END, FALSE FROM supplier, (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 3) WHERE s_suppkey % 17 = 3 OR s_suppkey % 10 = 0""")
def m31_stabilised(spark, d):
    """Solutions brought into the frame of their reference sites: a planted frame comes off, planted blunders are screened."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier").select(k, (k * 37 % 1800 / L(10.0) - 90).alias("lat"), (k * 73 % 3600 / L(10.0) - 180).alias("lon"))
    x, y, z = geo.llh_to_xyz(D("lat"), D("lon"), L(0.0))
    s = s.select(k, x.alias("x"), y.alias("y"), z.alias("z")).join(read(spark, d, "nation").select(D("n_regionkey").alias("day")).distinct().filter("day < 3").withColumn("_", L(1)), L(1) == D("_")).drop("_")
    ref = D("s_suppkey") % 10 != 0
    blunder = F.when(D("s_suppkey") % 17 == 3, 0.5).otherwise(0.0)
    shift = {c: F.when(ref, L(a) * (1 + D("day")) + D(c) * 2e-9 + blunder) for c, a in (("x", 0.01), ("y", -0.02), ("z", 0.03))}
    rows = s.withColumns({f"d{c}": v for c, v in shift.items()} | {"site": D("s_suppkey").cast("string"), "sigma": L(0.001)})
    out = network.stabilised(rows, parameters=["xtran", "ytran", "ztran", "scale"], n_sigma=2.0)
    return out.select("day", "site", F.round(F.abs(D("dx")), 6).alias("left_over"), "used")


@query("SELECT o_custkey % 5 AS day, CASE WHEN o_custkey % 5 = 2 THEN 100 ELSE 90 END AS n_sites, CASE WHEN o_custkey % 5 = 2 THEN 'kept' ELSE 'new' END AS make FROM orders GROUP BY ALL")
def st07_shrink_guard(spark, d):
    """A new make with too few sites leaves the one before it."""
    days = read(spark, d, "orders").select((D("o_custkey") % 5).alias("day")).distinct()
    new = days.withColumn("n_sites", F.when(D("day") == 2, 70).otherwise(90))
    return network.not_shrunk(new, days.withColumn("n_sites", L(100)))


@query("""SELECT DISTINCT o_custkey AS site, CAST(o_orderdate AS DATE) AS day, min(o_totalprice) AS trace FROM orders GROUP BY 1, 2""")
def m33_one_per_site(spark, d):
    """Of two solutions of a site and day the one of smaller trace."""
    o = read(spark, d, "orders").select(D("o_custkey").alias("site"), D("o_orderdate").cast("date").alias("day"), D("o_totalprice").alias("trace"), D("o_orderkey").alias("position"))
    return network.one_per_site(o).select("site", "day", "trace")


@query(f"""WITH r AS ({_BASE}), g AS (SELECT station, session_code, component, count(*) n, max(t) - min(t) span FROM r GROUP BY ALL)
SELECT station, session_code, component, n AS n_epochs, CASE WHEN n < 120 AND span < 0.4 THEN 'epochs; span' WHEN n < 120 THEN 'epochs' WHEN span < 0.4 THEN 'span' END AS reason, CASE WHEN n < 120 OR span < 0.4 THEN 'skipped' ELSE 'estimated' END AS status FROM g""")
def m12_estimates(spark, d):
    """Station estimates behind gates."""
    out = network.estimates(_rebased(spark, d), keys=PART, least=120, least_span=0.4, seasons=(), origin=2020.0)
    return out.select(*PART, "n_epochs", "reason", "status")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'prior' WHEN s_suppkey % 3 = 0 THEN 'skipped' ELSE 'estimated' END AS status, CASE WHEN s_suppkey % 3 <> 0 THEN 1.0 WHEN s_suppkey % 2 = 0 THEN 7.5 END AS \"offset\", CASE WHEN s_suppkey % 3 <> 0 THEN 1.0 WHEN s_suppkey % 2 = 0 THEN 2.0 END AS rate FROM supplier")
def m15_prior(spark, d):
    """A skipped station takes its record of the frame before, anchored anew."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier").select(k.alias("k"))
    est = s.select("k", F.when(D("k") % 3 == 0, "skipped").otherwise("estimated").alias("status"), *[F.when(D("k") % 3 != 0, 1.0).alias(c) for c in ("offset", "rate")])
    prior = s.filter("k % 2 = 0").select("k", L(9.0).alias("offset"), L(2.0).alias("rate"))
    out = network.prior_fallback(est, prior, s.select("k", L(7.5).alias("offset")), keys=["k"], parameters=("offset", "rate"))
    return out.select("k", "status", "offset", "rate")


@query("SELECT s_suppkey AS k, 'rate' AS name, round(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal - 1 END, 4) AS change, round(CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal - 1) / 5 END, 4) AS in_sigmas FROM supplier")
def j41_compared(spark, d):
    """Parameters by name against those of the frame before."""
    s = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), L("rate").alias("name"), D("s_acctbal").alias("value"), L(3.0).alias("sigma"))
    out = network.compared_parameters(s, s.filter("k % 2 = 0").select("k", "name", L(1.0).alias("value"), L(4.0).alias("sigma")), keys=["k"])
    return out.select("k", "name", F.round("change", 4).alias("change"), F.round("in_sigmas", 4).alias("in_sigmas"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS rate FROM supplier")
def m24_secular_rate(spark, d):
    """The stored rate by its name; none in a record without it."""
    s = read(spark, d, "supplier")
    p = s.select(D("s_suppkey").alias("k"), F.when(D("s_suppkey") % 4 == 0, "annual").otherwise("rate").alias("name"), D("s_acctbal").alias("value"), L(1.0).alias("sigma"))
    return network.secular_rates(p, keys=["k"]).select("k", "rate")


@query("""SELECT * FROM (VALUES ('pre', 'rate', 'donor', 'DDDD', 2.5), ('post', 'rate', 'stage', 'pre', NULL), ('post', 'annual', 'store', 'SELF', 1.5)) t(stage, "group", origin, name, value)""")
def m36_resolved_plan(spark, d):
    """A staged plan with what is held from stages, donors and the store."""
    return spark.createDataFrame([(s["name"], h["group"], h["from"], h["name"], next(iter(h.get("values", {}).values()), None)) for s in _plan(2.5) for h in s["held"]], "stage string, group string, origin string, name string, value double")


def _plan(value: float) -> list[dict]:
    from seiche.plans.grammar import parse_hold, parse_stage

    holds = [parse_hold(h) for h in ("pre:rate=donor:DDDD", "post:rate=stage:pre", "annual=store:self")]
    return network.resolved_plan([parse_stage("pre:rate@2015:2019"), parse_stage("post:annual")], holds, donor=lambda n: {"rate": value}, store=lambda n: {"annual_cos": 1.5}, station="SELF")


@query("SELECT 'pre: rate of DDDD changed' AS warning")
def m38_donor_drift(spark, d):
    """A donor whose record is no longer the one borrowed."""
    return spark.createDataFrame([(w,) for w in network.donor_drift(_plan(2.5), _plan(2.75))], "warning string")


# Transients.

_TRANS = """SELECT s_suppkey k, 2020 + i / 100.0::DOUBLE t, 1.0 + 0.5 * (i / 100.0::DOUBLE) + (s_suppkey % 7) * (1 - exp(-(i / 100.0::DOUBLE) / 0.3)) y FROM supplier, range(0, 100) r(i)"""


def _relaxing(spark, d) -> DataFrame:
    rows = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), F.explode(F.sequence(L(0), L(99))).alias("i"))
    x = D("i") / L(100.0)
    return rows.select("k", (2020 + x).alias("t"), (1.0 + 0.5 * x + D("k") % 7 * (1 - F.exp(-x / 0.3))).alias("y"), L(1.0).alias("sigma"))


@query("SELECT 0.3::DOUBLE AS tau, count(*) AS n FROM supplier, range(0, 100)")
def m25_shared_decay(spark, d):
    """The relaxation time all series share, found again among others."""
    tau, rows = records.shared_decay(_relaxing(spark, d), keys=["k"], onset=2020.0, until=2021.0, taus=[0.1, 0.2, 0.3, 0.5, 0.8], rounds=1, times=1e9)
    return rows.agg(L(tau).alias("tau"), F.count("*").alias("n"))


@query("SELECT s_suppkey AS k, a AS at, round(0.5 + (s_suppkey % 7) / 0.3 * exp(-(a - 2020) / 0.3), 4) AS rate, a > 2020.99 + 1 / 365.25 AS extrapolated FROM supplier, (VALUES (2020.5::DOUBLE), (2021.5)) v(a)")
def m26_transients(spark, d):
    """Rates at dates of series that relax."""
    out = records.transients(_relaxing(spark, d), keys=["k"], onset=2020.0, tau=0.3, at=[2020.5, 2021.5])
    return out.select("k", "at", F.round("rate", 4).alias("rate"), "extrapolated")


# Positions.


@query("""WITH p AS (SELECT s_suppkey k, s_suppkey % 10 g, s_acctbal v FROM supplier) SELECT a.k AS k, round(a.v - b.v, 4) AS north FROM p a JOIN p b ON b.k = 1 WHERE a.k <> 1""")
def f45_apriori_baseline(spark, d):
    """A rover in the local frame of its reference: a move along the meridian at the equator's east end is north."""
    s = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), D("s_acctbal").alias("v"))
    ref = s.filter("k = 1").select(D("v").alias("rv"))
    rows = s.filter("k <> 1").join(ref, L(1) == L(1))
    n, _, _ = geo.baseline_neu((L(6378137.0), L(0.0), D("v")), (L(6378137.0), L(0.0), D("rv")), (L(6378137.0), L(0.0), L(0.0)))
    return rows.select("k", F.round(n, 4).alias("north"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE round(greatest(-1, least(1, sign(o) * o * o / 6)), 6) END AS rho FROM (SELECT s_suppkey, s_suppkey % 7 - 3 o FROM supplier)""")
def f49_correlations(spark, d):
    """Correlations from signed roots of covariances, cut at ±1, none without a sigma."""
    k = D("s_suppkey")
    rho = geo.signed_root_correlation((k % 7 - 3).cast("double"), L(2.0), F.when(k % 4 == 0, 0.0).otherwise(3.0))
    return read(spark, d, "supplier").select(k.alias("k"), F.round(rho, 6).alias("rho"))


@query("SELECT s_suppkey AS k, 4.0::DOUBLE AS c11, round(CASE WHEN s_suppkey % 2 = 0 THEN 3.0 ELSE 6.0 END, 6) AS c12 FROM supplier")
def f50_psd(spark, d):
    """Covariances from sigmas and correlations; possible ones stay as they are."""
    import numpy as np

    ks = [r[0] for r in read(spark, d, "supplier").select("s_suppkey").collect()]  # a check of the array function
    rho = np.array([[0.5 if k % 2 == 0 else 1.0, 0.0, 0.0] for k in ks])
    c = network.psd_covariance(np.tile([2.0, 3.0, 1.0], (len(ks), 1)), rho)
    return spark.createDataFrame([(k, round(float(m[0, 0]), 6), round(float(m[0, 1]), 6)) for k, m in zip(ks, c)], "k long, c11 double, c12 double")


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY station, session_code, component, t ORDER BY sigma, rec_id) n FROM ({_BASE})) SELECT rec_id, row_number() OVER (PARTITION BY station, session_code, component ORDER BY t) AS place FROM o WHERE n = 1""")
def w02_gathered(spark, d):
    """The rows of least sigma of each epoch in order of time."""
    return screens.gathered(_rebased(spark, d), PART, "t", "sigma", "rec_id").select("rec_id", "place")


@query("""SELECT s_suppkey AS k, round(-2 * (s_suppkey % 5), 6) AS east FROM supplier""")
def j40_sinex_baseline(spark, d):
    """A baseline of one solution in the first site's local frame, by both sites' joint covariance."""
    k = D("s_suppkey")
    _, e, _ = geo.baseline_neu((L(6378137.0), -2.0 * (k % 5), L(0.0)), (L(6378137.0), L(0.0), L(0.0)), (L(6378137.0), L(0.0), L(0.0)))
    return read(spark, d, "supplier").select(k.alias("k"), F.round(e + 0.0, 6).alias("east"))


@query(f"""WITH m AS (SELECT station, session_code, component, CASE WHEN component = 'N' THEN 0 ELSE 1 END o, y, t, rec_id FROM ({_BASE}) WHERE component IN ('N', 'E')), f AS (SELECT *, row_number() OVER (PARTITION BY station, session_code, component ORDER BY t, rec_id) a, row_number() OVER (PARTITION BY station, session_code, component ORDER BY t DESC, rec_id DESC) b FROM m)
SELECT station, session_code, round(avg(y) FILTER (o = 0 AND b <= 3) - avg(y) FILTER (o = 1 AND a <= 3), 5) AS move FROM f GROUP BY ALL""")
def j34_moved_station(spark, d):
    """What a later mark is moved by: the last of the one before less its own first."""
    s = _rebased(spark, d).filter("component in ('N', 'E')")
    w = W.partitionBy(*PART)
    s = s.withColumns({"a": F.row_number().over(w.orderBy("t", "rec_id")), "b": F.row_number().over(w.orderBy(D("t").desc(), D("rec_id").desc()))})
    mean = lambda c, n: F.avg(F.when((D("component") == c) & (D(n) <= 3), D("y")))
    return s.groupBy(*KEYS).agg(F.round(mean("N", "b") - mean("E", "a"), 5).alias("move"))


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS x, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def a08_day_means(spark, d):
    """Mean positions of days, over rows that have all components."""
    o = read(spark, d, "orders").select("o_custkey", D("o_orderdate").cast("date").alias("day"), D("o_totalprice").alias("x"), F.when(D("o_orderstatus") != "P", 1.0).alias("y"))
    return products.day_mean_position(o, ["o_custkey"], "day", ("x", "y")).select("o_custkey", "day", F.round("x", 4).alias("x"), "n")

