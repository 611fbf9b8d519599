"""The commands as queries: each is run as users would, over the tables, and its table compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seiche import cli
from seiche.catalogue import _PLACED, _SPLACED, _placed, query
from seiche.catalogue_products import _BASE, _RATE, _SUMS, KEYS, PART, _grid, _rebased, _residuals
from seiche.queries import read
from seiche.session import shared_dir

D, L = F.col, F.lit


def _written(df, name: str) -> str:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


@query(f"""WITH r AS ({_BASE}), w AS (SELECT *, t - 2020.2 x, 1 / (sigma * sigma) w FROM r WHERE t >= 2020.1 AND t < 2020.3), f AS (SELECT station, session_code, component, {_SUMS} FROM w GROUP BY ALL) SELECT station, session_code, component, n, round({_RATE}, 3) AS rate FROM f""")
def x20_velocities(spark, d):
    """The velocities command (X13, X20): the rates it accepts are those of the weighted line."""
    path = _written(_rebased(spark, d), "cli-series")
    got = cli.result(spark, ["velocities", path, "--since", "2020.1", "--until", "2020.3", "--least", "1"])
    every = cli.result(spark, ["rates", _written(_rebased(spark, d).filter("t >= 2020.1 and t < 2020.3"), "cli-window")]).select(*PART, D("rate").alias("line"), "n")
    out = every.join(got.filter("refused is null").select(*PART, "rate"), PART, "left")
    return out.select(*PART, "n", F.round(F.coalesce("rate", "line"), 3).alias("rate"))


@query(f"""WITH r AS (SELECT * FROM ({_BASE}) WHERE t >= 2020 AND t < 2020.3), s AS (SELECT station, session_code, component, min(struct_pack(t := t, y := y, s := sigma)) a, max(struct_pack(t := t, y := y, s := sigma)) b, count(*) n FROM r GROUP BY ALL)
SELECT station, session_code, component, round(b.y - a.y, 6) AS displacement FROM s WHERE n > 1""")
def x26_displacements(spark, d):
    """The displacements command under its old name."""
    out = cli.result(spark, ["displacemnts", _written(_rebased(spark, d), "cli-series"), "--since", "2020", "--until", "2020.3", "--method", "points"])
    return out.filter("refused is null").select(*PART, F.round("displacement", 6).alias("displacement"))


@query("SELECT row_id, magnitude FROM (SELECT row_id, magnitude, coordinates[1] x, coordinates[2] y FROM seiscomp_events) WHERE x BETWEEN -22.5 AND -20 AND y BETWEEN 63.5 AND 64.5 AND magnitude >= 1 AND NOT isnan(magnitude)")
def x14_select(spark, d):
    """The events command with a region and a smallest magnitude."""
    e = read(spark, d, "seiscomp_events").select("row_id", "magnitude", F.try_element_at("coordinates", L(1)).alias("longitude"), F.try_element_at("coordinates", L(2)).alias("latitude"))
    return cli.result(spark, ["fetch", _written(e, "cli-events"), "--region=-22.5/-20/63.5/64.5", "--least", "1"]).select("row_id", "magnitude")


@query(f"""WITH s AS (SELECT s_suppkey, {_SPLACED} FROM supplier), c AS (SELECT c_custkey, {_PLACED} FROM customer)
SELECT c_custkey, station FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, station) r FROM (
SELECT c_custkey, s_suppkey station, sqrt(pow((s.lat - c.lat) * 111.19, 2) + pow((s.lon - c.lon) * 111.19 * cos(radians((s.lat + c.lat) / 2)), 2)) km FROM c, s)) WHERE r <= 1""")
def x15_nearest(spark, d):
    """The nearest-station command."""
    points, stations = _written(_placed(read(spark, d, "customer"), "c_custkey"), "cli-points"), _written(_placed(read(spark, d, "supplier"), "s_suppkey"), "cli-stations")
    return cli.result(spark, ["nearest", points, stations, "--k", "1", "--point", "c_custkey", "--station", "s_suppkey"]).select("c_custkey", "station")


@query("SELECT s_suppkey AS k, 6378137.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM supplier")
def x15_convert(spark, d):
    """The conversion command."""
    s = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), L(0.0).alias("lat"), L(0.0).alias("lon"), L(0.0).alias("height"))
    return cli.result(spark, ["convert", _written(s, "cli-llh"), "--to", "xyz"]).select("k", F.round("x", 4).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(f"""WITH r AS ({_BASE}), g AS (SELECT station, session_code, component, count(*) n, max(t) - min(t) span FROM r GROUP BY ALL) SELECT station, session_code, component, CASE WHEN n < 100 OR span < 0.4 THEN 'skipped' ELSE 'estimated' END AS status FROM g""")
def x17_detrend(spark, d):
    """The trajectory command."""
    out = cli.result(spark, ["detrend", _written(_rebased(spark, d), "cli-series"), "--least", "100", "--least-span", "0.4", "--term", "step@2020.2"])
    return out.select(*PART, "status")


@query("""WITH v AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_votes, count(*) FILTER (WHERE value > 60) AS n_dominant FROM events GROUP BY 1)
SELECT day, n_votes, n_dominant FROM v""")
def x19_network_days(spark, d):
    """The command of the network's days."""
    e = read(spark, d, "events").select(D("ts").cast("date").alias("day"), (D("value") > 60).alias("dominant"))
    return cli.result(spark, ["network-days", _written(e, "cli-votes")]).select("day", "n_votes", "n_dominant")


@query("SELECT 'law' AS what, 1::BIGINT AS n UNION ALL SELECT 'seasons', (SELECT count(*) FROM (SELECT a.k FROM (SELECT s_suppkey k, 64 + (s_suppkey % 10) / 50.0::DOUBLE lat, -21 + CAST(floor(s_suppkey / 10) AS DOUBLE) / 20.0::DOUBLE lon FROM supplier) a JOIN (SELECT s_suppkey k, 64 + (s_suppkey % 10) / 50.0::DOUBLE lat, -21 + CAST(floor(s_suppkey / 10) AS DOUBLE) / 20.0::DOUBLE lon FROM supplier) b ON a.k <> b.k WHERE a.k % 4 = 0 AND sqrt(pow((b.lat - a.lat) * 111.19, 2) + pow((b.lon - a.lon) * 111.19 * cos(radians((b.lat + a.lat) / 2)), 2)) <= 8 GROUP BY 1 HAVING count(*) >= 2))")
def x22_network(spark, d):
    """The commands of baselines' noise and regional seasons."""
    grid = _written(_grid(spark, d), "cli-grid")
    law = cli.result(spark, ["baseline-noise", _written(_residuals(spark, d), "cli-residuals"), grid, "--max-km", "6"])
    seasons = cli.result(spark, ["regional-seasonal", _written(_grid(spark, d).filter("station % 4 = 0"), "cli-targets"), grid, "--params", "v", "--length-km", "3", "--radius-km", "8"])
    return law.agg(L("law").alias("what"), F.count("*").alias("n")).unionByName(seasons.agg(L("seasons").alias("what"), F.count("*").alias("n")))


@query(f"SELECT station, session_code, component, count(*) AS n FROM ({_BASE}) WHERE t >= 2020.1 AND t < 2020.2 GROUP BY ALL")
def x24_series(spark, d):
    """The series command with everything that was dropped."""
    out = cli.result(spark, ["savetimes", _written(_rebased(spark, d), "cli-series"), "--since", "2020.1", "--until", "2020.2", "--dropped"])
    return out.groupBy(*KEYS, "component").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS k, 0.3::DOUBLE AS tau, round(0.5 + (s_suppkey % 7) / 0.3 * exp(-0.5 / 0.3), 3) AS rate FROM supplier")
def x25_transient(spark, d):
    """The transient command."""
    from seiche.catalogue_products import _relaxing

    rows = _relaxing(spark, d).withColumns({"station": D("k").cast("string"), "session_code": L("s"), "component": L("N")}).withColumn("y", D("y") + 1e-9 * (D("k") % 3))
    out = cli.result(spark, ["transient", _written(rows, "cli-relaxing"), "--onset", "2020", "--until", "2021", "--taus", "0.1,0.3,0.8", "--at", "2020.5"])
    return out.select(D("station").cast("long").alias("k"), "tau", F.round("rate", 3).alias("rate"))


@query("SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1")
def x14_counts(spark, d):
    return cli.result(spark, ["counts", f"{d}/events.parquet", "--time", "ts"])


@query("SELECT s_suppkey % 5 AS day, count(*) AS n FROM supplier GROUP BY 1")
def x18_realign(spark, d):
    """The command that brings solutions into a frame."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier").select((k % 5).alias("day"), k.cast("string").alias("site"), *[(1e6 * F.cos(k * n)).alias(c) for n, c in enumerate("xyz", 1)], *[L(0.01).alias(f"d{c}") for c in "xyz"], L(0.001).alias("sigma"))
    out = cli.result(spark, ["realign", _written(s, "cli-solutions"), "--params", "xtran,ytran,ztran"])
    return out.filter("abs(dx) < 1e-9 and refused is null").groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS station, 2::BIGINT AS n FROM nation")
def x16_join_segments(spark, d):
    """The command that joins segments of text files."""
    from seiche.session import put_text

    folder = shared_dir(spark, "cli-segments")
    for (k,) in read(spark, d, "nation").select("n_nationkey").collect():  # a file each
        put_text(spark, f"{folder}/mb_S{k:03d}_1PS.dat1", [f"head\nhead\nhead\n2020.5 1.0 0.1\n2020.6 {k}.0 0.1\n"])
    out = cli.result(spark, ["join-segments", folder])
    return out.groupBy("station").agg(F.count("*").alias("n"))
