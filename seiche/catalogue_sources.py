"""Queries of the sources, sinks and documents, with the SQL that gives the same rows.

Tables are written as lines of a format and read again by its source, which takes lines as well as
paths; where a sink has the format, it writes them. Values have as many places as the format keeps.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.catalogue import query
from seiche.functions import timeaxis
from seiche.operators import screens
from seiche.plans import documents
from seiche.queries import read
from seiche.sinks import text as sinks
from seiche.sources import alerts, archive, gnss, tables, web
from seiche.sources.text import fixed_width

D, L, S = F.col, F.lit, F.format_string


def _lines(df: DataFrame, file: Column, order: list[str], line: Column, head: int = 0) -> DataFrame:
    """file, line_no, line: the rows of each file numbered in order, after ``head`` lines that are not there."""
    no = F.row_number().over(W.partitionBy("file").orderBy(*order)) + head
    return df.withColumns({"file": file, "line": line}).withColumn("line_no", no).select("file", "line_no", "line")


# Raw lines of fault planes: the table itself.

_FPS = r"""WITH w AS (SELECT line_id, string_split_regex(trim(regexp_replace(raw_line, '\s+', ' ', 'g')), ' ') w FROM fps_lines WHERE layout = 'fps' AND trim(regexp_replace(raw_line, '\s+', ' ', 'g')) <> '' AND raw_line NOT LIKE '#%')"""


def _fps_lines(spark, d):
    return read(spark, d, "fps_lines").filter("layout = 'fps'").select(F.concat("file_path", L("/"), D("line_id").cast("string"), L("/events.fps")).alias("file"), D("line_id").cast("int").alias("line_no"), D("raw_line").alias("line"))


@query(_FPS + r""" SELECT CAST(line_id AS INT) AS line_no, w[2] AS date, TRY_CAST(w[4] AS DOUBLE) AS latitude, w[23] = 'sp3' OR w[23] <> 'FILE' AS has_solution, CASE WHEN w[23] <> 'FILE' THEN TRY_CAST(w[24] AS DOUBLE) END AS strike_a FROM w WHERE len(w) = 33""")
def s26_fault_planes(spark, d):
    """Raw lines of events.fps as typed records; without a solution the planes are null."""
    good, _ = archive.fault_planes(spark, _fps_lines(spark, d))
    return good.select("line_no", "date", "latitude", "has_solution", "strike_a")


@query(_FPS + r""" SELECT CAST(line_id AS INT) AS line_no, 'fields ' || len(w) AS reason FROM w WHERE len(w) <> 33""")
def s26_failed_lines(spark, d):
    _, failed = archive.fault_planes(spark, _fps_lines(spark, d))
    return failed.select("line_no", "reason")


# Fixed-width day files, made of the events.

_EV = "SELECT row_id, (row_id * 37) % 9999 n, 63 + (row_id * 13) % 3000 / 1000.0::DOUBLE lat, -24 + (row_id * 29) % 9000 / 1000.0::DOUBLE lon, (row_id * 7) % 300 / 10.0::DOUBLE dep, (row_id * 11) % 60 / 10.0::DOUBLE m, (row_id * 31) % 86400 sec FROM sil_events"


def _events(spark, d):
    k = D("row_id")
    return read(spark, d, "sil_events").select(
        "row_id", (k * 37 % 9999).alias("n"), (63 + k * 13 % 3000 / L(1000.0)).alias("lat"), (-24 + k * 29 % 9000 / L(1000.0)).alias("lon"), (k * 7 % 300 / L(10.0)).alias("dep"), (k * 11 % 60 / L(10.0)).alias("m"), (k * 31 % 86400).alias("sec"),
    )


def _clock(width: int, places: int) -> Column:
    whole = S("%02d%02d%02d", (D("sec") / 3600).cast("int"), (D("sec") % 3600 / 60).cast("int"), (D("sec") % 60).cast("int"))
    return F.lpad(F.concat(whole, L("." + "0" * places)), width, " ")


_AT = "CAST(TIMESTAMP '2024-08-22' + to_seconds(sec) AS TIMESTAMP) AS t"


@query(f"SELECT row_id, CAST(n AS DOUBLE) AS num, {_AT}, lat AS latitude, lon AS longitude, dep AS depth, CASE WHEN row_id % 5 <> 0 THEN m END AS mlw, 'qu' AS event_type, '/2024/aug/22/' || row_id AS id FROM ({_EV})")
def s27_events_lib(spark, d):
    """Day files told apart by their widths."""
    mlw = F.when(D("row_id") % 5 != 0, S("%5.1f", "m")).otherwise(" ****")
    line = F.concat(S("%4d", "n"), L(" 20240822"), _clock(11, 3), S("%9.3f", "lat"), S("%10.3f", "lon"), S("%7.1f", "dep"), mlw, L("  qu"), F.lpad(F.concat(L("/2024/aug/22/"), D("row_id").cast("string")), 33, " "), L("      NaN"), S("%7.1f", "dep"), S("%7.1f", "m"), L("  9"))
    rows = _lines(_events(spark, d), L("/sil/2024/aug/22/events.lib"), ["row_id"], F.rpad(line, 136, " "))
    good, _ = archive.day_file(spark, rows, "events.lib")
    return good.select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("row_id"), "num", "t", "latitude", "longitude", "depth", "mlw", "event_type", "id")


@query(f"SELECT CAST(row_id AS INT) AS line_no, 'mag' || CASE WHEN row_id % 2 = 0 THEN '141' ELSE '134' END AS layout, lat AS latitude, m AS ml, dep AS min_dist_sta, CASE WHEN row_id % 2 = 0 THEN m END AS w_rms_res FROM ({_EV})")
def s28_lib_mag(spark, d):
    head = F.concat(S("%4d", "n"), L(" 20240822"), _clock(11, 3), S("%9.3f", "lat"), S("%10.3f", "lon"), S("%7.1f", "dep"), S("%6.1f", "m"), S("%6.1f", "m"), L("    9   0.1   2.2  8  5  3   4"), L("  0.10  0.20  0.30  0.40"))
    long, short = F.concat(head, S("%7.1f", "m"), S("%7.1f", "dep"), L("   120"), L(" a"), L(" qu")), F.concat(head, S("%7.1f", "dep"), L("   120"), L(" a"), L(" qu"))
    rows = _events(spark, d).select(L("/sil/lib.mag").alias("file"), D("row_id").cast("int").alias("line_no"), F.when(D("row_id") % 2 == 0, long).otherwise(short).alias("line"))
    good, _ = archive.day_file(spark, rows, "lib.mag")
    return good.select("line_no", "layout", "latitude", "ml", "min_dist_sta", "w_rms_res")


@query(f"SELECT CAST(row_id AS INT) AS line_no, CASE row_id % 3 WHEN 0 THEN 'aut89' WHEN 1 THEN 'aut57' ELSE 'aut61' END AS layout, m AS ml, CASE WHEN row_id % 3 < 2 THEN 55.5::DOUBLE END AS q, CASE WHEN row_id % 3 = 0 THEN '/2024/aaa/' || row_id END AS id FROM ({_EV})")
def s29_aut_mag(spark, d):
    head = F.concat(S("%4d", "n"), L(" 20240822"), _clock(9, 1), S("%8.3f", "lat"))
    own = F.concat(head, S("%9.3f", "lon"), S("%6.1f", "dep"), S("%6.1f", "m"), L("  55.5"))
    named = F.concat(own, F.rpad(F.concat(L("/2024/aaa/"), D("row_id").cast("string")), 32, " "))
    bare = F.concat(head, S("%10.3f", "lon"), S("%8.1f", "dep"), S("%13.1f", "m"))
    rows = _events(spark, d).select(L("/sil/aut.mag").alias("file"), D("row_id").cast("int").alias("line_no"), F.when(D("row_id") % 3 == 0, named).when(D("row_id") % 3 == 1, own).otherwise(bare).alias("line"))
    good, _ = archive.day_file(spark, rows, "aut.mag")
    return good.select("line_no", "layout", "ml", "q", "id")


@query(f"SELECT CAST(row_id AS INT) AS line_no, m AS ml, '/2024/aaa/' || row_id AS id, starts_with('/2024/aaa/' || row_id, '/2024/aaa/') AS replaced FROM ({_EV})")
def s30_cleanaut_mag(spark, d):
    line = F.concat(S("%4d", "n"), L(" 20240822"), _clock(9, 1), S("%8.3f", "lat"), S("%9.3f", "lon"), S("%6.1f", "dep"), S("%6.1f", "m"), L("  55.5"), F.rpad(F.concat(L("/2024/aaa/"), D("row_id").cast("string")), 32, " "))
    rows = _events(spark, d).select(L("/sil/cleanaut.mag").alias("file"), D("row_id").cast("int").alias("line_no"), line.alias("line"))
    good, _ = archive.day_file(spark, rows, "cleanaut.mag")
    return good.select("line_no", "ml", "id", D("id").startswith("/2024/aaa/").alias("replaced"))


@query(f"""SELECT CAST(row_id AS INT) AS line_no, CASE row_id % 4 WHEN 0 THEN 1993 WHEN 1 THEN 2024 WHEN 2 THEN 2085 ELSE 1990 END AS year, CASE row_id % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE m END AS ml,
'/2024/aug/22/' || lpad(CAST(row_id AS VARCHAR), 6, '0') || 'file' AS id, CASE WHEN row_id % 2 = 0 THEN '1' END AS flag FROM ({_EV})""")
def s31_events_ref(spark, d):
    """Centuries, magnitudes that mean none, ids of folder and file, in both layouts."""
    yy = F.element_at(F.array(*[L(x) for x in ("93", "24", "85", "90")]), (D("row_id") % 4 + 1).cast("int"))
    ml = F.when(D("row_id") % 3 == 0, "  -8.0").when(D("row_id") % 3 == 1, "  -9.3").otherwise(S("%6.1f", "m"))
    folder = F.lpad(F.concat(L("/2024/aug/22/"), F.lpad(D("row_id").cast("string"), 6, "0")), 31, " ")
    line = F.concat(L("    "), yy, L("0822"), L(" "), L("01:02:03.4"), S("%7.3f", "lat"), S("%7.2f", F.bround("lon", 2)), L("   55.50"), S("%7.1f", "dep"), ml, folder, L("        file"), L("     ref001"))
    line = F.when(D("row_id") % 2 == 0, F.concat(F.rpad(line, 110, " "), L("   1"))).otherwise(F.rpad(line, 108, " "))
    short = F.when(D("row_id") % 2 == 0, line).otherwise(F.substring(line, 1, 108))
    rows = _events(spark, d).select(L("/sil/events.ref").alias("file"), D("row_id").cast("int").alias("line_no"), short.alias("line"))
    good, _ = archive.day_file(spark, rows, "events.ref")
    return good.select("line_no", F.year("t").alias("year"), "ml", "id", "flag")


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'width 9' WHEN p_partkey % 11 = 0 THEN 'no number: v' END AS reason, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part""")
def s32_fixed_width(spark, d):
    """The engine of fixed columns: widths that are none, fields that are no number, stars."""
    from seiche.sources.text import Layout

    k = D("p_partkey")
    value = F.when(k % 11 == 0, "  x ").when(k % 5 == 0, "****").otherwise(S("%4d", "p_size"))
    rows = read(spark, d, "part").withColumn("line", F.when(k % 7 == 0, "123456789").otherwise(F.concat(S("%6d", k), value)))
    good, failed = fixed_width(rows.select(k.alias("k"), "line"), [Layout("a", 10, (("key", 0, 6), ("v", 6, 10)))])
    return good.select("k", L(None).cast("string").alias("reason"), "v").unionByName(failed.select("k", "reason", L(None).cast("double").alias("v")))


@query(f"SELECT '/b/' || row_id || '.sp3' AS file, round(m * 1e12, 0) AS moment_nm, lat AS strike_a, lon AS rake_b, CASE row_id % 3 WHEN 0 THEN 'Normal faulting dominates' WHEN 1 THEN 'Strike slip faulting dominates' END AS faulting FROM ({_EV})")
def s36_source_blocks(spark, d):
    label = F.when(D("row_id") % 3 == 0, "\n  Normal faulting dominates\n").when(D("row_id") % 3 == 1, "\n  Strike slip faulting dominates\n").otherwise("\n")
    body = F.concat(L("file: x\n seismic moment: "), S("%.6E", D("m") * 1e12), L("\nplane a "), S("%.3f", "lat"), L(" 45.0 -90.0\nplane b 10.0 20.0 "), S("%.3f", "lon"), label)
    rows = _events(spark, d).select(F.concat(L("/b/"), D("row_id").cast("string"), L(".sp3")).alias("file"), body.alias("value"))
    return archive.source_blocks(spark, rows).select("file", F.round("moment_nm", 0).alias("moment_nm"), "strike_a", "rake_b", "faulting")


# Position series.

_NEU = {"N": "1", "E": "2", "U": "3"}
_SER = "SELECT rec_id, station || '_' || session_code AS sc, station, session_code, component, t, round_even(y / 100, 2) v, round_even(sigma / 10, 2) s, sigma FROM series_epochs WHERE abs(y) < 100000 AND sigma > 0 AND sigma < 100"


def _axis_lines(spark, d, scheme: str = "TOT") -> DataFrame:
    """Files mb_STA_<scheme>.dat{1,2,3} of integers in micrometres; 3 lines of header are not there, but counted."""
    s = read(spark, d, "series_epochs").filter("abs(y) < 100000 and sigma > 0 and sigma < 100 and t is not null")
    axis = F.when(D("component") == "N", "1").when(D("component") == "E", "2").otherwise("3")
    code = F.rpad(F.concat(F.substring("station", 1, 4)), 4, "X")
    file = F.concat(L("/tot/"), D("session_code"), L("/mb_"), code, L(f"_{scheme}.dat"), axis)
    line = F.concat_ws(" ", S("%.8f", "t"), F.when(D("rec_id") % 17 == 0, "****").otherwise(S("%d", D("rec_id"))), S("%d", D("rec_id") % 9 + 1))
    return s.withColumn("axis", axis).transform(lambda x: _lines(x, file, ["t", "rec_id"], line, 3))


@query("""SELECT CASE WHEN rec_id % 17 <> 0 THEN CAST(rec_id AS DOUBLE) END AS value, CAST(rec_id % 9 + 1 AS DOUBLE) AS sigma, rpad(station[1:4], 4, 'X') AS station, CASE component WHEN 'N' THEN 1 WHEN 'E' THEN 2 ELSE 3 END AS axis, round(t, 8) AS yearf
FROM series_epochs WHERE abs(y) < 100000 AND sigma > 0 AND sigma < 100 AND t IS NOT NULL""")
def s01_component_files(spark, d):
    """Component files of three axes as one table of rows; stars are missing."""
    return gnss.component_rows(spark, _axis_lines(spark, d)).select("value", "sigma", "station", "axis", F.round("yearf", 8).alias("yearf"))


@query("""WITH r AS (SELECT rpad(station[1:4], 4, 'X') station, session_code, component c, round(t, 8) t, rec_id, rec_id % 9 + 1 s, row_number() OVER (PARTITION BY rpad(station[1:4], 4, 'X'), component, round(t, 8) ORDER BY rec_id % 9 + 1, session_code, rec_id) n
FROM series_epochs WHERE abs(y) < 100000 AND sigma > 0 AND sigma < 100 AND t IS NOT NULL)
SELECT station, t AS yearf, min(s) FILTER (c = 'N') AS d_north, min(s) FILTER (c = 'E') AS d_east, min(s) FILTER (c = 'U') AS d_up FROM r GROUP BY 1, 2""".replace("min(s)", "CAST(min(s) AS DOUBLE)").replace("CAST(min(s) AS DOUBLE) FILTER (c = 'N')", "CAST(min(s) FILTER (c = 'N') AS DOUBLE)").replace("CAST(min(s) AS DOUBLE) FILTER (c = 'E')", "CAST(min(s) FILTER (c = 'E') AS DOUBLE)").replace("CAST(min(s) AS DOUBLE) FILTER (c = 'U')", "CAST(min(s) FILTER (c = 'U') AS DOUBLE)"))
def w03_components_once(spark, d):
    """Per axis the row of least sigma of an epoch, the axes side by side."""
    rows = gnss.component_rows(spark, _axis_lines(spark, d)).withColumn("yearf", F.round("yearf", 8))
    return gnss.series(rows).select("station", "yearf", "d_north", "d_east", "d_up")


@query("""SELECT rpad(station[1:4], 4, 'X') AS station, session_code AS folder, CASE component WHEN 'N' THEN 1 WHEN 'E' THEN 2 ELSE 3 END AS axis, count(*) AS n FROM series_epochs WHERE abs(y) < 100000 AND sigma > 0 AND sigma < 100 AND t IS NOT NULL GROUP BY ALL""")
def s03_segments_found(spark, d):
    """The segments of each station and axis by folder."""
    rows = gnss.component_rows(spark, _axis_lines(spark, d, "1PS"))
    return rows.groupBy("station", F.element_at(F.split("file", "/"), -2).alias("folder"), "axis").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'A1PS' END AS marker, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 0.25::DOUBLE END AS reference_m, 1.5::DOUBLE AS value FROM supplier""")
def s02_segment_headers(spark, d):
    """Segments with the reference of their header, where they have one."""
    s = read(spark, d, "supplier").withColumn("file", F.concat(L("/pre/mb_"), S("A%03d", "s_suppkey"), L("_1PS.dat1")))
    head = F.when(D("s_suppkey") % 2 == 0, F.concat(S("A%03d", "s_suppkey"), L("_A1PS to N Solution 1 + "), S("%.2f", D("s_suppkey") + 0.25), L(" m"))).otherwise("no header")
    texts = F.array(F.struct(L(1).alias("no"), head.alias("l")), F.struct(L(4).alias("no"), L("2020.5 1.5 0.1").alias("l")))
    rows = s.select("file", F.explode(texts).alias("x")).select("file", D("x.no").alias("line_no"), D("x.l").alias("line"))
    out = gnss.segments(spark, rows)
    return out.select(F.expr("substring(station, 2)").cast("long").alias("k"), "marker", "reference_m", "value")


@query("SELECT s_suppkey AS k, 'TOT' AS scheme, 2020.5::DOUBLE AS yearf FROM supplier UNION ALL SELECT s_suppkey, 'PRE', 2020.5 FROM supplier WHERE s_suppkey % 3 = 0")
def s05_joined_schemes(spark, d):
    s = read(spark, d, "supplier")
    both = s.select(D("s_suppkey").alias("station"), L("TOT").alias("scheme"), L(2020.5).alias("yearf")).unionByName(s.select(D("s_suppkey").alias("station"), F.when(D("s_suppkey") % 3 == 0, "PRE").otherwise("OLD").alias("scheme"), L(2020.5).alias("yearf")))
    return gnss.joined_schemes(both, ["TOT", "PRE"]).select(D("station").alias("k"), "scheme", "yearf")


def _pos(spark, d) -> DataFrame:
    """Solutions of the suppliers' numbers, one file a station of ten."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier").withColumns({"station": S("ST%02d", k % 10), "date": F.date_format(F.date_add(L("2020-01-01").cast("date"), k.cast("int")), "yyyyMMdd"), "time": L("120000"), "mjd": (58849.5 + k)})
    s = s.withColumns({c: (a + k * b / L(1000.0)) for c, a, b in (("x", 2587000.0, 3), ("y", -1043000.0, -2), ("z", 5716000.0, 5))})
    s = s.withColumns({c: (k % 7 + 1) / L(1000.0) for c in ("sx", "sy", "sz", "sn", "se", "su")} | {c: L(0.1) for c in ("rxy", "rxz", "ryz", "rne", "rnu", "reu")})
    return s.withColumns({"lat": L(64.1), "lon": L(-21.9), "height": L(55.5), "dn": k / L(1000.0), "de": -k / L(1000.0), "du": k / L(500.0), "soln": L("final")})


def _pos_lines(spark, d) -> DataFrame:
    p = _pos(spark, d)
    files = p.select("station").distinct().withColumn("file", F.concat(L("/pos/"), D("station"), L(".vel.pos")))
    head = F.array(*[F.struct(L(n).alias("line_no"), t.alias("line")) for n, t in ((1, F.concat(L("4-character ID: "), D("station"))), (2, L("NEU Reference position :  64.1 338.1 55.5 (WGS84)")), (3, L("*YYYYMMDD HHMMSS")))])
    heads = files.select("file", F.explode(head).alias("h")).select("file", "h.*")
    body = sinks.position_lines(p.select(*gnss.POS_COLUMNS, "station"), keep=["station"])
    return heads.unionByName(_lines(body, F.concat(L("/pos/"), D("station"), L(".vel.pos")), ["date"], D("line"), 3))


@query("""SELECT 'ST' || lpad(CAST(s_suppkey % 10 AS VARCHAR), 2, '0') AS station, CAST(TIMESTAMP '2020-01-01 12:00:00' + to_days(CAST(s_suppkey AS INT)) AS TIMESTAMP) AS t, 2587000 + s_suppkey * 3 / 1000.0::DOUBLE AS x, -1043000 - s_suppkey * 2 / 1000.0::DOUBLE AS y, -21.9::DOUBLE AS lon, s_suppkey / 500.0::DOUBLE AS du FROM supplier""")
def s06_positions(spark, d):
    """Position files, written and read again."""
    out = gnss.positions(spark, _pos_lines(spark, d))
    return out.select("station", "t", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("lon", 9).alias("lon"), "du")


@query("SELECT DISTINCT 'ST' || lpad(CAST(s_suppkey % 10 AS VARCHAR), 2, '0') AS station, -21.9::DOUBLE AS lon, 64.1::DOUBLE AS lat FROM supplier")
def s08_position_stations(spark, d):
    """Stations of a set by the files' headers, inside a box."""
    out = gnss.placed_stations(gnss.position_headers(spark, _pos_lines(spark, d)), (-25.0, -13.0, 63.0, 67.0))
    return out.select("station", F.round("lon", 6).alias("lon"), "lat")


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN '.vel.pos' WHEN 1 THEN '.old.pos' ELSE '.vel.pos.gz' END AS suffix FROM supplier""")
def s07_position_files(spark, d):
    """The file of a station: the product's, else an earlier name's, plain before packed."""
    k = D("s_suppkey")
    names = F.when(k % 3 == 0, F.array(L(".vel.pos"), L(".vel.pos.gz"), L(".old.pos"))).when(k % 3 == 1, F.array(L(".old.pos"), L(".other.pos"), L(".old.pos.gz"))).otherwise(F.array(L(".vel.pos.gz"), L(".old.pos")))
    files = read(spark, d, "supplier").select(k.alias("k"), F.explode(names).alias("n")).select(F.concat(L("/p/s"), D("k").cast("string"), D("n")).alias("file"))
    out = gnss.position_files(files, "vel", ("old", "older"))
    return out.select(F.regexp_extract("station", r"(\d+)", 1).cast("long").alias("k"), F.regexp_extract("file", r"/s\d+(.*)$", 1).alias("suffix"))


@query("""WITH p AS (SELECT s_suppkey k, s_suppkey % 10 g, s_suppkey * 3 / 1000.0::DOUBLE x, -s_suppkey * 2 / 1000.0::DOUBLE y, s_suppkey * 5 / 1000.0::DOUBLE z FROM supplier), m AS (SELECT *, x - avg(x) OVER w dx, y - avg(y) OVER w dy, z - avg(z) OVER w dz FROM p WINDOW w AS (PARTITION BY g))
SELECT k, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS moved FROM m""")
def s09_local_series(spark, d):
    """Displacements from the mean position: their length is that of the Cartesian difference."""
    out = gnss.local_series(_pos(spark, d), "mean")
    return out.select(D("s_suppkey").alias("k"), F.round(F.sqrt(D("north") ** 2 + D("east") ** 2 + D("up") ** 2), 6).alias("moved"))


@query("SELECT s_suppkey AS k, s_suppkey / 1000.0::DOUBLE AS north, s_suppkey / 500.0::DOUBLE AS up FROM supplier")
def s09_file_columns(spark, d):
    """The file's own displacements."""
    return gnss.local_series(_pos(spark, d), "tssum").select(D("s_suppkey").alias("k"), "north", "up")


@query("SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS station, CAST(s_suppkey AS DOUBLE) AS x, s_suppkey * 2.0::DOUBLE AS y, s_suppkey * 3.0::DOUBLE AS z FROM supplier")
def s10_coordinates(spark, d):
    line = F.concat_ws(" ", S("%.1f", D("s_suppkey") * 1.0), S("%.1f", D("s_suppkey") * 2.0), S("%.1f", D("s_suppkey") * 3.0), S("st%03d", "s_suppkey"))
    return gnss.coordinate_list(spark, _lines(read(spark, d, "supplier"), L("/c.xyz"), ["s_suppkey"], line))


@query("SELECT s_suppkey AS k, s_suppkey + 0.5::DOUBLE AS x, -0.25::DOUBLE AS adjust_y, 0.001::DOUBLE AS sigma_z FROM supplier WHERE s_suppkey % 4 <> 0")
def s12_listed_positions(spark, d):
    """Positions of a solution's listing; sites without all three axes are none."""
    site = S("S%03d_GPS", "s_suppkey")
    row = lambda axis: F.concat(L("  12. "), site, L(f" {axis} coordinate  (m)   "), S("%.4f", D("s_suppkey") + 0.5), L("  -0.2500   0.0010"))
    texts = F.when(D("s_suppkey") % 4 == 0, F.array(row("X"), row("Y"))).otherwise(F.array(row("X"), row("Y"), row("Z"), L("other text")))
    rows = read(spark, d, "supplier").select(D("s_suppkey"), F.posexplode(texts).alias("p", "line")).select(L("/o.org").alias("file"), (D("s_suppkey") * 10 + D("p")).cast("int").alias("line_no"), "line")
    return gnss.listed_positions(spark, rows).select(F.substring("site", 2, 3).cast("long").alias("k"), "x", "adjust_y", "sigma_z")


@query("""SELECT * FROM (VALUES ('codes', '["ABCD", "EFGH"]'), ('unsupported', '["equate"]'), ('params', '["xtran", "scale"]'), ('iterations', '4.0'), ('rel', '0.5'), ('nsig', '3.0')) t(name, value)""")
def s13_listed_setup(spark, d):
    text = "x\n Summary of GLORG command file\n ====\n use_site clear\n use_site abcd_gps wxyz efgh -WXYZ\n pos_org xtran scale odd ! note\n stab_ite 4 0.5 3\n equate a b\n# note\n-----\n use_site zzzz\n"
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in gnss.listed_setup(text).items()], "name string, value string")


@query("SELECT * FROM (VALUES (1, 'CCCC'), (2, 'DDDD')) t(place, prefix)")
def s16_stabilisation_sites(spark, d):
    names = gnss.stabilisation_sites([" stab_site aaaa bbbb\n", " stab_site clear cccc/dddd cccc ! x\n# stab_site eeee\n"])
    return spark.createDataFrame(list(enumerate(names, 1)), "place long, prefix string")


@query("SELECT s_suppkey AS k, 'A' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS rover, 'BASE' AS reference FROM supplier WHERE s_suppkey % 3 <> 0")
def s18_listed_baselines(spark, d):
    name = F.when(D("s_suppkey") % 3 == 0, "notes").otherwise(F.concat(S("A%03d", "s_suppkey"), L("-BASE")))
    out = gnss.listed_baselines(read(spark, d, "supplier").select(F.concat(L("/rtk/"), name).alias("file")))
    return out.select(F.substring("rover", 2, 3).cast("long").alias("k"), "rover", "reference")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-03-04'")
def s91_solution_days(spark, d):
    name = F.concat(L("/a/"), D("o_orderkey").cast("string"), L("_X_"), F.date_format("o_orderdate", "yyyyDDD"), L("0000_01D_01D_SOL.SNX.gz"))
    out = gnss.solution_days(read(spark, d, "orders").select(name.alias("file")), "1996-02-01", "1997-03-04")
    return out.select(F.regexp_extract("file", r"/a/(\d+)_X", 1).cast("long").alias("o_orderkey"), "day")


@query("SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, '1\\d$|^PART_2')")
def s92_lines_with_stations(spark, d):
    rows = read(spark, d, "part").select(D("p_partkey").alias("k"), D("p_name").alias("line"))
    return gnss.lines_with_stations(rows, [r"1\d$", "^PART_2"]).select("k")


@query("SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS sta, 60 + s_suppkey / 100.0::DOUBLE AS latitude, -20.5::DOUBLE AS longitude, 12.0::DOUBLE AS height FROM supplier WHERE s_suppkey % 5 <> 0")
def s93_station_table(spark, d):
    line = F.concat(S("s%03d", "s_suppkey"), S("%9.2f", 60 + D("s_suppkey") / L(100.0)), L("    -20.50"), F.when(D("s_suppkey") % 5 == 0, "      ").otherwise("  12.0"))
    return gnss.station_table(read(spark, d, "supplier").select(line.alias("line")))


# Solutions.


def _snx(spark, d) -> DataFrame:
    """One SINEX text for each of ten groups, of one station with a covariance matrix."""
    k = D("n_regionkey")
    est = lambda i, c, v: F.concat(L(f"     {i} STA{c}   AKUR  A    1 24:060:43200 m    2  "), S("%.4f", v), L("  0.10000\n"))
    prior = lambda i, c: L(f"     {i} STA{c}   AKUR  A    1 24:060:43200 m    2  1000.0000  0.1\n")
    body = F.concat(
        L("%=SNX\n+SOLUTION/ESTIMATE\n"), est(1, "X", k + 1.5), est(2, "Y", k + 2.5), est(3, "Z", k + 3.5), L("-SOLUTION/ESTIMATE\n+SOLUTION/APRIORI\n"), prior(1, "X"), prior(2, "Y"), prior(3, "Z"), L("-SOLUTION/APRIORI\n+SOLUTION/MATRIX_ESTIMATE L COVA\n"),
        L("     1     1  0.01\n     2     1  0.002 0.01\n     3     1  0.001 0.003 0.01\n-SOLUTION/MATRIX_ESTIMATE L COVA\n%ENDSNX\n"),
    )
    return read(spark, d, "nation").select(k).distinct().select(F.concat(L("/s/"), k.cast("string"), L(".snx")).alias("file"), body.alias("value"))


@query("""SELECT '/s/' || n_regionkey || '.snx' AS file, i AS idx, n_regionkey + i + 0.5::DOUBLE AS estimate, 0.1::DOUBLE AS sigma, 1000.0::DOUBLE AS apriori, CASE i WHEN 1 THEN 0.01 WHEN 2 THEN 0.002 ELSE 0.001 END::DOUBLE AS first_cell, TIMESTAMP '2024-02-29 12:00:00' AS t
FROM (SELECT DISTINCT n_regionkey FROM nation), range(1, 4) r(i)""")
def s11_sinex(spark, d):
    return gnss.sinex(spark, _snx(spark, d)).select("file", "idx", "estimate", "sigma", "apriori", D("covariance")[0].alias("first_cell"), "t")


@query("SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '_GPS' AS site, CASE WHEN s_suppkey % 2 = 0 THEN 7.0 ELSE 1.0 END::DOUBLE AS x, CASE WHEN s_suppkey % 2 = 0 THEN 2012.0 ELSE 2010.0 END::DOUBLE AS epoch FROM supplier")
def s14_apriori(spark, d):
    """A-priori positions; a later line overrides an earlier one, extended terms are no position."""
    site = S(" s%03d_gps", "s_suppkey")
    one, two = F.concat(site, L(" 1 2 3 0 0 0 2010.0")), F.concat(site, L(" 7 8 9 0 0 0 2012.0 ! later"))
    texts = F.when(D("s_suppkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one, F.concat(L(" EXTENDED"), site, L(" LOG 1 2 3 4 5"))))
    rows = read(spark, d, "supplier").select("s_suppkey", F.posexplode(texts).alias("p", "line")).select(L("/a.apr").alias("file"), (D("s_suppkey") * 10 + D("p")).cast("int").alias("line_no"), "line")
    return gnss.apriori(spark, [rows]).select("site", "x", "epoch")


def _renames(spark, d) -> DataFrame:
    code = S("S%03d", "s_suppkey")
    texts = F.array(F.concat(L(" rename "), code, L("_GPS "), code, L("_2PS 2010 1 2 3 4 2012 1 1 0 0")), F.concat(L(" rename "), code, L("_2PS "), code, F.when(D("s_suppkey") % 5 == 0, "_XCL").otherwise("_3PS"), L(" h1234 2011 1 1 0 0")))
    return read(spark, d, "supplier").select("s_suppkey", F.posexplode(texts).alias("p", "line")).select(L("/eq").alias("file"), (D("s_suppkey") * 10 + D("p")).cast("int").alias("line_no"), "line")


@query("""SELECT s_suppkey AS k, 0 AS p, TIMESTAMP '2010-01-02 03:04:00' AS start, TIMESTAMP '2012-01-01' AS "end" FROM supplier UNION ALL SELECT s_suppkey, 1, TIMESTAMP '2011-01-01', NULL FROM supplier""")
def s15_renames(spark, d):
    out = gnss.renames(spark, _renames(spark, d))
    return out.select(F.floor(D("line_no") / 10).alias("k"), (D("line_no") % 10).alias("p"), D("start").cast("timestamp_ntz").alias("start"), D("end").cast("timestamp_ntz").alias("end"))


_NAMES = """WITH s AS (SELECT s_suppkey k, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') code, make_timestamp(2009 + CAST(s_suppkey % 5 AS INT), 6, 1, 0, 0, 0.0) AS "when", 2009 + s_suppkey % 5 y FROM supplier),
n AS (SELECT *, CASE WHEN y = 2009 OR y >= 2012 THEN code || '_GPS' WHEN y = 2010 THEN code || '_2PS' ELSE code || CASE WHEN k % 5 = 0 THEN '_XCL' ELSE '_3PS' END END name FROM s)"""


def _sites(spark, d):
    k = D("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), S("S%03d", k).alias("code"), F.make_timestamp_ntz(2009 + k.cast("int") % 5, L(6), L(1), L(0), L(0), L(0)).alias("when"), (2009 + k % 5).cast("double").alias("yearf"))


@query(_NAMES + """ SELECT code, name FROM n""")
def j45_names_at(spark, d):
    """The name of a site at a time, by its renames one after the other."""
    return gnss.names_at(_sites(spark, d), gnss.renames(spark, _renames(spark, d))).select("code", "name")


@query(_NAMES + """ SELECT code, CASE WHEN name LIKE '%XCL' THEN 'excluded' WHEN NOT (name LIKE 'S00%' OR name LIKE 'S01%') THEN 'not stab_site ' || name WHEN k % 2 = 1 OR name NOT LIKE '%GPS' THEN 'no apr ' || name END AS skipped,
CASE WHEN name LIKE '%GPS' AND (name LIKE 'S00%' OR name LIKE 'S01%') AND k % 2 = 0 THEN 7.0 + 0.5 * (y - 2012) END::DOUBLE AS x FROM n""")
def j39_apriori_lookup(spark, d):
    """A-priori positions through renames and the list of reference sites, with the reason where there is none."""
    k = D("s_suppkey")
    apr = read(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(S("S%03d_GPS", k).alias("site"), *[L(7.0).alias(c) for c in "xyz"], *[L(0.5).alias(f"v{c}") for c in "xyz"], L(2012.0).alias("epoch"))
    out = gnss.apriori_lookup(_sites(spark, d), apr, gnss.renames(spark, _renames(spark, d)), ["S00", "S01"])
    return out.select("code", "skipped", "x")


@query("SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '_GPS' AS site, CAST(s_suppkey * 2 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS idx FROM supplier WHERE s_suppkey % 7 <> 0")
def j38_matched_sites(spark, d):
    """Listed sites and the rows of a solution by code and nearest a-priori position, within a metre."""
    k = D("s_suppkey")
    s = read(spark, d, "supplier")
    far = F.when(k % 7 == 0, 5.0).otherwise(0.0)
    sol = s.select(S("S%03d", k).alias("code"), (k * 2).alias("idx"), *[(100.0 + F.when(k % 3 == 0, 0.5).otherwise(0.1) + far).alias(f"a{c}") for c in "xyz"]).unionByName(s.select(S("S%03d", k).alias("code"), (k * 2 + 1).alias("idx"), *[(100.0 + 0.3 + far).alias(f"a{c}") for c in "xyz"]))
    listed = s.select(S("S%03d_GPS", k).alias("site"), *[L(100.5).alias(c) for c in "xyz"], *[L(0.5).alias(f"adjust_{c}") for c in "xyz"])
    return gnss.matched_sites(sol, listed).select("site", "idx")


# Epochs of 1 Hz.


def _rtk_lines(spark, d) -> DataFrame:
    k = D("event_id")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS"), S("%d.0", k), S("-%d.0", k), L("35.0"), F.when(k % 9 == 0, "5").otherwise("1"), L("12"), F.when(k % 10 == 0, "0.5").otherwise("0.007"), L("0.007 0.007 0 0 0 1.0 9.9"))
    e = read(spark, d, "events")
    return e.select(F.concat(L("/rtk/"), F.date_format("ts", "yyyyMMdd")).alias("file"), F.when(k % 50 == 3, "% note").otherwise(line).alias("line"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total, count(*) FILTER (event_id % 9 = 0) AS bad FROM events WHERE event_id % 50 <> 3")
def s17_rtk_epochs(spark, d):
    out = gnss.rtk_epochs(spark, _rtk_lines(spark, d))
    return out.agg(F.count("*").alias("n"), F.sum("east").alias("total"), F.count_if(D("q") == 5).alias("bad"))


@query("""WITH e AS (SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) + to_milliseconds(CAST(extract('millisecond' FROM ts) AS BIGINT) % 1000) t, event_id k FROM events WHERE event_id % 50 <> 3),
o AS (SELECT t, max(k) k FROM e GROUP BY 1) SELECT time_bucket(INTERVAL 1 HOUR, t) AS bucket, CAST(median(k) AS DOUBLE) AS east, count(*) AS n FROM o WHERE k % 9 <> 0 AND k % 10 <> 0 GROUP BY 1""")
def s19_rtk_medians(spark, d):
    """Medians of hours over epochs that pass; an epoch given twice counts once."""
    return gnss.rtk_medians(gnss.rtk_epochs(spark, _rtk_lines(spark, d)), "1 hour").select("bucket", "east", "n")


@query("""SELECT s_suppkey AS k, s_suppkey + 0.5::DOUBLE AS rms, CAST(s_suppkey % 90 AS DOUBLE) AS num, CASE WHEN s_suppkey % 2 = 0 THEN 2.0::DOUBLE END AS az_absmean FROM supplier""")
def s20_autcln(spark, d):
    """Summaries of cleaning: the last iteration stands, a value run into the site is cut off."""
    k = D("s_suppkey")
    site = S("S%03d", k)
    texts = F.array(F.concat(L("RMS  1 "), site, L(" 999.0")), F.concat(L("RMS  2 "), site, F.when(k % 3 == 0, "").otherwise(" "), S("%.1f", k + 0.5)), F.concat(L("NUM 2 "), site, S(" %d", k % 90)), F.when(k % 2 == 0, F.concat(L("AZMEAN "), site, L(" -1.0 3.0 99.9"))).otherwise("AZMEAN Site 1 2"))
    rows = read(spark, d, "supplier").select(k, F.posexplode(texts).alias("p", "line")).select(L("f").alias("file"), (k * 10 + D("p")).cast("int").alias("line_no"), "line")
    return gnss.autcln_statistics(rows).select(F.substring("site", 2, 3).cast("long").alias("k"), "rms", "num", "az_absmean")


# Services.


@query("""SELECT row_id, round(lat, 6) AS latitude, m AS magnitude, CAST(TIMESTAMP '2024-08-22' + to_seconds(sec) AS TIMESTAMP) AS time, CASE WHEN row_id % 2 = 0 THEN 'automatic' ELSE 'manual' END AS mode FROM (""" + _EV + ")")
def s47_fdsn_events(spark, d):
    """Text of an event service; the mode follows from the author."""
    at = F.date_format(F.timestamp_seconds(D("sec") + 1724284800), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    line = F.concat_ws("|", D("row_id").cast("string"), at, S("%.3f", "lat"), S("%.3f", "lon"), L(""), F.when(D("row_id") % 2 == 0, "scautoloc").otherwise("an analyst"), *[L(x) for x in ("c", "c", "i", "Mlw")], S("%.1f", "m"), *[L(x) for x in ("a", "here", "earthquake")])
    good, _ = web.fdsn_events(spark, _events(spark, d).select(L("f").alias("file"), line.alias("line")))
    return good.select(D("event_id").cast("long").alias("row_id"), F.round("latitude", 6).alias("latitude"), "magnitude", D("time").cast("timestamp_ntz").alias("time"), D("evaluation_mode").alias("mode"))


@query("""SELECT s_suppkey AS k, 'HHZ' AS channel, 66.1::DOUBLE AS latitude, TIMESTAMP '2014-01-01' AS start_time, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2020-06-01 12:00:00' END AS end_time FROM supplier WHERE s_suppkey % 9 <> 0""")
def s66_fdsn_channels(spark, d):
    """Text of a station service; an open end is null, lines of another length fail."""
    k = D("s_suppkey")
    line = F.when(k % 9 == 0, "bad|1").otherwise(F.concat(S("VI|s%03d", k), L("||HHZ|66.1|-17.9|10|0|0|-90|sensor|1|1|M/S|100|2014-01-01T00:00:00|"), F.when(k % 2 == 0, "2020-06-01T12:00:00Z").otherwise("")))
    good, _ = web.fdsn_channels(spark, read(spark, d, "supplier").select(L("f").alias("file"), line.alias("line")))
    return good.select(F.substring("station", 2, 3).cast("long").alias("k"), "channel", "latitude", "start_time", "end_time")


@query(f"""SELECT row_id AS k, round(lon, 6) AS longitude, CASE WHEN row_id % 10 <> 0 THEN m END AS magnitude, row_id % 50 AS n_phases FROM ({_EV})""")
def s45_geojson_events(spark, d):
    """Events of a GeoJSON answer: impossible magnitudes null, numbers as text read."""
    p = F.struct(D("row_id").cast("string").alias("event_id"), L("2024-08-22T01:02:03Z").alias("time"), F.when(D("row_id") % 10 == 0, 99.0).otherwise(D("m")).alias("magnitude"), (D("row_id") % 50).cast("string").alias("phases"))
    feature = F.to_json(F.struct(L("Feature").alias("type"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), p.alias("properties")))
    texts = _events(spark, d).groupBy((D("row_id") % 7).alias("g")).agg(F.concat(L('{"features": ['), F.array_join(F.collect_list(feature), ","), L("]}")).alias("value"))
    out = web.geojson_events(spark, texts.select(D("g").cast("string").alias("file"), "value"), "quakes-seiscomp")
    return out.select(D("event_id").cast("long").alias("k"), F.round("longitude", 6).alias("longitude"), "magnitude", "n_phases")


# Alerts.


@query("""SELECT s_suppkey AS k, CAST(TIMESTAMP '2025-02-03 01:02:03' AS TIMESTAMP) AS t, 12 AS n_stations, 'abc' AS station, s_suppkey + 0.25::DOUBLE AS pgv FROM supplier""")
def s59_detections(spark, d):
    """Detections with their stations; a station given twice keeps its first row."""
    k = D("s_suppkey")
    texts = F.array(F.concat(S("%03d", k), L(" 33 44 55 Mon Feb 03 01:02:03 2025   2 12")), F.concat(L("-20.5 63.5 40 "), S("%.2f", k + 0.25), L(" abc 7.5 3 0 20.25 0")), L("-20.5 63.5 40 99.0 abc 7.5 3 0 20.25 0"))
    rows = read(spark, d, "supplier").select(F.concat(L("/a/"), k.cast("string"), L(".event")).alias("file"), F.posexplode(texts).alias("p", "line")).select("file", (D("p") + 1).alias("line_no"), "line")
    head, stations = alerts.detections(spark, rows)
    return head.join(stations.select("file", "station", "pgv"), "file").select(D("alert_id").cast("long").alias("k"), "t", "n_stations", "station", "pgv")


@query("SELECT s_suppkey AS k, lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || ':30:15' AS clock, CAST(s_suppkey AS INT) AS n_a, CAST(s_suppkey * 2 AS INT) AS n_b FROM supplier")
def s60_day_index(spark, d):
    k = D("s_suppkey")
    row = F.concat(L('<tr><td>[<a href="'), S("%03d", k), L('.html">'), S("%02d:30:15", k % 24), L("</a>] \n</td><td> "), k.cast("string"), L("</td><td>   "), (k * 2).cast("string"), L("</td></tr>\n"))
    pages = read(spark, d, "supplier").groupBy((k % 5).cast("string").alias("file")).agg(F.concat(L("<table>"), F.array_join(F.collect_list(row), ""), L("</table>")).alias("value"))
    return alerts.day_index(spark, pages).select(D("alert_id").cast("long").alias("k"), "clock", "n_a", "n_b")


@query("SELECT s_suppkey AS k, CAST(TIMESTAMP '2026-11-12 02:43:03' AS TIMESTAMP) AS t, 60 + s_suppkey / 1000.0::DOUBLE AS lat, s_suppkey % 50 / 10.0::DOUBLE AS magnitude, 'D' AS grade FROM supplier")
def s61_located(spark, d):
    k = D("s_suppkey")
    line = F.concat(S(" %03d 20261112 024303.4 ", k), S("%8.3f", 60 + k / L(1000.0)), L("  -18.100 4.000 "), S("%5.2f", k % 50 / L(10.0)), L(" D 000  0.39"))
    return alerts.located(spark, _lines(read(spark, d, "supplier"), L("/x/alert.mag"), ["s_suppkey"], line)).select(D("alert_id").cast("long").alias("k"), "t", "lat", "magnitude", "grade")


@query("SELECT s_suppkey AS k, 66.25::DOUBLE AS latitude, CAST(s_suppkey AS DOUBLE) AS depth_km, 'abc' AS station, 31.5::DOUBLE AS distance_km FROM supplier")
def s62_phases(spark, d):
    k = D("s_suppkey")
    texts = F.array(L(" origin time 25 02 03   00h 09m 28.4s +/- 0.10s"), L(" latitude  66.250  +/- 0.006 deg."), L(" longitude-18.500  +/- 0.009"), F.concat(L(" focal depth "), S("%.1f", k * 1.0), L("  +/-   1.8 km")), L(" abc p 00 09 33.88  0.01  11.1  31.5 114.3  255.9"))
    rows = read(spark, d, "supplier").select(F.concat(L("/a/"), k.cast("string"), L(".evb")).alias("file"), F.posexplode(texts).alias("p", "line")).select("file", (D("p") + 1).alias("line_no"), "line")
    origins, phases = alerts.phases(spark, rows)
    return origins.join(phases.select("file", "station", "distance_km"), "file").select(F.regexp_extract("file", r"(\d+)\.evb", 1).cast("long").alias("k"), "latitude", "depth_km", "station", "distance_km")


@query("SELECT s_suppkey AS k, 31.5::DOUBLE AS km FROM supplier")
def j27_phase_distances(spark, d):
    """The distance of a station: that of its first phase."""
    k = D("s_suppkey")
    rows = read(spark, d, "supplier").select(k.alias("file"), F.explode(F.array(F.struct(L(1).alias("line_no"), L("abc").alias("station"), L(31.5).alias("distance_km")), F.struct(L(2).alias("line_no"), L("abc").alias("station"), L(99.0).alias("distance_km")))).alias("p")).select("file", "p.*")
    return alerts.station_distances(rows).select(D("file").alias("k"), D("distance_km").alias("km"))


# Small tables and documents.


@query("""SELECT s_suppkey AS k, 'S' || s_suppkey AS station, 'rap' AS drop_dir, CASE WHEN s_suppkey % 2 = 0 THEN 2010.5 END::DOUBLE AS drop_before_year FROM supplier""")
def s74_exclusions(spark, d):
    rows = [{"station": f" s{r[0]}", "drop_dir": "rap", "drop_before_year": "2010.5" if r[0] % 2 == 0 else "", "reason": "reviewed"} for r in read(spark, d, "supplier").select("s_suppkey").collect()]
    return documents.reasoned_rules(spark, rows, "exclusions").select(F.regexp_extract("station", r"(\d+)", 1).cast("long").alias("k"), "station", "drop_dir", "drop_before_year")


@query("SELECT s_suppkey AS k, 'N' AS component, 2012.5::DOUBLE AS before_year, s_suppkey / 1000.0::DOUBLE AS offset_m FROM supplier")
def s75_junctions(spark, d):
    rows = [{"station": f"s{r[0]}", "component": "n", "before_year": "2012.5", "offset_m": str(r[0] / 1000), "reason": "reviewed"} for r in read(spark, d, "supplier").select("s_suppkey").collect()]
    return documents.reasoned_rules(spark, rows, "junctions").select(F.regexp_extract("station", r"(\d+)", 1).cast("long").alias("k"), "component", "before_year", "offset_m")


@query("SELECT DISTINCT 'S' || (s_suppkey % 10) AS station, 2015.25 + s_suppkey % 3 AS yearf FROM supplier")
def s80_excluded_epochs(spark, d):
    rows = [{"sta": f"s{r[0] % 10} ", "yearf": str(2015.25 + r[0] % 3)} for r in read(spark, d, "supplier").select("s_suppkey").collect()]
    return documents.excluded_epochs(spark, rows)


@query("""SELECT * FROM (VALUES ('A', 'exp', 2020.5, 0.5), ('A', 'step', 2021.0, NULL), ('B', 'log', 2019.0, 1.0)) t(station, kind, epoch, tau)""")
def s83_station_models(spark, d):
    models = documents.station_models({"A": {"terms": ["exp@2020.5,tau=0.5", "step@2021"]}, "B": {"terms": ["log@2019,tau=1"]}, "C": {}})
    return spark.createDataFrame([(s, t.kind, t.epoch, t.tau) for s, terms in models.items() for t in terms], "station string, kind string, epoch double, tau double")


@query("""SELECT * FROM (VALUES ('A', 1, 'pre', 'rate', 2015.0, 2019.0), ('A', 2, 'post', 'annual', NULL, NULL)) t(station, place, name, "group", since, until)""")
def s84_stage_plans(spark, d):
    plans = documents.stage_plans({"A": ["pre:rate@2015:2019", "post:annual"]})
    return spark.createDataFrame([(s, n, g.name, g.group, *(g.windows[0] if g.windows else (None, None))) for s, plan in plans.items() for n, g in enumerate(plan, 1)], "station string, place long, name string, group string, since double, until double")


@query("SELECT 'S' || s_suppkey AS station, 'N' AS component, 'rate' AS name, round(s_acctbal, 2) AS value FROM supplier")
def s85_secular_store(spark, d):
    """Saved backgrounds, each merged into one document that keeps the rest."""
    document: dict = {"other": {"kept": 1}}
    for k, v in read(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2)).collect():
        document = documents.merged_entry(document, ["secular"], f"S{k}", {"N": {"rate": v}})
    assert document["other"] == {"kept": 1}
    store = documents.secular_store(document["secular"])
    return spark.createDataFrame([(s, c, n, v) for s, cs in store.items() for c, ns in cs.items() for n, v in ns.items()], "station string, component string, name string, value double")


@query("""SELECT * FROM (VALUES ('set', 'keep: 1' || chr(10) || 'models:' || chr(10) || '  A:' || chr(10) || '    terms:' || chr(10) || '    - step@2020' || chr(10)), ('taken out', 'keep: 1' || chr(10))) t(step, text)""")
def k31_merged_yaml(spark, d):
    """One station's entry set in YAML text and taken out again."""
    one = documents.merge_yaml("keep: 1\n", ["models"], "A", {"terms": ["step@2020"]})
    return spark.createDataFrame([("set", one), ("taken out", documents.merge_yaml(one, ["models"], "A", None))], "step string, text string")


@query("SELECT n_nationkey AS k, 0.5::DOUBLE AS tau, '{' || chr(10) || ' \"schema\": 1,' || chr(10) || ' \"stations\": [' || chr(10) || '  \"' || n_name || '\"' || chr(10) || ' ],' || chr(10) || ' \"tau\": 0.5' || chr(10) || '}' || chr(10) AS text FROM nation")
def k28_decay_document(spark, d):
    """Byte-stable documents, read back with their schema checked."""
    out = []
    for k, name in read(spark, d, "nation").select("n_nationkey", "n_name").collect():
        text = documents.stable_json({"tau": 0.5, "schema": documents.DECAY_SCHEMA, "stations": [name]})
        out.append((k, documents.decay_record(text)["tau"], text))
    return spark.createDataFrame(out, "k int, tau double, text string")


@query("SELECT 'N' || n_nationkey AS station, CAST(n_nationkey AS DOUBLE) AS scale FROM nation")
def k27_noise_record(spark, d):
    """The record of baseline noise, written and read (K27, S86); another version is refused."""
    scale = {f"N{r[0]}": float(r[0]) for r in read(spark, d, "nation").select("n_nationkey").collect()}
    record = documents.noise_record(documents.stable_json({"record_version": documents.NOISE_VERSION, "station_scale": scale}))
    try:
        documents.noise_record('{"record_version": 0}')
    except ValueError:
        return spark.createDataFrame(list(record["station_scale"].items()), "station string, scale double")
    raise AssertionError("another version was read")


@query("""SELECT * FROM (VALUES ('1.0', 2.5), ('2.0', 1.5)) t(years, k)""")
def s88_k_table(spark, d):
    text = documents.stable_json({"schema": documents.K_SCHEMA, "frame": "plate", "k": {"1.0": 2.5, "2.0": 1.5}})
    table, _ = documents.k_table(text, "plate")
    try:
        documents.k_table(text, "itrf2008")
    except ValueError:
        return spark.createDataFrame(list(table["k"].items()), "years string, k double")
    raise AssertionError("another frame was read")


@query("SELECT 'S' || s_suppkey AS station, round(s_acctbal, 2) AS rate FROM supplier")
def k29_parameter_document(spark, d):
    """Records as one document, read back by the parameters' reader."""
    records = [{"station": f"S{k}", "frame": "plate", "params": {"N": {"rate": [v, 0.1]}}} for k, v in read(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2)).collect()]
    text = documents.stable_json(documents.parameter_document(reversed(records), frame="plate"))
    return tables.parameters_of(spark, json.loads(text)).select("station", D("value").alias("rate"))


@query("""SELECT * FROM (VALUES ('box', -22.0, -20.0), ('ring', NULL, NULL), ('shape', NULL, NULL)) t(name, west, east)""")
def s72_regions(spark, d):
    regions = documents.quake_regions({"box": {"bbox": [-22, -20, 63, 65], "min_magnitude": 1}, "ring": {"radius": [64, -21, 30]}, "shape": {"polygon": [[0, 0], [1, 0], [1, 1]], "event_types": ["earthquake"]}})
    return spark.createDataFrame([(n, *(s.box[:2] if s.box else (None, None))) for n, (s, _) in regions.items()], "name string, west double, east double")


@query("SELECT n_nationkey AS station FROM nation WHERE n_nationkey NOT IN (1, 2) AND n_nationkey BETWEEN 0 AND 12")
def p31_stacked_stations(spark, d):
    """Stations of a box that belong to no active area."""
    active = documents.active_stations({"volcanic_areas": {"x": {"stations": ["n1"]}, "y": ["N2"]}, "other_areas": {"z": ["N3"]}})
    n = read(spark, d, "nation").select(F.concat(L("N"), D("n_nationkey").cast("string")).alias("station"), D("n_nationkey").cast("double").alias("lon"), L(64.0).alias("lat"))
    return screens.stacked_stations(n, active, (0.0, 12.0, 63.0, 65.0)).select(F.substring("station", 2, 3).cast("int").alias("station"))


@query("SELECT s_suppkey AS k, 'E' || (s_suppkey % 3) AS plate FROM supplier")
def s90_plates(spark, d):
    texts = F.array(F.concat(S("s%03d", "s_suppkey"), L(" old")), F.concat(S("s%03d", "s_suppkey"), S(" e%d", D("s_suppkey") % 3)))
    rows = read(spark, d, "supplier").select("s_suppkey", F.posexplode(texts).alias("p", "line")).select(L("/p").alias("file"), (D("s_suppkey") * 2 + D("p")).cast("int").alias("line_no"), "line")
    return tables.plates(spark, rows).select(F.substring("station", 2, 3).cast("long").alias("k"), "plate")


@query("""SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS north, s_suppkey % 2 = 1 OR s_suppkey % 2 = 0 AND FALSE AS east, TRUE AS up FROM supplier""")
def s78_steps_by_component(spark, d):
    c = F.when(D("s_suppkey") % 2 == 0, F.array(L("N"), L("u"))).otherwise(F.array(L("E"), L("U")))
    steps = read(spark, d, "supplier").select(D("s_suppkey").cast("string").alias("sta"), L(2020.5).alias("epoch_yearf"), F.explode(c).alias("component"))
    return tables.steps_by_component(steps).select(D("sta").cast("long").alias("k"), "north", "east", "up")


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 2.0 WHEN s_suppkey % 3 = 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS gap FROM supplier""")
def j43_settings(spark, d):
    """A station's settings for a frame, else in general, else the defaults."""
    s = read(spark, d, "supplier").select(D("s_suppkey").cast("string").alias("sta"), D("s_suppkey").alias("k"))
    own = s.filter("k % 3 = 0").select("sta", L("plate").alias("frame"), L(2.0).alias("gap"))
    general = s.filter("k % 3 in (0, 1)").select("sta", L(None).cast("string").alias("frame"), L(1.5).alias("gap"))
    return tables.resolved_settings(s, own.unionByName(general), "plate", {"gap": 1.0}).select(D("sta").cast("long").alias("k"), "gap")


@query("""SELECT CAST(ts AS DATE) AS date, median(value) AS rms FROM events WHERE event_id % 5 <> 0 GROUP BY 1""")
def a06_median_over_networks(spark, d):
    """Per date the median over networks; rows without residuals are left out, unknown numbers kept."""
    num = F.when(D("event_id") % 5 == 0, 0.0).when(D("event_id") % 5 == 1, L(None).cast("double")).when(D("event_id") % 5 == 2, float("nan")).otherwise(7.0)
    rows = read(spark, d, "events").select(D("ts").cast("date").alias("date"), num.alias("num"), D("value").alias("rms"))
    return tables.median_over_networks(rows, ("rms",)).select("date", "rms")


@query("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS time, value AS q FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06' AND value IS NOT NULL")
def s69_hydrology(spark, d):
    """Texts of a yearly table, numbers coerced, closed on both ends."""
    rows = read(spark, d, "events").select(D("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), D("value").cast("string").alias("q"))
    out = tables.complete_rows(rows, "time", ["event_id", "q"], "2024-01-03", "2024-01-06")
    return out.select(D("event_id").cast("long").alias("event_id"), "time", "q")


@query("""WITH o AS (SELECT user_id, event_type kind, ts, value v FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0), f AS (SELECT user_id, min(ts) m FROM o GROUP BY 1)
SELECT o.ts AS observation_time, max(v) FILTER (kind = 'click') AS click, max(v) FILTER (kind = 'view') AS view FROM o JOIN f USING (user_id) WHERE ts > m GROUP BY 1""")
def s68_multigas(spark, d):
    """Observations of a station, one column a kind, the first of each acquisition left out."""
    e = read(spark, d, "events").filter("event_type in ('click', 'view')")
    kinds = spark.createDataFrame([(1, "click"), (2, "view")], "kind_id int, kind_name string")
    obs = e.select(D("user_id").alias("acquisition_id"), F.when(D("event_type") == "click", 1).otherwise(2).alias("kind_id"), D("ts").cast("timestamp_ntz").alias("observation_time"), "value")
    acq = e.select(D("user_id").alias("acquisition_id"), (D("user_id") % 2).cast("int").alias("station_id")).distinct()
    sta = spark.createDataFrame([(0, "even"), (1, "odd")], "station_id int, station_name string")
    return tables.multigas(obs, acq, sta, kinds, "even", "2000-01-01", "2100-01-01", ["click", "view"])


@query("SELECT event_id, time, depth_km FROM (SELECT row_id AS event_id, CAST(origin_time AS TIMESTAMP) AS time, depth_km FROM sil_events WHERE origin_time IS NOT NULL) WHERE time >= TIMESTAMP '2015-01-01' AND time < TIMESTAMP '2022-07-01'")
def s38_days_cached(spark, d):
    """Events written by day and read back by a range."""
    from seiche.session import shared_dir

    e = read(spark, d, "sil_events").filter("origin_time is not null").select(D("row_id").alias("event_id"), D("origin_time").cast("timestamp_ntz").alias("time"), "depth_km")
    path = shared_dir(spark, "days")
    archive.written_by_day(e.withColumn("time", D("time")), path)
    return archive.read_days(spark, path, "2015-01-01", "2022-07-01").select("event_id", "time", "depth_km")


# Sinks.


@query("""SELECT rec_id, format('{:10.5f}', t) || ' ' || CASE WHEN rec_id % 7 = 0 THEN '************' ELSE format('{:12.5f}', rec_id / 100.0) END || ' ' || format('{:8.5f}', rec_id % 90 / 1000.0) AS line FROM (SELECT rec_id, floor(t * 100) / 100 t FROM series_epochs WHERE t IS NOT NULL)""")
def k04_joined_lines(spark, d):
    """Lines of a joined component series."""
    s = read(spark, d, "series_epochs").filter("t is not null").select("rec_id", (F.floor(D("t") * 100) / 100).alias("yearf"), F.when(D("rec_id") % 7 != 0, D("rec_id") / L(100.0)).alias("value"), (D("rec_id") % 90 / L(1000.0)).alias("sigma"))
    return sinks.joined_lines(s, keep=["rec_id"]).select("rec_id", "line")


@query("""SELECT s_suppkey AS k, ' 2020.50000' || '' AS head, format('{:.2f}', s_suppkey / 4.0) AS north FROM supplier""".replace("' 2020.50000' || ''", "'2020.50000'"))
def k01_neu_lines(spark, d):
    """Lines of a displacement series in millimetres."""
    s = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), L(2020.5).alias("yearf"), (D("s_suppkey") / L(4000.0)).alias("north"), *[L(0.001).alias(c) for c in ("d_north", "east", "d_east", "up", "d_up")])
    words = F.split(F.trim("line"), r"\s+")
    return sinks.neu_lines(s, keep=["k"]).select("k", words[0].alias("head"), words[1].alias("north"))


@query("""SELECT s_suppkey AS k, format('{:.6f}', -20.5) || ' ' || format('{:.6f}', 64.0 + s_suppkey / 100.0) || ' ' || format('{:.2f}', s_suppkey * 1.0) || ' ' || format('{:.2f}', s_suppkey * 2.0) || ' 1.00 1.00 0.0 S' || s_suppkey AS line FROM supplier WHERE s_suppkey % 4 <> 0""")
def k11_gmt_lines(spark, d):
    """Vectors for maps; refused records have none."""
    return sinks.gmt_lines(_vectors(spark, d)).select(F.substring("station", 2, 4).cast("long").alias("k"), "line")


@query("""SELECT s_suppkey AS k, format('{:.6f}', -20.5) || ' ' || format('{:.6f}', 64.0 + s_suppkey / 100.0) || ' ' || format('{:.6f}', s_suppkey / 1000.0) || ' ' || format('{:.6f}', s_suppkey / 500.0) || ' 0.000000 0.001000 0.001000 0.001000' AS line FROM supplier WHERE s_suppkey % 4 <> 0""")
def k12_gbis_lines(spark, d):
    return sinks.gbis_lines(_vectors(spark, d)).select(F.substring("station", 2, 4).cast("long").alias("k"), "line")


def _vectors(spark, d) -> DataFrame:
    k = D("s_suppkey")
    return read(spark, d, "supplier").select(
        F.concat(L("S"), k.cast("string")).alias("station"), L(-20.5).alias("lon"), (64.0 + k / L(100.0)).alias("lat"), (k / L(1000.0)).alias("east"), (k / L(500.0)).alias("north"), L(0.0).alias("up"), *[L(0.001).alias(c) for c in ("d_east", "d_north", "d_up")], (k % 4 == 0).alias("refused")
    )


@query("""SELECT n_nationkey AS k, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"v":null}' AS line FROM nation""")
def k10_json_lines(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name", L(None).cast("double").alias("v"))
    return sinks.json_lines(n).select(F.get_json_object("line", "$.n_nationkey").cast("int").alias("k"), "line")


@query("""SELECT n_nationkey AS k, '"' || n_name || ',x",' || n_nationkey || ',' AS line FROM nation""")
def k09_csv_lines(spark, d):
    """Rows of CSV: quoted where they must be, nulls empty."""
    n = read(spark, d, "nation").select(F.concat("n_name", L(",x")).alias("n_name"), "n_nationkey", L(None).cast("double").alias("v"))
    return sinks.csv_lines(n, keep=["n_nationkey"]).select(D("n_nationkey").alias("k"), "line")


@query("""SELECT rec_id FROM series_epochs WHERE NOT coalesce(kept = FALSE, FALSE) AND NOT coalesce(sigma > 5, FALSE)""")
def k03_cleaned(spark, d):
    """Rows that no component flags."""
    s = read(spark, d, "series_epochs").select("rec_id", (~D("kept")).alias("n_outlier"), (D("sigma") > 5).alias("e_outlier"), L(None).cast("boolean").alias("u_outlier"))
    return sinks.cleaned(s).select("rec_id")


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) = 6 THEN 'new' ELSE 'old' END AS soln FROM orders""")
def k07_merged_positions(spark, d):
    """Solutions with those of some days replaced."""
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.month("o_orderdate").alias("m"))
    new = o.filter("m = 6").withColumn("soln", L("new"))
    return gnss.merged_positions(o.withColumn("soln", L("old")), new, new.select("date")).select("o_orderkey", "soln")


@query("""SELECT event_type, n, shown FROM (SELECT event_type, count(*) AS n, event_type || repeat(' ', 10 - length(event_type)) || lpad(CAST(count(*) AS VARCHAR), 8, ' ') AS shown FROM events GROUP BY 1)""")
def k15_screen_table(spark, d):
    """A table as aligned text."""
    rows = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.aligned(rows, {"event_type": -10, "n": 8}).select("event_type", "n", D("line").alias("shown"))


# Further tables and formats.


def _csv(spark, d, header: str, row: Column, table: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """A CSV with a comment, a header and one row a number, as lines."""
    head = spark.createDataFrame([("/t.csv", 1, "# a note"), ("/t.csv", 2, header)], "file string, line_no int, line string")
    return head.unionByName(read(spark, d, table).select(L("/t.csv").alias("file"), (D(key) + 3).cast("int").alias("line_no"), row.alias("line")))


def _header(ddl: str) -> str:
    return ",".join(c.split()[0] for c in ddl.split(","))


@query("SELECT DATE '2024-01-01' + CAST(s_suppkey AS INT) AS date, CASE WHEN s_suppkey % 3 = 0 THEN 'decided' ELSE '' END AS status, s_suppkey / 4.0::DOUBLE AS share, CAST(s_suppkey AS INT) AS n_bad FROM supplier".replace("DATE '2024-01-01' + CAST(s_suppkey AS INT) AS date", "CAST(DATE '2024-01-01' + CAST(s_suppkey AS INT) AS DATE) AS date"))
def s23_network_days(spark, d):
    k = D("s_suppkey")
    row = F.concat_ws(",", F.date_format(F.date_add(L("2024-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd"), F.when(k % 3 == 0, "decided").otherwise(""), S("%.2f", k / 4.0), k.cast("string"), L("9,1,2,3"))
    return tables.network_days(spark, _csv(spark, d, _header(tables.NETWORK_DAYS[0]), row)).select("date", "status", "share", "n_bad")


@query("SELECT CAST(DATE '2024-01-01' + CAST(s_suppkey AS INT) AS DATE) AS date, s_suppkey / 4.0::DOUBLE AS cm_north, CASE WHEN s_suppkey % 2 = 0 THEN 1.5::DOUBLE END AS cm_up, s_suppkey % 2 = 0 AS provisional FROM supplier")
def s24_common_mode(spark, d):
    k = D("s_suppkey")
    row = F.concat_ws(",", F.date_format(F.date_add(L("2024-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd"), S("%.2f", k / 4.0), L("0.5"), F.when(k % 2 == 0, "1.5").otherwise(""), L("20,20,20"), F.when(k % 2 == 0, "true").otherwise("false"))
    return tables.strict_csv(spark, _csv(spark, d, _header(tables.COMMON_MODE[0]), row), tables.COMMON_MODE).select("date", "cm_north", "cm_up", "provisional")


@query("SELECT 'S' || s_suppkey AS sta, 2010.5::DOUBLE AS window_start, CAST(s_suppkey AS INT) AS min_epochs, CASE WHEN s_suppkey % 2 = 0 THEN 'plate' END AS frame FROM supplier")
def s73_fit_windows(spark, d):
    k = D("s_suppkey")
    row = F.concat_ws(",", F.concat(L("S"), k.cast("string")), F.when(k % 2 == 0, "plate").otherwise(""), L("2010.5,2015.5,,0.5"), k.cast("string"), L("1.5,,a comment"))
    return tables.strict_csv(spark, _csv(spark, d, _header(tables.FIT_WINDOWS[1]), row), tables.FIT_WINDOWS, ["sta"]).select("sta", "window_start", "min_epochs", "frame")


@query("SELECT 'S' || s_suppkey AS sta, 2010 + s_suppkey / 4.0::DOUBLE AS epoch_yearf, 'ALL' AS component, 'a, b' AS comment FROM supplier")
def s77_steps(spark, d):
    k = D("s_suppkey")
    row = F.concat_ws(",", F.concat(L("S"), k.cast("string")), S("%.2f", 2010 + k / 4.0), L('ALL,eq,cat,"a, b"'))
    return tables.strict_csv(spark, _csv(spark, d, _header(tables.STEPS[0]), row), tables.STEPS, ["sta", "epoch_yearf"]).select("sta", "epoch_yearf", "component", "comment")


@query("SELECT * FROM (VALUES ('header', 'refused'), ('repeated', 'refused'), ('value', 'refused')) t(what, outcome)")
def s79_refusals(spark, d):
    """A header that is none, a key given twice and a value that is no number are refused."""
    k = D("s_suppkey")
    good = F.concat_ws(",", F.concat(L("S"), k.cast("string")), L("2010.5,2011.5,x"))
    cases = {
        "header": lambda: tables.strict_csv(spark, _csv(spark, d, "sta,odd", good), tables.PROTECT_WINDOWS),
        "repeated": lambda: tables.strict_csv(spark, _csv(spark, d, _header(tables.PROTECT_WINDOWS[0]), L("S,2010.5,2011.5,x")), tables.PROTECT_WINDOWS, ["sta"]),
        "value": lambda: tables.strict_csv(spark, _csv(spark, d, _header(tables.PROTECT_WINDOWS[0]), L("S,word,2011.5,x")), tables.PROTECT_WINDOWS).collect(),
    }
    out = []
    for what, run in cases.items():
        try:
            run()
            out.append((what, "read"))
        except Exception:  # noqa: BLE001 (Spark's own for the value)
            out.append((what, "refused"))
    return spark.createDataFrame(out, "what string, outcome string")


@query("SELECT * FROM (VALUES ('dike', DATE '2020-01-02', 'a', 'AAAA'), ('dike', DATE '2020-01-02', 'a', 'BBBB')) t(kind, onset, area, station)")
def s70_events_and_areas(spark, d):
    """Declared events and the stations of their areas, from their documents."""
    from seiche.plans.grammar import parse_date

    events = tables.events_table(spark, {"e": {"kind": "dike", "onset": parse_date("2020-01-02"), "regions": ["a", "none"]}})
    areas = tables.areas_table(spark, {"volcanic_areas": {"a": {"stations": ["aaaa", "BBBB"]}}, "other": {"x": ["c"]}})
    return events.select("kind", "onset", F.explode("regions").alias("area")).join(areas, "area").select("kind", "onset", "area", "station")


@query("SELECT CAST(ts AS DATE) AS date, median(value) AS value, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def s22_network_median(spark, d):
    """Medians across stations per day, and their number, written as CSV and read back."""
    e = read(spark, d, "events").groupBy(D("ts").cast("date").alias("date")).agg(F.median("value").alias("value"), F.count_distinct("user_id").alias("n"))
    lines_ = sinks.csv_lines(e)
    return lines_.select(F.from_csv("line", "date date, value double, n bigint").alias("r")).select("r.*")


@query("SELECT s_suppkey AS k, s_acctbal AS rate, CASE WHEN s_suppkey % 4 = 0 THEN 'cover' END AS refused FROM supplier")
def s89_velocity_records(spark, d):
    """Records as lines of JSON, refused ones too, read back."""
    r = read(spark, d, "supplier").select(D("s_suppkey").alias("k"), D("s_acctbal").alias("rate"), F.when(D("s_suppkey") % 4 == 0, "cover").alias("refused"))
    return sinks.json_lines(r).select(F.from_json("line", "k bigint, rate double, refused string").alias("r")).select("r.*")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def k14_workbook(spark, d):
    """A workbook, read back."""
    cells = sinks.read_workbook(sinks.workbook(read(spark, d, "nation").select("n_nationkey", "n_name"), {"made": "here"}))
    return spark.createDataFrame([(int(float(k)), name) for k, name in cells[1:]], "k int, name string")


@query("SELECT n_nationkey AS k, n_name AS name, '{' || chr(10) || ' \"made\": 1' || chr(10) || '}' || chr(10) AS sidecar FROM nation")
def k25_sidecar(spark, d):
    """A table with its provenance beside it, wherever the path is."""
    from seiche.session import shared_dir

    path = shared_dir(spark, "with-sidecar")
    sinks.write_with_sidecar(read(spark, d, "nation").select(D("n_nationkey").alias("k"), D("n_name").alias("name")), path, {"made": 1})
    beside = spark.read.text(path + ".json", wholetext=True).head()[0]
    return spark.read.parquet(path).withColumn("sidecar", L(beside))


@query("""SELECT 'S' || (s_suppkey % 10) AS station, 1 AS axis, i + 0.0::DOUBLE AS at, 0.001 * (i + s_suppkey % 10) AS value FROM (SELECT DISTINCT s_suppkey % 10 s_suppkey FROM supplier), range(0, 30) t(i)""")
def j16_joined_segments(spark, d):
    """Two segments of a station, the second ten metres off, with epochs in common."""
    from seiche.sources.gnss import snapped_segments

    s = read(spark, d, "supplier").select((D("s_suppkey") % 10).alias("k")).distinct()
    rows = s.select("k", F.explode(F.sequence(L(0), L(29))).alias("i"))
    value = L(0.001) * (D("i") + D("k"))
    part = lambda name, keep, off: rows.filter(keep).select(F.concat(L("S"), D("k").cast("string")).alias("station"), L(1).alias("axis"), L(name).alias("file"), D("i").cast("int").alias("line_no"), (2000 + D("i") / 100).alias("yearf"), (value + off).alias("value"), L(0.01).alias("sigma"))
    both = part("/a/1", D("i") < 18, 0.0).unionByName(part("/b/2", D("i") >= 12, 10.0))
    out = snapped_segments(both)
    return out.select("station", "axis", F.round((D("yearf") - 2000) * 100, 0).alias("at"), F.round("value", 6).alias("value"))


@query("SELECT s_suppkey AS k, 6378137.0::DOUBLE AS radius, 1.0::DOUBLE AS north_z, 1.0::DOUBLE AS east_y FROM supplier")
def f65_local_frame(spark, d):
    """The geodetic position of a point and the rotation there: on the equator at longitude 0 north is z and east is y."""
    from seiche.functions import geo

    lat, lon, h = geo.xyz_to_llh(L(6378137.0), L(0.0), L(0.0))
    n, _, _ = geo.xyz_to_neu(L(0.0), L(0.0), L(1.0), lat, lon)
    _, e, _ = geo.xyz_to_neu(L(0.0), L(1.0), L(0.0), lat, lon)
    return read(spark, d, "supplier").select(D("s_suppkey").alias("k"), F.round(h + 6378137.0, 4).alias("radius"), F.round(n, 9).alias("north_z"), F.round(e, 9).alias("east_y"))


@query("""WITH o AS (SELECT station, session_code, max(struct_pack(t := t, r := rec_id)) b FROM series_epochs WHERE sigma > 0 AND sigma <= 3 GROUP BY ALL) SELECT station, session_code, b.r AS rec_id FROM o""")
def s96_latest_good(spark, d):
    """Stations at their latest position whose sigma is within a limit."""
    s = read(spark, d, "series_epochs").filter("sigma > 0 and sigma <= 3")
    return s.groupBy("station", "session_code").agg(F.max(F.struct("t", "rec_id")).getField("rec_id").alias("rec_id"))


@query("SELECT row_id AS num, epoch_us(origin_time) // 1000000 AS second, coordinates[2] AS lat, CASE WHEN NOT isnan(depth_km) THEN depth_km END AS depth FROM sil_events WHERE origin_time IS NOT NULL")
def s40_legacy_columns(spark, d):
    """A catalogue under its older names."""
    from seiche.operators import schema

    e = read(spark, d, "sil_events").filter("origin_time is not null").select(D("row_id").alias("event_id"), D("origin_time").cast("timestamp").alias("time"), F.try_element_at("coordinates", L(2)).alias("latitude"), F.when(~F.isnan("depth_km"), D("depth_km")).alias("depth_km"))
    return schema.renamed(e, {"event_id": "num", "latitude": "lat", "depth_km": "depth"}).select("num", F.unix_seconds("time").alias("second"), "lat", "depth")
