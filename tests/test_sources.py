"""Readers and writers on small files made here."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from seiche import registered
from seiche.sinks import text as sinks
from seiche.sources import alerts, archive, gnss, tables, web
from seiche.sources.text import clock_seconds


def put(path, body, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open(path, "wt") if packed else path.open("w")).write(body)
    return str(path)


def fixed(layout, **values):
    line = [" "] * layout.width
    for name, a, b in layout.fields:
        v = str(values.get(name, "")).rjust(b - a)[: b - a]
        line[a:b] = v
    return "".join(line)[: layout.width]


def test_fixed_width_days(spark, tmp_path):
    lay = {x.name: x for x in archive.LAYOUTS["aut.mag"]}
    rows = [
        fixed(lay["aut89"], num=1, date=20240822, time="0316 5.7", latitude="63.9", longitude="-21.5", depth="5.1", ml="1.2", q="55.0", id="/2024/aug/22/a"),
        fixed(lay["aut57"], num=2, date=19951201, time="235960.0", latitude="64.0", longitude="-21.0", depth="***", ml="NaN", q=""),
        fixed(lay["aut61"], num=3, date=19930101, time="000000.0", latitude="6x.0", longitude="-21.0"), "x" * 70, " " * 89,
    ]
    put(tmp_path / "22/aut.mag", "\n".join(rows) + "\n")
    good, failed = archive.day_file(spark, str(tmp_path), "aut.mag")
    out = {int(r.num): r for r in good.collect()}
    assert out[1].t == dt.datetime(2024, 8, 22, 3, 16, 5, 700000) and out[1].q == 55.0 and out[1].line_no == 1
    assert out[2].t == dt.datetime(1995, 12, 2) and out[2].depth is None and out[2].ml is None and out[2].id is None
    assert {r.line_no: r.reason for r in failed.collect()} == {3: "no number: latitude", 4: "width 70"}
    ref = archive.LAYOUTS["events.ref"][1]
    put(tmp_path / "ref/events.ref", fixed(ref, date="930102", time="06:41: 8.2", latitude="64.0", longitude="-21.0", dir="d1") + "\n")
    r = archive.day_file(spark, str(tmp_path / "ref"), "events.ref")[0].head()
    assert r.t == dt.datetime(1993, 1, 2, 6, 41, 8, 200000) and r.dir == "d1"


FPS = "1 20260922 001643.149 63.90077 0.010 -16.47412 0.024 1.896 3.3 -0.98 /a 1.40e+10 -0.48 sm 0.175 0.189 73.0 1.47 11.1 87 0.895 5.743 sp3 60 77 133 57 63 44 14 16 51.31 0"


def test_archive_assembly(spark, tmp_path):
    put(tmp_path / "events.fps", "\n".join([FPS, FPS.replace(" sp3 ", " FILE ").replace("/a", "/b").replace("001643", "011643"), "1 2 3", ""]))
    fps, failed = archive.fault_planes(spark, str(tmp_path))
    rows = {r.id: r for r in fps.collect()}
    assert rows["/a"].has_solution and rows["/a"].strike_a == 60 and rows["/b"].strike_a is None and failed.count() == 1
    lay = archive.LAYOUTS["events.lib"][0]
    put(tmp_path / "events.lib", "\n".join(fixed(lay, num=k, date=20260922, time=t, latitude="64.0", longitude="-21.0", mlw=m, event_type="qu", id=i) for k, (t, m, i) in enumerate([("001643.149", "1.5", "/a"), ("011644.000", "2.5", "/b"), ("021644.000", "3.5", "/c")])))
    lib = archive.day_file(spark, str(tmp_path), "events.lib")[0]
    aut = archive.LAYOUTS["aut.mag"][0]
    put(tmp_path / "aut.mag", "\n".join(fixed(aut, num=k, date=20260922, time="001643.1", latitude="64.0", longitude="-21.0", ml=m, q=q, id=i) for k, (m, q, i) in enumerate([("1.1", "10", "/a"), ("1.9", "90", "/a"), ("0.5", "50", "/d")])))
    out = {r.event_id: r for r in archive.assembled_events(fps, lib, archive.day_file(spark, str(tmp_path), "aut.mag")[0]).collect()}
    assert set(out) == {"/a", "/b", "/c", "/d"} and out["/a"].mag_auto == 1.9 and out["/b"].magnitude == 2.5
    assert out["/d"].evaluation_mode == "automatic" and out["/d"].magnitude_type == "aut.mag" and out["/c"].moment_nm is None


def test_assembly_without_ids(spark, tmp_path):
    day = tmp_path / "1995/jun/15"
    fps = archive.fault_planes(spark, put(tmp_path / "none/events.fps", FPS.replace("20260922", "19900101") + "\n"))[0].filter("id = 'none'")
    lay = {x.name: x for x in archive.LAYOUTS["aut.mag"]}
    lib_lay, mag_lay = archive.LAYOUTS["events.lib"][0], archive.LAYOUTS["lib.mag"][0]
    quake = [("000010.000", "64.000", "1.0", "/p"), ("000014.000", "64.000", "", "/q"), ("010000.000", "64.000", "1.5", "/r"), ("020000.000", "64.000", "1.6", "/s"), ("235959.000", "64.000", "1.7", "/t")]
    put(day / "events.lib", "\n".join(fixed(lib_lay, num=k, date=19950615, time=t, latitude=y, longitude="-21.000", mlw=m, event_type="qu", id=i) for k, (t, y, m, i) in enumerate(quake)))
    # Two records of one time and place are told apart by their order, and a position that differs joins nothing.
    put(day / "lib.mag", "\n".join(fixed(mag_lay, num=k, date=19950615, time=t, latitude=y, longitude="-21.000", ml=m) for k, (t, y, m) in enumerate([("000014.000", "64.000", "2.2"), ("000014.000", "64.000", "9.9"), ("010000.000", "64.002", "8.8")])))
    rows = [("000011.0", "64.00", "0.1"), ("000018.9", "64.20", "0.2"), ("000015.0", "64.00", "0.3"), ("010005.0", "64.00", "0.4"), ("020005.1", "64.00", "0.5"), ("030000.0", "64.00", "0.6"), ("030000.0", "65.00", "0.7")]
    body = [fixed(lay["aut57"], num=k, date=19950615, time=t, latitude=y, longitude="-21.0", ml=m) for k, (t, y, m) in enumerate(rows)]
    body += [body[-1], fixed(lay["aut61"], num=20, date=19950615, time="040000.0", latitude="64.0", longitude="-21.0", ml="0.8"), fixed(lay["aut117"], num=21, date=19950615, time="050000.0", latitude="64.0", longitude="-21.0")]
    put(day / "aut.mag", "\n".join(body))
    put(tmp_path / "1995/jun/16/aut.mag", fixed(lay["aut89"], num=1, date=19950616, time="000001.0", latitude="64.0", longitude="-21.0", ml="0.9", id="/other"))
    read = lambda kind: archive.day_file(spark, str(tmp_path), kind)[0]
    lib, aut, mag = read("events.lib"), read("aut.mag"), read("lib.mag")
    out = archive.assembled_events(fps, lib, aut, mag=mag).collect()
    reviewed = {r.event_id: (r.magnitude, r.magnitude_type, r.mag_auto) for r in out if r.evaluation_mode == "manual"}
    # 0.1 lies nearest to /p, 0.3 to /q; 0.4 is 5.0 s and 0.9 with its id 2.0 s away, inclusive; 0.5 is too late.
    assert reviewed == {"/p": (1.0, "Mlw", 0.1), "/q": (2.2, "ML", 0.3), "/r": (1.5, "Mlw", 0.4), "/s": (1.6, "Mlw", None), "/t": (1.7, "Mlw", 0.9)}
    alone = sorted((r.event_id, r.mag_auto) for r in out if r.evaluation_mode == "automatic")
    name = "/1995/jun/15/aut.mag#"
    assert alone == sorted([(f"{name}1", 0.2), (f"{name}4", 0.5), (f"{name}5", 0.6), (f"{name}6", 0.7), (f"{name}20", 0.8), (f"{name}21", None)])
    off = archive.assembled_events(fps, lib, aut, within=(0, 0), within_no_id=(0, 0)).collect()
    assert len(off) == 5 + 10 and not any(r.mag_auto for r in off if r.evaluation_mode == "manual")


def test_assembly_second_file(spark, tmp_path):
    lib_lay, lay = archive.LAYOUTS["events.lib"][0], archive.LAYOUTS["aut.mag"][0]
    event = lambda lay, i, t, day=22, **v: fixed(lay, num=1, date=f"202609{day}", time=t, latitude="64.0", longitude="-21.0", id=i, **v)
    put(tmp_path / "22/events.lib", "\n".join([event(lib_lay, "/a", "001643.0", mlw="1.0"), event(lib_lay, "/b", "011643.0", mlw="1.1"), event(lib_lay, "/b", "051643.0", mlw="1.2")]))
    put(tmp_path / "22/cleanaut.mag", event(lay, "/b", "011643.0", ml="0.2"))
    put(tmp_path / "22/aut.mag", "\n".join([event(lay, "/a", "003000.0", ml="0.1"), event(lay, "/x", "031643.0", ml="0.4")]))
    put(tmp_path / "23/aut.mag", event(lay, "/y", "001643.0", day=23, ml="0.5"))
    fps = archive.fault_planes(spark, put(tmp_path / "none/events.fps", FPS + "\n"))[0].filter("id = 'none'")
    read = lambda kind: archive.day_file(spark, str(tmp_path), kind)[0]
    out = archive.assembled_events(fps, read("events.lib"), read("cleanaut.mag"), second=read("aut.mag")).collect()
    # An id serves one reviewed event; a folder without the first file is served by the second.
    assert sorted((r.event_id, r.mag_mlw or 0.0, r.mag_auto or 0.0) for r in out) == [("/a", 1.0, 0.1), ("/b", 1.1, 0.2), ("/b", 1.2, 0.0), ("/y", 0.0, 0.5)]


def test_partitioned_days(spark, tmp_path):
    e = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), d) for d in range(1, 6)], "time timestamp_ntz, k int")
    archive.written_by_day(e, str(tmp_path / "c"))
    archive.written_by_day(e.filter("k = 3").withColumn("k", F.lit(33)), str(tmp_path / "c"))
    got = archive.read_days(spark, str(tmp_path / "c"), "2024-01-02", "2024-01-05")
    assert sorted(r.k for r in got.collect()) == [2, 4, 33]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()


def test_source_blocks(spark, tmp_path):
    put(tmp_path / "x.sp3", "  file: /sk2/x.sp3\n seismic moment:  0.436E+11 Nm\n local magnitude: 0.6\n plane a    52.    62.   -12. degrees\n plane b   148.    79.   209.\n Strike slip faulting dominates \n Of  3 first motion polarity\n 30 amplitudes for P and S\n 15.15 % of all mechanisms are acceptable\n")
    r = archive.source_blocks(spark, str(tmp_path)).head()
    assert (r.moment_nm, r.strike_a, r.rake_b, r.n_amplitudes, r.acceptable_pct, r.faulting, r.relative_size) == (4.36e10, 52, 209, 30, 15.15, "Strike slip faulting dominates", None)


def test_series_files(spark, tmp_path):
    for axis, shift in ((1, 0.0), (2, 1.0), (3, 2.0)):
        put(tmp_path / f"mb_AAAA_TOT.dat{axis}", f"Globk\nAAAA_GPS to N Solution  1 +   7111338.349 m\n\n 2015.48356 {8 + shift} 0.002\n 2015.48356 {9 + shift} 0.001\n 2015.48630 {7 + shift} ********\n")
    rows = gnss.component_rows(spark, str(tmp_path))
    out = {round(r.yearf, 5): r for r in gnss.series(rows).collect()}
    assert out[2015.48356].north == 9 and out[2015.48356].up == 11 and out[2015.4863].d_east is None
    assert gnss.segments(spark, str(tmp_path)).head().reference_m == 7111338.349
    assert gnss.joined_schemes(gnss.series(rows), ["JNS", "TOT"]).count() == 2


def test_segments_of_longer_names(spark, tmp_path):
    for site in ("A999", "A1000", "A59999", "B_1A", "X9"):
        put(tmp_path / f"mb_{site}_1PS.dat1", f"Globk\n{site}_A1PS to N Solution  1 +   7.25 m\n\n 2015.5 8.0 0.002\n")
    got = {(r.station, r.scheme, r.axis, r.marker, r.reference_m, r.value) for r in gnss.segments(spark, str(tmp_path)).collect()}
    assert got == {(site, "1PS", 1, "A1PS", 7.25, 8.0) for site in ("A999", "A1000", "A59999", "B_1A", "X9")}
    spark.range(998, 1003).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "d/supplier.parquet"))
    rows = registered.QUERIES["s02_segment_headers"](spark, str(tmp_path / "d")).collect()
    assert {r.k: (r.marker, r.reference_m, r.value) for r in rows} == {k: ("A1PS", k + 0.25, 1.5) if k % 2 == 0 else (None, None, 1.5) for k in range(998, 1003)}


def test_segments_are_snapped(spark):
    rows = [("a", 2020.0 + k / 100, 1.0 + k / 1000, 0.01) for k in range(5)] + [("b", 2020.03 + k / 100, 21.03 + k / 1000, 0.001) for k in range(4)] + [("c", 2021.0, -9.0, None)]
    df = spark.createDataFrame([("S", 1, f, k, t, v, s) for k, (f, t, v, s) in enumerate(rows)], "station string, axis int, file string, line_no int, yearf double, value double, sigma double")
    out = {round(r.yearf, 2): r for r in gnss.snapped_segments(df).collect()}
    assert out[2020.04].value == pytest.approx(1.031) and out[2021.0].value == pytest.approx(1.0) and out[2020.0].moves == "a:0;b:20;c:-10" and out[2020.0].status == "joined"


def test_positions(spark, tmp_path):
    line = " 20260901 115900 61284.4993  2502918.04409  -819167.02669  5789715.19547  0.00212  0.00116  0.00422 -0.453  0.818 -0.460  65.6854292382  341.8775150573  134.23562  0.00052  0.00102  *****  0.001 0.001 0.001 0.1 0.1 0.1 final"
    path = put(tmp_path / "A.pos.gz", "PBO\n4-character ID: AKUR\nFirst Epoch   : 20260901 115900\n*YYYYMMDD HHMMSS\n" + line + "\n 20260902 1\n", packed=True)
    good, bad = gnss.positions(spark, path).orderBy("line_no").collect()
    assert good.station == "AKUR" and good.t == dt.datetime(2026, 9, 1, 11, 59) and good.du is None and good.lon == pytest.approx(-18.1224849427) and good.bad is None and bad.bad == 2
    assert gnss.position_headers(spark, path).head().header["First Epoch"] == "20260901 115900"


def test_sinex(spark, tmp_path):
    body = """%=SNX 2.01
+SOLUTION/ESTIMATE
     1 STAX   AKUR  A    1 24:060:43200 m    2  0.25e+07 0.2
     2 STAY   AKUR  A    1 24:060:43200 m    2 -0.82e+06 0.5
-SOLUTION/ESTIMATE
+SOLUTION/APRIORI
     1 STAX   AKUR  A    1 24:060:43200 m    2  0.24e+07 0.1
-SOLUTION/APRIORI
+SOLUTION/MATRIX_ESTIMATE L CORR
     1     1  0.2
     2     1  0.5 0.5
-SOLUTION/MATRIX_ESTIMATE L CORR
%ENDSNX
"""
    a, b = gnss.sinex(spark, put(tmp_path / "x.snx", body)).orderBy("idx").collect()
    assert a.estimate == 2.5e6 and a.apriori == 2.4e6 and b.apriori is None and a.t == dt.datetime(2024, 2, 29, 12)
    assert a.covariance == pytest.approx([0.04]) and b.covariance == pytest.approx([0.05, 0.25])


def test_apriori_and_renames(spark, tmp_path):
    one, two = put(tmp_path / "1.apr", " AKUR_GPS 1 2 3 0.1 0.2 0.3 2010.0\n* note\n AKUR_GPS 4 5 6 0 0 0 2011.0 ! x\n"), put(tmp_path / "2.apr", " akur_gps 7 8 9 0 0 0 2012.0\n EXTENDED AKUR_GPS LOG 1 2 3 4 5\n")
    assert [(r.site, r.x, r.epoch) for r in gnss.apriori(spark, [one, two]).collect()] == [("AKUR_GPS", 7.0, 2012.0)]
    r = gnss.renames(spark, put(tmp_path / "eq", " rename AKUR_GPS AKUR_2PS 2010 1 2 3 4 2011 1 1 0 0\n rename AKUR_2PS AKUR_3PS h1234 2012 1 1 0 0\n")).orderBy("line_no").collect()
    assert r[0].start == dt.datetime(2010, 1, 2, 3, 4) and r[0].end == dt.datetime(2011, 1, 1) and r[1].start == dt.datetime(2012, 1, 1) and r[1].end is None


def test_rtk(spark, tmp_path):
    row = lambda s, e, q=1, sd=0.007: f"2026/10/12 23:59:{s:02d}.000 {e} -2582.0 35.0 {q} 12 {sd} {sd} {sd} 0 0 0 1.0 9.9"
    put(tmp_path / "a", "\n".join(["% note", row(0, 1.0), row(1, 2.0), row(2, 9.0, q=5), row(3, 9.0, sd=0.5), "broken"]))
    put(tmp_path / "b", row(1, 4.0))
    out = gnss.rtk_medians(gnss.rtk_epochs(spark, str(tmp_path)), "1 minute").collect()
    assert len(out) == 1 and out[0].n == 2 and out[0].east == 2.5


def test_autcln(spark):
    body = ["RMS  1 AKUR 9.0", "RMS  2 SAFH1001.0 1", "RMS  2 AKUR 8.0", "AMS  2 AKUR 3.0 1.5", "ATELV AKUR 1.0 2.0 99.9 0.0 4.0", "AZMEAN AKUR -1.0 3.0 99.9", "ELMEAN Site 1 2", "RMS 2 ALL 1.0", "NUM 2 AKUR 50"]
    df = spark.createDataFrame([("f", k, b) for k, b in enumerate(body)], "file string, line_no int, line string")
    r = {x.site: x for x in gnss.autcln_statistics(df).collect()}
    assert set(r) == {"AKUR", "SAFH"} and r["SAFH"].rms == 1001.0
    a = r["AKUR"]
    assert (a.rms, a.num, a.ams, a.ams_ratio, a.atelv_a, a.atelv_b, a.atelv_low, a.az_absmean, a.el_absmean) == (8.0, 50, 3.0, 1.5, 1.0, 2.0, 4.0, 2.0, None)


def feature(i, **p):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-21.0 - i, 64.0]}, "properties": {"event_id": f"e{i}", **p}}


def test_geojson(spark, tmp_path):
    fs = [feature(1, time="2026-09-19T00:57:29.904Z", magnitude=2.5, depth="4.5", phases=7, odd=[1]), feature(1, time="2026-09-19T01:00:00Z", magnitude=9.0), feature(2, time=None, magnitude=99.0, type='a "q"'), {"geometry": None, "properties": {"event_id": "x"}}]
    path = put(tmp_path / "a.json", json.dumps({"type": "FeatureCollection", "features": fs}))
    out = {r.event_id: r for r in web.geojson_events(spark, path, "quakes-seiscomp").collect()}
    assert set(out) == {"e1", "e2"} and out["e1"].magnitude == 2.5 and out["e1"].depth_km == 4.5 and out["e1"].n_phases == 7 and out["e1"].extra == {"odd": "[1]"}
    assert out["e1"].time == dt.datetime(2026, 9, 19, 0, 57, 29, 904000) and out["e2"].time is None and out["e2"].magnitude is None and out["e2"].event_type == 'a "q"'


def test_fdsn_text(spark, tmp_path):
    head = "#EventID|Time|Latitude|Longitude|Depth/km|Author|Catalog|Contributor|ContributorID|MagType|Magnitude|MagAuthor|EventLocationName|EventType\n"
    rows, failed = web.fdsn_events(spark, put(tmp_path / "e", head + "e1|2026-09-19T00:57:29.904|64.1|-21.5||scautoloc|c|c|i|Mlw|1.5|a|here|earthquake\nbad|1\n"))
    r = rows.head()
    assert r.event_id == "e1" and r.depth_km is None and r.evaluation_mode == "automatic" and r.time == dt.datetime(2026, 9, 19, 0, 57, 29, 904000) and failed.count() == 1
    ch, _ = web.fdsn_channels(spark, put(tmp_path / "c", "VI|bre||HHZ|66.1|-17.9|10|0|0|-90|sensor|1|1|M/S|100|2014-01-01T00:00:00|\n"))
    assert ch.head().end_time is None and ch.head().start_time == dt.datetime(2014, 1, 1)


def test_quakeml(spark, tmp_path):
    body = """<q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2" xmlns="http://quakeml.org/xmlns/bed/1.2"><eventParameters>
<event publicID="smi:x/IMO1"><type>earthquake</type><preferredOriginID>o1</preferredOriginID>
<origin publicID="o1"><time><value>2026-09-19T00:57:29.904Z</value></time><latitude><value>64.1</value></latitude><longitude><value>-21.5</value></longitude><depth><value>5200</value></depth><evaluationMode>manual</evaluationMode></origin>
<origin publicID="o2"><time><value>2026-09-19T00:57:30Z</value></time></origin>
<magnitude publicID="m1"><mag><value>2.5</value></mag><type>Mlw</type><originID>o1</originID></magnitude></event>
</eventParameters></q:quakeml>"""
    t = web.quakeml(spark, put(tmp_path / "a.xml", body))
    assert t["events"].head().event_id == "IMO1" and t["origins"].count() == 2 and t["origins"].filter("origin_id = 'o1'").head().depth_km == 5.2
    assert t["magnitudes"].head().magnitude == 2.5 and t["mechanisms"].count() == 0


def transport(url, query):
    start, end = (dt.datetime.fromisoformat(query[k].replace("Z", "+00:00")) for k in ("starttime", "endtime"))
    events = [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=k) for k in range(48)]
    inside = [e for e in events if start <= e < end]
    return json.dumps({"count": len(inside)} if query["format"] == "count" else {"features": [{"properties": {"event_id": e.isoformat()}} for e in inside]})


def test_paged_source(spark):
    from seiche.sources.web import PagedSource, bisected

    assert bisected(lambda a, b: b - a, 0, 8, 2) == [(0, 2.0), (2.0, 4.0), (4.0, 6.0), (6.0, 8)]
    spark.dataSource.register(PagedSource)
    df = spark.read.format("seiche_paged").option("transport", "tests.test_sources:transport").option("url", "x").option("start", "2024-01-01").option("end", "2024-01-03").option("limit", "10").load()
    assert df.count() == 48 and df.select("event_id").distinct().count() == 48


def test_alerts(spark, tmp_path):
    put(tmp_path / "001.event", "007 33 44 55 Mon Feb 03 01:02:03 2025   12 2\n-20.5 63.5 40 1.25 abc 7.5 3 0 20.25 0 --.-- --.-- --.--\n-20.5 63.5 40 8.75 abc 7.5 3 0 20.25 0 --.-- --.-- --.--\n")
    head, stations = alerts.detections(spark, str(tmp_path))
    assert head.head().t == dt.datetime(2025, 2, 3, 1, 2, 3) and head.head().n_stations == 2 and [(r.station, r.pgv) for r in stations.collect()] == [("abc", 1.25)]
    page = put(tmp_path / "index.html", '<tr><td>[<a href="080.html">23:47:25</a>] \n</td><td> 12</td><td>   66</td></tr>\n<tr><td>[<a href="079.html">23:37:53</a>] \n</td><td>  6</td><td>   26</td></tr>')
    assert sorted((r.alert_id, r.n_b) for r in alerts.day_index(spark, page).collect()) == [("079", 26), ("080", 66)]
    put(tmp_path / "alert.mag", " 004 20250203 010203.5  63.500  -20.250 6.000  2.25 D 000  0.75\n")
    assert alerts.located(spark, str(tmp_path)).head().magnitude == 2.25
    put(tmp_path / "a.evb", " origin time 20 06 25   00h 09m 28.4s +/- 0.10s\n latitude  66.242  +/- 0.006 deg.\n longitude-18.552  +/- 0.009\n focal depth  6.9  +/-   1.8 km\n bre p 00 09 33.88  0.01  11.1  31.9 114.3  255.9\n")
    o, p = alerts.phases(spark, str(tmp_path))
    assert (o.head().latitude, o.head().longitude, o.head().d_depth, o.head().d_time) == (66.242, -18.552, 1.8, 0.1) and p.head().distance_km == 31.9


def test_tables(spark, tmp_path):
    good = put(tmp_path / "s.csv", "# note\nsta,epoch_yearf,component,kind,source,comment\nA,2020.5,N,eq,x,\nA,2020.5,U,eq,x,\nB,2021.0,ALL,eq,x,\n")
    steps = {r.sta: r for r in tables.steps_by_component(tables.strict_csv(spark, good, tables.STEPS)).collect()}
    assert (steps["A"].north, steps["A"].east, steps["A"].up, steps["B"].east) == (True, False, True, True)
    with pytest.raises(ValueError):
        tables.strict_csv(spark, good, tables.PROTECT_WINDOWS)
    with pytest.raises(ValueError):
        tables.strict_csv(spark, good, tables.STEPS, key=["sta"])
    settings = spark.createDataFrame([("A", "plate", None, 5), ("A", None, 2.0, 6), ("B", "", None, 7)], "sta string, frame string, gap double, least int")
    out = {r.sta: (r.gap, r.least) for r in tables.resolved_settings(spark.createDataFrame([("A",), ("B",), ("C",)], "sta string"), settings, "plate", {"gap": 1.0, "least": 9}).collect()}
    assert out == {"A": (2.0, 5), "B": (1.0, 7), "C": (1.0, 9)}
    doc = put(tmp_path / "p.json", json.dumps({"schema": 1, "stations": {"A": {"frame": "plate", "params": {"N": {"rate": [1.5, 0.1], "offset": [2.0]}}}}}))
    assert {(r.name, r.value, r.sigma) for r in tables.parameter_records(spark, doc).collect()} == {("rate", 1.5, 0.1), ("offset", 2.0, None)}
    assert {tuple(r) for r in tables.areas_table(spark, {"volcanic_areas": {"x": ["a", "b"]}, "other": {"y": ["c"]}}).collect()} == {("x", "A"), ("x", "B")}


def test_gas_and_water(spark, tmp_path):
    t = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    obs = spark.createDataFrame([(1, k, t[i], float(10 * k + i)) for k in (1, 2) for i in range(4)], "acquisition_id int, kind_id int, observation_time timestamp_ntz, value double")
    acq, sta = spark.createDataFrame([(1, 7)], "acquisition_id int, station_id int"), spark.createDataFrame([(7, "hek")], "station_id int, station_name string")
    kinds = spark.createDataFrame([(1, "co2"), (2, "h2s")], "kind_id int, kind_name string")
    out = tables.multigas(obs, acq, sta, kinds, "hek", "2024-01-01", "2024-01-01 02:00:00", ["co2", "h2s"]).orderBy("observation_time").collect()
    assert [(r.observation_time.hour, r.co2, r.h2s) for r in out] == [(1, pytest.approx(11e-4), 21.0), (2, pytest.approx(12e-4), 22.0)]
    path = put(tmp_path / "w.csv", "time,q\n2024-01-01 00:00:00,1.5\n2024-01-01 01:00:00,x\n2024-01-01 02:00:00,2.5\n2024-01-01 02:00:00,2.5\n2024-01-02 00:00:00,3\n")
    assert [r.q for r in tables.hydrology(spark, path, "time", ["q"], "2024-01-01", "2024-01-01 02:00:00").collect()] == [1.5, 2.5, 2.5]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(2015.5, 1.0, None), (2015.4, float("nan"), 0.5)], "yearf double, value double, sigma double")
    sinks.write_joined(s, str(tmp_path / "j"), ("a", "b", ""))
    assert (tmp_path / "j").read_text().splitlines() == ["a", "b", "", "2015.40000 ************  0.50000", "2015.50000      1.00000 ********"]
    df = spark.createDataFrame([(2, 'x,"y"', None), (1, "z", 0.5)], "k int, t string, v double")
    sinks.write_csv(df, str(tmp_path / "c.csv"), {"made": "here"}, ["k"])
    assert (tmp_path / "c.csv").read_text() == '# made: "here"\nk,t,v\n1,z,0.5\n2,"x,""y""",\n'
    assert [r.line for r in sinks.json_lines(df).collect()] == ['{"k":2,"t":"x,\\"y\\"","v":null}', '{"k":1,"t":"z","v":0.5}']
    sinks.write_with_sidecar(df, str(tmp_path / "p"), {"a": 1})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and json.loads((tmp_path / "p.json").read_text()) == {"a": 1}
    sinks.write_xlsx(df, str(tmp_path / "x.xlsx"), {"a": 1})
    import zipfile

    assert "x,&quot;y" in zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml").decode() or 'x,"y"' in zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml").decode()
    n = spark.createDataFrame([(2020.1, 0.001, 0.002, 0.003, 0.0, 0.0, 0.0)], "yearf double, north double, east double, up double, d_north double, d_east double, d_up double")
    assert sinks.neu_lines(n).head().line.split() == ["2020.10000", "1.00", "0.00", "2.00", "0.00", "3.00", "0.00"]


def test_clock(spark):
    cases = {"0316 5.701": 3 * 3600 + 16 * 60 + 5.701, "06:41: 8.2": 6 * 3600 + 41 * 60 + 8.2, "235960.0": 86400.0, "240000": None, "126000": None, "": None}
    got = {r.v: r.s for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", clock_seconds(F.col("v")).alias("s")).collect()}
    assert {k: None if v is None else round(v, 6) for k, v in got.items()} == {k: None if v is None else round(v, 6) for k, v in cases.items()}
