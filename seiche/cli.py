"""Command line: registered queries, station products, catalogues, archives and records of a network.

Every command reads tables (folders or files of Parquet) and gives one table, shown or written to
``--out``. ``result`` is the same for programs: arguments in, a DataFrame out.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.session import session

Command = Callable[[SparkSession, argparse.Namespace], DataFrame]
COMMANDS: dict[str, tuple[Command, str, tuple[tuple[tuple[str, ...], dict], ...]]] = {}


def command(name: str, *arguments: tuple[tuple[str, ...], dict], also: tuple[str, ...] = ()) -> Callable[[Command], Command]:
    """Register a command under a name (and others it also goes by) with its arguments."""

    def add(f: Command) -> Command:
        for n in (name, *also):
            COMMANDS[n] = (f, (f.__doc__ or "").strip().splitlines()[0], arguments)
        return f

    return add


def arg(*names: str, **how: object) -> tuple[tuple[str, ...], dict]:
    return names, how


KEYS = arg("--keys", default="station,session_code")
WINDOW = (arg("--since", type=float, required=True, help="fractional year"), arg("--until", type=float, required=True, help="fractional year, not included"))


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@command("run", arg("query"), arg("folder"))
def run_query(spark, a):
    """One registered query over a folder of tables."""
    from seiche.registered import QUERIES

    if a.query not in QUERIES:
        raise SystemExit(f"no query {a.query!r}")
    return QUERIES[a.query](spark, a.folder)


@command("counts", arg("table"), arg("--time", default="time"), arg("--by"))
def counts(spark, a):
    """Events per day, zero where there are none."""
    from seiche.operators.aggregates import daily_counts

    return daily_counts(_table(spark, a.table), a.time, a.by)


@command("select", arg("table"), arg("--region", help="W/E/S/N or LAT,LON,KM"), arg("--least", type=float, help="smallest magnitude"), also=("fetch",))
def select(spark, a):
    """Events of a region and bounds."""
    from seiche.operators.predicates import bounds
    from seiche.plans.grammar import parse_region

    df = _table(spark, a.table)
    df = df.filter(parse_region(a.region).condition()) if a.region else df
    return df.filter(bounds("magnitude", a.least)) if a.least is not None else df


@command("regions", arg("document", help="YAML of named regions"))
def regions(spark, a):
    """The named regions of a document."""
    from seiche.plans.documents import quake_regions
    from seiche.sources.tables import yaml_document

    kind = lambda s: "box" if s.box else "polygon" if s.polygon else "circle"
    rows = [(n, kind(s), json.dumps(s.ranges)) for n, (s, _) in quake_regions(yaml_document(a.document)).items()]
    return spark.createDataFrame(rows, "name string, kind string, ranges string")


@command("velocity", arg("table"), KEYS, *WINDOW, arg("--least", type=int, default=5), arg("--allow-steps", action="store_true"), arg("--steps"), arg("--default-k", type=float, default=1.0), also=("velocities",))
def velocity(spark, a):
    """Station velocities of a window, with the reason where there is none."""
    from seiche.models.records import velocities

    steps = _table(spark, a.steps) if a.steps else None
    return velocities(_table(spark, a.table), (a.since, a.until), keys=a.keys.split(","), least=a.least, allow_steps=a.allow_steps, steps=steps, default_k=a.default_k)


@command("displacement", arg("table"), KEYS, *WINDOW, arg("--method", choices=("ends", "points", "step", "rate"), default="ends"), arg("--ends-days", type=float, default=10.0), arg("--onset", type=float), arg("--end", type=float), also=("displacements", "displacemnts"))
def displacement(spark, a):
    """Displacements across a period."""
    from seiche.models.records import displacements

    return displacements(_table(spark, a.table), (a.since, a.until), keys=a.keys.split(","), method=a.method, ends_days=a.ends_days, onset=a.onset, end=a.end)


@command("coords", arg("table"), KEYS, arg("--epoch", type=float, required=True), arg("--window-days", type=float, default=10.0), arg("--method", choices=("observed", "model"), default="observed"))
def coords(spark, a):
    """Levels at an epoch."""
    from seiche.models.records import coordinates

    return coordinates(_table(spark, a.table), a.epoch, keys=a.keys.split(","), window_days=a.window_days, method=a.method)


@command("series", arg("table"), KEYS, arg("--since", type=float), arg("--until", type=float), arg("--dropped", action="store_true"), also=("savetimes",))
def series(spark, a):
    """Series with what was dropped and why, their spikes found anew."""
    from seiche.models.records import exported, view
    from seiche.operators.spikes import implausible

    rows = _table(spark, a.table)
    viewed = view(rows, keys=a.keys.split(","), outliers=implausible(rows))
    return exported(viewed, (a.since, a.until) if a.since is not None and a.until is not None else None, dropped=a.dropped)


@command("k-table", arg("table"), KEYS, arg("--days", default="30,61,91"))
def k_table(spark, a):
    """How rates of windows scatter, by their length."""
    from seiche.models import records

    return records.k_table(_table(spark, a.table), [int(d) for d in a.days.split(",")], keys=a.keys.split(","))


@command("transient", arg("table"), KEYS, arg("--onset", type=float, required=True), arg("--until", type=float, required=True), arg("--taus", default="0.05,0.1,0.2,0.5,1.0"), arg("--at", default=""))
def transient(spark, a):
    """Rates of series that relax after an onset, at a relaxation time they share."""
    from seiche.models.records import shared_decay, transients

    keys = [*a.keys.split(","), "component"]
    tau, rows = shared_decay(_table(spark, a.table), keys=keys, onset=a.onset, until=a.until, taus=[float(x) for x in a.taus.split(",")])
    return transients(rows, keys=keys, onset=a.onset, tau=tau, at=[float(x) for x in a.at.split(",") if x]).withColumn("tau", F.lit(tau))


@command("rates", arg("table"), arg("--keys", default="station,session_code,component"))
def rates(spark, a):
    """Weighted straight line of each series."""
    from seiche.operators.aggregates import line_rate

    return line_rate(_table(spark, a.table), a.keys.split(","), "t", "y", "sigma")


@command("detrend", arg("table"), arg("--keys", default="station,session_code,component"), arg("--term", action="append", default=[], help="KIND@EPOCH[,tau=YEARS]"), arg("--least", type=int, default=50), arg("--least-span", type=float, default=1.0))
def detrend(spark, a):
    """Trajectory parameters of each series behind the gates."""
    from seiche.models.network import estimates
    from seiche.plans.grammar import parse_term

    return estimates(_table(spark, a.table), keys=a.keys.split(","), least=a.least, least_span=a.least_span, extra=tuple(map(parse_term, a.term)))


@command("nearest", arg("points"), arg("stations"), arg("--k", type=int, default=3), arg("--point", default="point"), arg("--station", default="station"))
def nearest(spark, a):
    """The k nearest stations of each point."""
    from seiche.operators.joins import k_nearest

    return k_nearest(_table(spark, a.points), _table(spark, a.stations), a.k, point=a.point, station=a.station)


@command("convert", arg("table"), arg("--to", choices=("xyz", "llh"), default="llh"))
def convert(spark, a):
    """Cartesian positions to latitude, longitude and height, or back."""
    from seiche.functions.geo import llh_to_xyz, xyz_to_llh

    df = _table(spark, a.table)
    if a.to == "llh":
        return df.withColumns(dict(zip(("lat", "lon", "height"), xyz_to_llh(F.col("x"), F.col("y"), F.col("z")))))
    return df.withColumns(dict(zip("xyz", llh_to_xyz(F.col("lat"), F.col("lon"), F.col("height")))))


@command("join-segments", arg("folder", help="of mb_*.dat files"), arg("--most-m", type=float, default=1.0))
def join_segments(spark, a):
    """Segments of stations and axes as one series each, with what did not fit."""
    from seiche.sources.gnss import segments, snapped_segments

    return snapped_segments(segments(spark, a.folder), most_m=a.most_m)


@command("realign", arg("table", help="day, site, x, y, z, dx, dy, dz, sigma"), arg("--params", default="xtran,ytran,ztran,xrot,yrot,zrot"), arg("--n-sigma", type=float, default=3.0), arg("--least", type=int, default=4))
def realign(spark, a):
    """Daily solutions brought into the frame of their reference sites."""
    from seiche.models.network import stabilised

    return stabilised(_table(spark, a.table), parameters=a.params.split(","), n_sigma=a.n_sigma, least=a.least)


@command("network-days", arg("table", help="day, dominant: a station's vote a row"), arg("--day", default="day"), arg("--share", type=float, default=0.5), arg("--least", type=int, default=3))
def network_days(spark, a):
    """Days on which the network as a whole is off."""
    from seiche.operators.aggregates import votes_by_day

    return votes_by_day(_table(spark, a.table), a.day, "dominant", a.share, a.least)


@command("harvest", arg("folder", help="of autcln summaries"))
def harvest(spark, a):
    """Statistics of cleaning of every site."""
    from seiche.sources.gnss import autcln_statistics
    from seiche.sources.text import packed_lines

    return autcln_statistics(packed_lines(spark, a.folder))


@command("baseline-noise", arg("residuals", help="station, day, component, r, sigma"), arg("stations", help="station, lat, lon"), arg("--max-km", type=float, default=50.0))
def baseline_noise(spark, a):
    """How the noise that stations share falls off with distance."""
    from seiche.models.network import noise_law

    return noise_law(_table(spark, a.residuals), _table(spark, a.stations), max_km=a.max_km)[1]


@command("regional-seasonal", arg("targets", help="station, lat, lon"), arg("donors", help="station, lat, lon and the parameters"), arg("--params", required=True), arg("--length-km", type=float, default=30.0), arg("--radius-km", type=float, default=100.0))
def regional_seasonal(spark, a):
    """Seasons of stations without one of their own."""
    from seiche.models.network import regional_seasonals

    return regional_seasonals(_table(spark, a.targets), _table(spark, a.donors), parameters=tuple(a.params.split(",")), length_km=a.length_km, radius_km=a.radius_km)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seiche", description=__doc__)
    p.add_argument("--cores", default="*")
    p.add_argument("--out", help=".csv, .jsonl or a folder of Parquet; shown when left out")
    p.add_argument("--rows", type=int, default=20)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="the registered queries")
    for name, (_, text, arguments) in COMMANDS.items():
        one = sub.add_parser(name, help=text)
        for names, how in arguments:
            one.add_argument(*names, **how)
    return p


def result(spark: SparkSession, argv: list[str]) -> DataFrame:
    """What a command gives."""
    a = _parser().parse_args(argv)
    return COMMANDS[a.command][0](spark, a)


def _out(df: DataFrame, path: str | None, rows: int) -> None:
    if path is None:
        df.show(rows, truncate=False)
    elif path.endswith(".jsonl"):
        from seiche.sinks.text import json_lines, one_file

        one_file(json_lines(df), path)
    elif path.endswith(".csv"):
        from seiche.sinks.text import write_csv

        write_csv(df, path, {"columns": df.columns}, [df.columns[0]])
    else:
        df.write.mode("overwrite").parquet(path)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "list":
        from seiche.registered import QUERIES

        print(json.dumps(sorted(QUERIES), indent=1))
        return 0
    _out(COMMANDS[a.command][0](session("seiche", cores=a.cores), a), a.out, a.rows)
    return 0


if __name__ == "__main__":
    sys.exit(main())
