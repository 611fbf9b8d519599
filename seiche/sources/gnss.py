"""GNSS series and solutions from text: component files, segments, positions, SINEX, a-priori tables, epochs of 1 Hz."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.functions.timeaxis import sinex_epoch
from seiche.operators.windows import smallest_sigma
from seiche.sources.text import Source, at, clock_seconds, lines, number, packed_lines, plain_lines, whole_texts, word, words


_STATION = r"\w{4}|[^\W_]+"


def component_rows(spark: SparkSession, paths: Source, skip: int = 3) -> DataFrame:
    """station, scheme, axis (1-3), line_no, yearf, value, sigma of mb_<STA>_<scheme>.dat{1,2,3}; stars are null.

    Names have four characters; longer or shorter ones end at the first underscore.
    """
    name = rf"mb_({_STATION})_(\w+)\.dat([123])$"
    rows = lines(spark, paths, pattern="mb_*.dat[123]").filter(F.col("line_no") > skip).filter(F.trim("line") != "")
    return rows.select(
        F.regexp_extract("file", name, 1).alias("station"), F.regexp_extract("file", name, 2).alias("scheme"), F.regexp_extract("file", name, 3).cast("int").alias("axis"), "file", "line_no",
        number(word(F.col("line"), 1)).alias("yearf"), number(word(F.col("line"), 2)).alias("value"), number(word(F.col("line"), 3)).alias("sigma"),
    )


def segments(spark: SparkSession, paths: Source) -> DataFrame:
    """Segment rows with the reference of their header: component_rows and reference_m, marker."""
    pattern = rf"^({_STATION})_(\w+)\s+to\s+([A-Z])\s+Solution\s+(\d+)\s*\+\s*(-?\d+(?:\.\d+)?)\s*m"
    head = lines(spark, paths, pattern="mb_*.dat[123]").filter(F.col("line").rlike(pattern)).select("file", F.regexp_extract("line", pattern, 2).alias("marker"), F.regexp_extract("line", pattern, 5).cast("double").alias("reference_m"))
    return component_rows(spark, paths).join(head, "file", "left")


def series(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """station, scheme, yearf, north, east, up, d_north, d_east, d_up; per epoch and axis the row of least sigma."""
    best = smallest_sigma(rows.filter("yearf is not null"), ["station", "scheme", "axis", "yearf"], "sigma", "line_no")
    one = lambda c, k: F.max(F.when(F.col("axis") == k, F.col(c) * scale))
    names = (("value", 1, "north"), ("value", 2, "east"), ("value", 3, "up"), ("sigma", 1, "d_north"), ("sigma", 2, "d_east"), ("sigma", 3, "d_up"))
    return best.groupBy("station", "scheme", "yearf").agg(*[one(c, k).alias(n) for c, k, n in names])


def joined_schemes(series_rows: DataFrame, schemes: list[str]) -> DataFrame:
    """All rows of several schemes, tagged and in order of time and of the list; nothing is merged."""
    place = F.array_position(F.array(*[F.lit(s) for s in schemes]), F.col("scheme"))
    return series_rows.filter(F.col("scheme").isin(schemes)).withColumn("_s", place).orderBy("station", "yearf", "_s").drop("_s")


def snapped_segments(rows: DataFrame, quantum_m: float = 10.0, most_m: float = 1.0) -> DataFrame:
    """Segments of a station and axis joined in order of their first epoch.

    Each is moved by the multiple of the quantum nearest to its offset from what is joined so far
    (the median over common epochs, else from the last value before it); a remainder above
    ``most_m`` is reported in ``status``. One group holds one component of one station, which is
    sequential by nature: a few thousand epochs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["yearf"])
        order = sorted(pdf.groupby("file"), key=lambda kv: (kv[1].yearf.min(), kv[0]))
        held: dict[float, tuple[float, float]] = {}
        out, status = [], "joined"
        for name, part in order:
            part = part.sort_values(["yearf", "line_no"])
            keys = part.yearf.round(5)
            common = [v - held[k][0] for k, v in zip(keys, part.value) if k in held and np.isfinite(v) and np.isfinite(held[k][0])]
            move = 0.0
            if held:
                if common:
                    offset = float(np.median(common))
                else:
                    before = [k for k in held if k < keys.iloc[0] and np.isfinite(held[k][0])]
                    first = part.value.dropna()
                    offset = float(first.iloc[0] - held[max(before)][0]) if before and len(first) else 0.0
                move = float(np.rint(offset / quantum_m) * quantum_m)
                if abs(offset - move) > most_m:
                    status = f"remainder {offset - move:.3f} m in {name}"
            for k, v, s in zip(keys, part.value - move, part.sigma):
                old = held.get(k)
                if old is None or (s if np.isfinite(s) else np.inf) < (old[1] if np.isfinite(old[1]) else np.inf):
                    held[k] = (v, s)
            out.append((name, move))
        frame = pd.DataFrame([(k, *held[k]) for k in sorted(held)], columns=["yearf", "value", "sigma"])
        frame.insert(0, "axis", pdf.axis.iloc[0] if len(pdf) else 0)
        frame.insert(0, "station", pdf.station.iloc[0] if len(pdf) else "")
        frame["moves"] = ";".join(f"{n.rsplit('/', 1)[-1]}:{m:g}" for n, m in out)
        frame["status"] = status
        return frame

    return rows.groupBy("station", "axis").applyInPandas(run, "station string, axis int, yearf double, value double, sigma double, moves string, status string")


# The columns of a position file.
POS_COLUMNS = ("date", "time", "mjd", "x", "y", "z", "sx", "sy", "sz", "rxy", "rxz", "ryz", "lat", "lon", "height", "dn", "de", "du", "sn", "se", "su", "rne", "rnu", "reu", "soln")


def positions(spark: SparkSession, paths: Source) -> DataFrame:
    """One row a solution of .pos files (plain or packed): station, t, the columns, and bad (their number where not 25)."""
    rows = packed_lines(spark, paths)
    name = r"^4-character ID:\s*(\w{4})"
    station = rows.filter(F.col("line").rlike(name)).select("file", F.regexp_extract("line", name, 1).alias("station"))
    starts = rows.filter(F.col("line").startswith("*YYYYMMDD")).groupBy("file").agg(F.min("line_no").alias("_start"))
    data = rows.join(starts, "file").filter((F.col("line_no") > F.col("_start")) & (F.trim("line") != "")).withColumn("w", words(F.col("line")))
    value = {c: F.try_element_at("w", F.lit(k + 1)) for k, c in enumerate(POS_COLUMNS)}
    out = data.join(station, "file", "left").select("station", "file", "line_no", *[(value[c] if c in ("date", "time", "soln") else number(value[c])).alias(c) for c in POS_COLUMNS], F.when(F.size("w") != 25, F.size("w")).alias("bad"))
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    return out.withColumns({"lon": lon, "t": at(F.try_to_date("date", "yyyyMMdd"), clock_seconds(F.col("time")))})


def position_headers(spark: SparkSession, paths: Source) -> DataFrame:
    """file and header, a map of "key: value" lines before the data."""
    rows = packed_lines(spark, paths)
    data = rows.filter(F.col("line").startswith("*YYYYMMDD")).groupBy("file").agg(F.min("line_no").alias("_start"))
    rows = rows.join(data, "file", "left").filter((F.col("_start").isNull() | (F.col("line_no") < F.col("_start"))) & F.col("line").rlike(r"^[A-Z0-9][^:*]*:"))
    entry = F.struct(F.trim(F.regexp_extract("line", r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("v"))
    return rows.groupBy("file").agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("header"))


def merged_positions(old: DataFrame, new: DataFrame, replace: DataFrame, day: str = "date") -> DataFrame:
    """The old rows but those of the days to replace, and the new ones."""
    keys = [c for c in ("station", day) if c in replace.columns]
    return old.join(replace.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def sinex(spark: SparkSession, paths: Source) -> DataFrame:
    """One row a parameter of each SINEX file: index, kind, site, epoch, estimate, sigma, apriori and its row of covariances.

    ``covariance`` holds the covariances with parameters 1 to the row's own (lower triangle); a
    correlation matrix is scaled by the sigmas. A file is parsed by one task.
    """
    rows = whole_texts(spark, paths)
    schema = "file string, idx int, kind string, site string, soln string, epoch string, unit string, estimate double, sigma double, apriori double, covariance array<double>"

    def parse(name: str, body: str) -> list[tuple]:
        block, estimates, prior, cells, shape = None, {}, {}, [], ("L", "COVA")
        for line in body.splitlines():
            if line.startswith("+"):
                block = line[1:].strip()
                if block.startswith("SOLUTION/MATRIX_ESTIMATE"):
                    shape = tuple(block.split()[1:3])
            elif line.startswith("-"):
                block = None
            elif block and not line.startswith("*"):
                w = line.split()
                if block in ("SOLUTION/ESTIMATE", "SOLUTION/APRIORI") and len(w) >= 9:
                    (estimates if block.endswith("ESTIMATE") else prior)[int(w[0])] = w
                elif block.startswith("SOLUTION/MATRIX_ESTIMATE"):
                    cells.append((int(w[0]), int(w[1]), [float(v) for v in w[2:]]))
        n = max(estimates, default=0)
        m = np.zeros((n + 1, n + 1))
        for i, j, values in cells:
            m[i, j : j + len(values)] = values
        if shape and shape[0] == "U":
            m = m.T
        sigma = np.zeros(n + 1)
        for i, w in estimates.items():
            sigma[i] = float(w[9]) if len(w) > 9 else np.sqrt(m[i, i])
        if len(shape) > 1 and shape[1] == "CORR":
            diagonal = np.diag(m).copy()
            m = m * np.outer(sigma, sigma)
            np.fill_diagonal(m, diagonal**2)
        out = []
        for i, w in sorted(estimates.items()):
            p = prior.get(i)
            out.append((name, i, w[1], w[2], w[4], w[5], w[6], float(w[8]), float(sigma[i]), float(p[8]) if p else None, m[i, 1 : i + 1].tolist()))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, body in zip(pdf.file, pdf.value):
                yield pd.DataFrame(parse(name, body), columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema).withColumn("t", sinex_epoch(F.col("epoch")))


def apriori(spark: SparkSession, paths: list[str | DataFrame]) -> DataFrame:
    """site, x, y, z, vx, vy, vz, epoch of .apr files; an entry of a later file or line overrides earlier ones."""
    rows = None
    for k, p in enumerate(paths):
        part = lines(spark, p).withColumn("file_no", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    data = rows.filter(F.col("line").rlike(r"^\s\S")).withColumn("w", words(F.regexp_replace("line", "[!#].*$", ""))).filter(F.size("w") >= 8)
    names = ("x", "y", "z", "vx", "vy", "vz", "epoch")
    data = data.filter(F.upper(F.col("w")[0]) != "EXTENDED").select(F.upper(F.col("w")[0]).alias("site"), *[number(F.col("w")[k + 1]).alias(c) for k, c in enumerate(names)], "file_no", "line_no")
    return data.groupBy("site").agg(F.max(F.struct("file_no", "line_no", *names)).alias("r")).select("site", *[f"r.{c}" for c in names])


def renames(spark: SparkSession, path: Source) -> DataFrame:
    """line_no, old, new, start, end of rename lines; valid on [start, end), null ends are open."""
    rows = lines(spark, path).filter(F.lower("line").rlike(r"^\s+rename\s")).withColumn("w", words(F.regexp_replace("line", "[!#].*$", "")))
    n = lambda k: F.try_element_at("w", F.lit(k)).try_cast("int")
    # An optional file code comes before the dates.
    shift = F.when(n(4).isNull() & F.try_element_at("w", F.lit(4)).isNotNull(), 1).otherwise(0)
    when = lambda first: F.when(F.try_element_at("w", shift + first + 4).isNotNull(), F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:00", *[F.try_element_at("w", shift + first + i).try_cast("int") for i in range(5)])))
    return rows.select("line_no", F.upper(F.col("w")[1]).alias("old"), F.upper(F.col("w")[2]).alias("new"), when(4).alias("start"), when(9).alias("end"))


def rtk_epochs(spark: SparkSession, paths: Source, pattern: str = "*") -> DataFrame:
    """file, t, east, north, up, q, ns and sigmas of 1 Hz day files; comments and lines that do not parse are left out."""
    names = ("east", "north", "up", "q", "ns", "sde", "sdn", "sdu", "sden", "sdnu", "sdue", "age", "ratio")
    rows = plain_lines(spark, paths).filter("line not like '\\%%'").withColumn("w", words(F.col("line"))).filter(F.size("w") >= 15)
    t = F.try_to_timestamp(F.concat_ws(" ", F.translate(F.col("w")[0], "/", "-"), F.col("w")[1]))
    out = rows.select("file", t.cast("timestamp_ntz").alias("t"), *[number(F.col("w")[k + 2]).alias(c) for k, c in enumerate(names)])
    return out.filter(F.col("t").isNotNull())


def rtk_medians(epochs: DataFrame, interval: str, *, drop_q: tuple[int, ...] = (5,), most: float = 0.1) -> DataFrame:
    """bucket, east, north, up, their sigmas and n; an epoch in two files counts once, from the later one."""
    from seiche.operators.aggregates import bucket_medians
    from seiche.operators.predicates import noise_screen

    last = epochs.groupBy("t").agg(F.max(F.struct("file", *[c for c in epochs.columns if c not in ("file", "t")])).alias("r")).select("t", "r.*")
    kept = last.filter(noise_screen(["sde", "sdn", "sdu"], most, "q", drop_q))
    return bucket_medians(kept, "t", interval, ["east", "north", "up", "sde", "sdn", "sdu"])


def autcln_statistics(rows: DataFrame) -> DataFrame:
    """Per (file, site) of autcln summaries: rms, num, ams, ams_ratio, elevation terms and mean residuals.

    ``rows`` are numbered lines. A later iteration replaces an earlier one; 99.9 marks an empty
    bin; a value run into the four-character site is cut off; the row ALL is no site.
    """
    glued = F.regexp_replace("line", r"^(\s*(?:RMS|NUM|AMS)\s+\d+\s+|\s*ATELV\s+)(\w{4})(-?[\d.]+)", "$1$2 $3")
    w = rows.withColumn("w", words(glued)).filter(F.size("w") >= 3).withColumn("tag", F.col("w")[0])
    by_iteration = F.col("tag").isin("RMS", "NUM", "AMS") & F.col("w")[1].rlike(r"^\d+$")
    site = F.when(by_iteration, F.col("w")[2]).when(F.col("tag").isin("ATELV", "AZMEAN", "ELMEAN") & (F.col("w")[1] != "Site"), F.col("w")[1])
    w = w.withColumn("site", site).filter("site is not null and site <> 'ALL'")
    n = lambda k: number(F.try_element_at("w", F.lit(k)))
    last = lambda tag, value: F.max_by(value, F.when(F.col("tag") == tag, F.col("line_no")))
    bins = lambda start: F.filter(F.transform(F.slice("w", F.lit(start), F.size("w")), lambda v: v.try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 99.0))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v)) / F.nullif(F.size(a), F.lit(0))
    positive = F.filter(bins(5), lambda v: v > 0)
    return w.groupBy("file", "site").agg(
        last("RMS", n(4)).alias("rms"), last("NUM", n(4)).alias("num"), last("AMS", n(4)).alias("ams"), last("AMS", n(5)).alias("ams_ratio"),
        last("ATELV", n(3)).alias("atelv_a"), last("ATELV", n(4)).alias("atelv_b"), last("ATELV", F.try_element_at(positive, F.lit(1))).alias("atelv_low"),
        last("AZMEAN", mean(bins(3))).alias("az_absmean"), last("ELMEAN", mean(bins(3))).alias("el_absmean"),
    )


# An estimate row of a solution's listing.
_ESTIMATE = r"^\s*\d+\.\s+(\S{8})\s+([XYZ]) coordinate\s+\(m\)\s+(\S+)\s+(\S+)\s+(\S+)"


def listed_positions(spark: SparkSession, paths: Source) -> DataFrame:
    """file, site, and x, y, z with adjust_ and sigma_ of each, of the sites that have all three; a later row replaces an earlier."""
    rows = packed_lines(spark, paths).filter(F.col("line").rlike(_ESTIMATE))
    part = lambda k: F.regexp_extract("line", _ESTIMATE, k)
    rows = rows.select("file", "line_no", part(1).alias("site"), F.lower(part(2)).alias("axis"), *[number(part(k)).alias(n) for k, n in ((3, "value"), (4, "adjust"), (5, "sigma"))])
    last = lambda c, a: F.max_by(c, F.when(F.col("axis") == a, F.col("line_no")))
    out = rows.groupBy("file", "site").agg(*[last("value", a).alias(a) for a in "xyz"], *[last(c, a).alias(f"{c}_{a}") for c in ("adjust", "sigma") for a in "xyz"])
    return out.filter("x is not null and y is not null and z is not null")


# Commands of a solution's set-up that have a meaning here, and the parameters it can estimate.
_SETUP, _FRAME_PARAMETERS = ("use_site", "pos_org", "stab_ite", "cnd_hgtv", "stab_min", "apr_file", "vel_org"), ("xrot", "yrot", "zrot", "xtran", "ytran", "ztran", "scale")


def listed_setup(text: str) -> dict[str, object]:
    """Reference codes, settings and commands not known here, from the echo of a solution's commands."""
    lines_ = text.splitlines()
    start = next((k for k, line in enumerate(lines_) if "Summary of GLORG command file" in line), None)
    if start is None:
        raise ValueError("no summary of commands")
    out: dict[str, object] = {"codes": [], "unsupported": []}
    for line in lines_[start + 2 :]:
        if line.startswith("----"):
            break
        command, *args = line.split("!")[0].split() or [""]
        command = command.lower()
        if not command or command.startswith("#"):
            continue
        if command not in _SETUP:
            out["unsupported"].append(command)
        elif command == "use_site":
            for a in args:
                if a.lower() == "clear":
                    out["codes"] = []
                elif a.startswith("-"):
                    out["codes"] = [c for c in out["codes"] if c != a[1:5].upper()]
                elif a.lower() != "all":
                    out["codes"].append(a[:4].upper())
        elif command == "pos_org":
            out["params"] = [a.lower() for a in args if a.lower() in _FRAME_PARAMETERS]
        else:
            names = {"stab_ite": ("iterations", "rel", "nsig"), "cnd_hgtv": ("height_var", None, "use_ratio"), "stab_min": ("min_rms", "min_dh", "min_dne")}.get(command, ())
            out |= {n: float(a) for n, a in zip(names, args) if n}
    for k in ("codes", "unsupported"):
        out[k] = list(dict.fromkeys(out[k]))
    return out


def stabilisation_sites(texts: list[str]) -> list[str]:
    """The name prefixes of stab_site and use_site lines in order; ``clear`` begins anew, removals and limits raise."""
    out: list[str] = []
    for text in texts:
        for line in text.splitlines():
            command, *args = line.split("!")[0].split("#")[0].split() or [""]
            if command.lower() not in ("stab_site", "use_site"):
                continue
            for a in args:
                if a.lower() == "clear":
                    out = []
                elif a.startswith("-") or a.upper() == "R":
                    raise ValueError(f"{command} {a}: not supported")
                else:
                    out += [p.upper() for p in a.split("/") if p]
    return list(dict.fromkeys(out))


def position_files(files: DataFrame, product: str, legacy: tuple[str, ...] = ()) -> DataFrame:
    """station, file: of each station the file of the product, else of its earlier names in order; plain before packed."""
    name = F.element_at(F.split("file", "/"), -1)
    pattern = r"^([^.]+)\.(.+?)\.pos(\.gz)?$"
    place = F.array_position(F.array(*[F.lit(i) for i in (product, *legacy)]), F.regexp_extract(name, pattern, 2))
    rows = files.select("file", F.upper(F.regexp_extract(name, pattern, 1)).alias("station"), place.alias("place"), name.endswith(".gz").alias("packed")).filter("place > 0")
    return rows.groupBy("station").agg(F.min(F.struct("place", "packed", "file")).getField("file").alias("file"))


def placed_stations(headers: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """station, lon, lat from the files' headers; a station without a readable place is kept only without a box (W, E, S, N)."""
    from seiche.functions.geo import in_box

    place = words(F.try_element_at("header", F.lit("NEU Reference position")))
    station = F.upper(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^([^.]+)", 1))
    lat, lon = number(F.try_element_at(place, F.lit(1))), number(F.try_element_at(place, F.lit(2)))
    rows = headers.select(station.alias("station"), F.when(lat.isNotNull(), F.pmod(lon + 180, F.lit(360.0)) - 180).alias("lon"), F.when(lon.isNotNull(), lat).alias("lat"))
    return rows.filter(in_box(F.col("lon"), F.col("lat"), *box)) if box else rows


def local_series(positions_: DataFrame, reference: str | tuple[float, float, float] = "mean", stations: DataFrame | None = None, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """Adds north, east, up (m) of x, y, z about a reference position of each station.

    ``reference``: mean, median or first of the series, wmean (by the sigmas of the axes), apriori (x,
    y, z of ``stations``, else wmean), a point, or tssum, which takes the file's own dn, de, du.
    """
    from seiche.functions.geo import xyz_to_llh, xyz_to_neu

    if reference == "tssum":
        return positions_.withColumns({"north": F.col("dn"), "east": F.col("de"), "up": F.col("du")})
    weighted = lambda c: F.sum(F.col(c) / F.pow(F.col(f"s{c}"), 2)) / F.sum(F.pow(F.col(f"s{c}"), -2))
    how = {"mean": F.avg, "median": F.median, "first": lambda c: F.min_by(c, "t"), "wmean": weighted, "apriori": weighted}
    if isinstance(reference, str):
        own = positions_.groupBy(*keys).agg(*[how[reference](c).alias(f"r{c}") for c in "xyz"])
        if reference == "apriori":
            given = stations.select(*keys, *[F.col(c).alias(f"a{c}") for c in "xyz"])
            own = own.join(given, list(keys), "left").select(*keys, *[F.coalesce(f"a{c}", f"r{c}").alias(f"r{c}") for c in "xyz"])
        rows = positions_.join(own, list(keys))
    else:
        rows = positions_.withColumns({f"r{c}": F.lit(float(v)) for c, v in zip("xyz", reference)})
    lat, lon, _ = xyz_to_llh(F.col("rx"), F.col("ry"), F.col("rz"))
    neu = xyz_to_neu(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.col("z") - F.col("rz"), lat, lon)
    return rows.withColumns(dict(zip(("north", "east", "up"), neu))).drop("rx", "ry", "rz")


def coordinate_list(spark: SparkSession, paths: Source) -> DataFrame:
    """station, x, y, z of lines ``X Y Z SITE``; the first line of a station counts."""
    rows = packed_lines(spark, paths).withColumn("w", words(F.col("line"))).filter((F.size("w") >= 4) & ~F.col("line").startswith("#"))
    rows = rows.select(F.upper(F.col("w")[3]).alias("station"), "line_no", *[number(F.col("w")[k]).alias(c) for k, c in enumerate("xyz")])
    return rows.groupBy("station").agg(F.min(F.struct("line_no", "x", "y", "z")).alias("r")).select("station", "r.x", "r.y", "r.z")


def names_at(sites: DataFrame, renames_: DataFrame, code: str = "code", when: str = "when") -> DataFrame:
    """Adds ``name``, CODE_GPS after every rename of the code's that holds at the time, one after the other.

    A code's renames are a few: they are one small array, gone through within the row.
    """
    four = F.upper(F.substring(code, 1, 4))
    few = renames_.groupBy(F.substring("old", 1, 4).alias("_code")).agg(F.array_sort(F.collect_list(F.struct("line_no", "old", "new", "start", "end"))).alias("_renames"))
    applies = lambda name, r: (r["old"] == name) & (r["start"].isNull() | (r["start"] <= F.col(when))) & (r["end"].isNull() | (F.col(when) < r["end"]))
    name = F.aggregate("_renames", F.concat(four, F.lit("_GPS")), lambda n, r: F.when(F.coalesce(applies(n, r), F.lit(False)), r["new"]).otherwise(n))
    return sites.withColumn("_code", four).join(few, "_code", "left").withColumn("name", F.coalesce(name, F.concat(four, F.lit("_GPS")))).drop("_code", "_renames")


def apriori_lookup(sites: DataFrame, apriori_: DataFrame, renames_: DataFrame, listed: list[str] | None = None, code: str = "code", when: str = "when", yearf: str = "yearf") -> DataFrame:
    """Each site (code, when, yearf) with its a-priori x, y, z then, or ``skipped``, why it has none."""
    rows = names_at(sites, renames_, code, when).join(apriori_.withColumnRenamed("site", "name"), "name", "left")
    member = F.lit(True)
    if listed is not None:
        member = F.lit(False)
        for p in listed:
            member = member | F.col("name").startswith(p)
    skipped = F.when(F.col("name").endswith("XCL"), "excluded").when(~member, F.concat(F.lit("not stab_site "), "name")).when(F.col("epoch").isNull(), F.concat(F.lit("no apr "), "name"))
    at = lambda c: F.when(skipped.isNull(), F.col(c) + F.col(f"v{c}") * (F.col(yearf) - F.col("epoch")))
    return rows.select(code, when, "name", *[at(c).alias(c) for c in "xyz"], skipped.alias("skipped"))


def matched_sites(solution: DataFrame, listed: DataFrame, most_m: float = 1.0) -> DataFrame:
    """site, idx: of each listed site the solution's first row of the same code whose a-priori position is nearest, within a metre.

    ``solution``: code, idx, ax, ay, az; ``listed``: site and x, y, z with adjust_x, ...: the a-priori position is the difference.
    """
    gap = F.greatest(*[F.abs(F.col(f"a{c}") - (F.col(c) - F.col(f"adjust_{c}"))) for c in "xyz"])
    pairs = listed.withColumn("code", F.substring("site", 1, 4)).join(solution, "code").withColumn("gap", gap)
    best = pairs.groupBy("site").agg(F.min(F.struct("gap", "idx")).alias("b"))
    return best.filter(F.col("b.gap") <= most_m).select("site", "b.idx")


def listed_baselines(folders: DataFrame) -> DataFrame:
    """rover, reference of folders named AAAA-BBBB; others are none."""
    from seiche.functions.text import baseline_ends

    a, b = baseline_ends(F.element_at(F.split("file", "/"), -1))
    return folders.select("file", a.alias("rover"), b.alias("reference")).filter("rover is not null")


def solution_days(files: DataFrame, start: str, end: str, pattern: str = r"_(\d{4})(\d{3})\d{4}_01D") -> DataFrame:
    """file, day of daily solutions between two dates (inclusive), by the year and day in their names."""
    year, doy = (F.regexp_extract("file", pattern, k).try_cast("int") for k in (1, 2))
    rows = files.select("file", F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1).alias("day"))
    return rows.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def lines_with_stations(rows: DataFrame, stations: list[str]) -> DataFrame:
    """Lines that match any of the stations, each a regular expression."""
    out = F.lit(False)
    for s in stations:
        out = out | F.col("line").rlike(s)
    return rows.filter(out)


def station_table(rows: DataFrame) -> DataFrame:
    """sta, latitude, longitude, height of fixed columns; rows with a missing field are dropped."""
    cut = lambda a, b: F.trim(F.substring("line", a + 1, b - a))
    out = rows.select(F.nullif(cut(0, 4), F.lit("")).alias("sta"), *[number(cut(a, b)).alias(n) for n, a, b in (("latitude", 4, 13), ("longitude", 13, 23), ("height", 23, 29))])
    return out.dropna()
