"""Text products: .NEU and joined series, GMT vectors, JSON lines, CSV with a provenance header, tables by day.

Large outputs are written by Spark as parts. A product that must be one file is put together from
the parts in order on the driver, line by line, never held in memory.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seiche.functions.geo import number
from seiche.session import put_text


def one_file(rows: DataFrame, path: str, header: list[str] = [], order: list[Column | str] = []) -> None:  # noqa: B006
    """Write a column ``line`` to one file, in order, wherever the path is; a part at a time is on the driver."""
    if order:
        rows = rows.orderBy(*order)

    def parts() -> Iterator[str]:
        held = [h + "\n" for h in header]
        for row in rows.select("line").toLocalIterator(prefetchPartitions=True):
            held.append(row[0] + "\n")
            if len(held) >= 10_000:
                yield "".join(held)
                held = []
        yield "".join(held)

    put_text(rows.sparkSession, path, parts())


# Fixed values from here on: the widths and places of the columns of each product's format.


def neu_lines(series: DataFrame, scale: float = 1000.0, places: int = 2, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``line`` of time, north, its sigma, east, up: millimetres from metres; with it the columns to keep."""
    cols = [F.format_string(f"%10.{places}f", number(c) * scale) for c in ("north", "d_north", "east", "d_east", "up", "d_up")]
    return series.select(*keep, "yearf", F.concat_ws(" ", F.format_string("%10.5f", "yearf"), *cols).alias("line"))


def joined_lines(component: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``line`` of a component series: epoch, value and sigma, stars for missing ones."""
    shown = lambda c, form, width: F.when(number(c).isNotNull(), F.format_string(form, c)).otherwise("*" * width)
    value, sigma = shown("value", "%12.5f", 12), shown("sigma", "%8.5f", 8)
    return component.select(*keep, "yearf", F.concat_ws(" ", F.format_string("%10.5f", "yearf"), value, sigma).alias("line"))


def write_joined(component: DataFrame, path: str, header: tuple[str, str, str]) -> None:
    one_file(joined_lines(component), path, list(header), ["yearf"])


def gmt_lines(records: DataFrame) -> DataFrame:
    """Accepted displacements as lon, lat, east, north and sigmas in millimetres."""
    ok = records.filter(~F.coalesce("refused", F.lit(False)))
    mm = [F.format_string("%.2f", F.col(c) * 1000) for c in ("east", "north", "d_east", "d_north")]
    return ok.select("station", F.concat_ws(" ", F.format_string("%.6f", "lon"), F.format_string("%.6f", "lat"), *mm, F.lit("0.0"), F.col("station")).alias("line"))


def gbis_lines(records: DataFrame) -> DataFrame:
    """Accepted displacements as lon, lat, east, north, up and sigmas in metres."""
    ok = records.filter(~F.coalesce("refused", F.lit(False)))
    cols = [F.format_string("%.6f", c) for c in ("lon", "lat", "east", "north", "up", "d_east", "d_north", "d_up")]
    return ok.select("station", F.concat_ws(" ", *cols).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """``line`` of each row as JSON with its keys in order; equal rows give equal bytes."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def csv_lines(df: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``line`` of each row: quoted where a value holds a comma, a quote or a line break; nulls are empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(t.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts]
    return df.select(*keep, F.concat_ws(",", *quoted).alias("line"))


def write_csv(df: DataFrame, path: str, provenance: dict[str, object], order: list[str]) -> None:
    """One CSV after '#' lines of provenance."""
    head = [f"# {k}: {json.dumps(v, sort_keys=True, default=str)}" for k, v in provenance.items()]
    one_file(csv_lines(df, order), path, [*head, ",".join(df.columns)], order)


def aligned(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Adds ``line``, the columns as text of fixed widths (negative: to the left), nulls as -."""
    cells = []
    for c, width in widths.items():
        text = F.coalesce(F.col(c).cast("string"), F.lit("-"))
        longest = F.greatest(F.length(text), F.lit(abs(width)))
        cells.append(F.rpad(text, longest, " ") if width < 0 else F.lpad(text, longest, " "))
    return df.withColumn("line", F.concat(*cells))


def write_with_sidecar(df: DataFrame, path: str, provenance: dict[str, object], form: str = "parquet") -> None:
    """A table as Spark writes it, and its provenance as JSON beside it."""
    df.write.mode("overwrite").format(form).option("header", "true").save(path)
    put_text(df.sparkSession, path.rstrip("/") + ".json", [json.dumps(provenance, sort_keys=True, indent=1, default=str) + "\n"])


def position_lines(positions: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``line`` of each solution in position-file columns."""
    f = F.format_string
    xyz = [f("%15.5f", c) for c in ("x", "y", "z")]
    sig = [f("%8.5f", c) for c in ("sx", "sy", "sz")]
    cor = [f("%6.3f", c) for c in ("rxy", "rxz", "ryz")]
    llh = [f("%15.10f", "lat"), f("%15.10f", F.pmod(F.col("lon"), F.lit(360.0))), f("%10.5f", "height")]
    neu = [f("%10.5f", c) for c in ("dn", "de", "du")] + [f("%8.5f", c) for c in ("sn", "se", "su")] + [f("%6.3f", c) for c in ("rne", "rnu", "reu")]
    return positions.select(*keep, "date", F.concat(F.lit(" "), F.concat_ws(" ", "date", "time", f("%10.4f", "mjd"), *xyz, *sig, *cor, *llh, *neu, "soln")).alias("line"))


def cleaned(series: DataFrame, flags: tuple[str, ...] = ("n_outlier", "e_outlier", "u_outlier")) -> DataFrame:
    """Rows that no component flags."""
    bad = F.lit(False)
    for c in flags:
        bad = bad | F.coalesce(F.col(c), F.lit(False))
    return series.filter(~bad)


def write_xlsx(df: DataFrame, path: str, provenance: dict[str, object], most: int = 1_000_000) -> None:
    """``workbook`` as a file of the driver's machine."""
    Path(path).write_bytes(workbook(df, provenance, most))


def workbook(df: DataFrame, provenance: dict[str, object], most: int = 1_000_000) -> bytes:
    """A workbook with a data and a meta sheet; more rows than a sheet holds raise."""
    import zipfile
    from xml.sax.saxutils import escape

    def sheet(rows: list[list[object]]) -> str:
        cells = "".join("<row>" + "".join(f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>' for v in r) + "</row>" for r in rows)
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'

    data = [list(r) for r in df.limit(most + 1).toLocalIterator()]
    if len(data) > most:
        raise ValueError(f"more than {most} rows")
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in (1, 2)) + "</Types>",
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="r1"/><sheet name="meta" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2)) + "</Relationships>",
        "xl/worksheets/sheet1.xml": sheet([df.columns, *data]),
        "xl/worksheets/sheet2.xml": sheet([[k, json.dumps(v, sort_keys=True, default=str)] for k, v in provenance.items()]),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def read_workbook(content: bytes, sheet: int = 1) -> list[list[str]]:
    """The cells of a sheet as text."""
    import zipfile
    from xml.etree import ElementTree

    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(f"xl/worksheets/sheet{sheet}.xml"))
    return [["".join(c.itertext()) for c in row] for row in root[0]]


def upserted_row(text: str, row: str) -> str:
    """A CSV's text with the row of the same first field replaced, or the row at its end."""
    key = row.split(",", 1)[0]
    lines_ = text.splitlines()
    hit = [k for k, line in enumerate(lines_) if line.split(",", 1)[0] == key]
    for k in hit[:1]:
        lines_[k] = row
    return "\n".join(lines_ if hit else [*lines_, row]) + "\n"


def _write_lines(lines_of):
    return lambda df, path, provenance: one_file(lines_of(df), path, [f"# {k}: {json.dumps(v, sort_keys=True, default=str)}" for k, v in provenance.items()], ["station"])


#: What writes a set of records, by the suffix of the file; the maps leave refused records out.
WRITERS = {
    ".gbis.txt": _write_lines(gbis_lines), ".gmt": _write_lines(gmt_lines), ".jsonl": lambda df, path, provenance: one_file(json_lines(df), path, [], ["line"]),
    ".csv": lambda df, path, provenance: write_csv(df, path, provenance, ["station"]), ".xlsx": lambda df, path, provenance: write_xlsx(df, path, provenance),
}


def writer_of(path: str):
    """The writer of a path's suffix; an unknown one raises."""
    for suffix, writer in WRITERS.items():
        if path.endswith(suffix):
            return writer
    raise ValueError(f"{path}: no writer, but of {sorted(WRITERS)}")


def write_records(df: DataFrame, path: str, provenance: dict[str, object]) -> None:
    """A set of records as its suffix says."""
    writer_of(path)(df, path, provenance)
