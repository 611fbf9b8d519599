"""Rows that fail to parse against Python's own reading of them."""

import csv

import pytest

from seiche.operators.badrows import FPS_FIELDS, failed_lines, loaded_lines, reconciled_counts

GOOD = "1 20260922 001643.149 63.90077 0.010 -16.47412 0.024 1.896 3.3 -0.98 /2026/sep/22/x 1.40e+10 -0.48 sm 0.175 0.189 73.0 1.47 11.1 87 0.895 5.743 sp3 -60 77 133 57 63 44 14 16 51.31 0".split()
SCHEMA = "line_id long, file_path string, line_no long, layout string, raw_line string, fields string, pos int"


def table(spark, rows):
    return spark.createDataFrame([(k, "f", k, lay, raw, "clash", 0) for k, (lay, raw) in enumerate(rows)], SCHEMA)


def changed(**kw):
    w = list(GOOD)
    for k, v in kw.items():
        w[FPS_FIELDS.index(k)] = v
    return w


CASES = [
    (GOOD, None), (changed(depth="***"), None), (changed(depth="nAn"), None), (changed(latitude="NaN"), "latitude"), (changed(latitude="90.1"), "latitude"), (changed(date="20260230"), "date"),
    (changed(time="235960"), "time"), (changed(time="235959"), None), (changed(time="240000.1"), "time"), (changed(rake_a="-999"), "rake_a"), (changed(rake_a="-999", source_file="FILE"), None),
    (changed(rake_b="181"), "rake_b"), (changed(dip_a="-9"), None), (changed(dip_a="-8"), "dip_a"), (changed(num_of_polarities="3.5"), "num_of_polarities"), (changed(num_of_amplitudes="-9"), None),
    (changed(is_significant="2"), "is_significant"), (changed(mlw="+.5"), None), (changed(mlw="5."), None), (changed(mlw="."), "mlw"), (changed(mlw="1e5"), None), (changed(mlw="1e"), "mlw"), (changed(event_type="q1"), "event_type"),
    (changed(source_file="sp4"), "source_file"), (changed(id="x/"), "id"), (changed(num="1a"), "num"), (changed(strike_a="-360"), None), (changed(strike_b="361"), "strike_b"),
]


def test_values_in_both_layouts(spark):
    rows = [("fps", "  ".join(w)) for w, _ in CASES] + [("csv", ",".join(f'"{v}"' if k % 3 else v for k, v in enumerate(w))) for w, _ in CASES]
    got = {r.line_id: (r.reason, r.field) for r in failed_lines(table(spark, rows)).collect()}
    want = {k + shift: ("value", field) for shift in (0, len(CASES)) for k, (_, field) in enumerate(CASES) if field}
    assert got == want
    assert loaded_lines(table(spark, rows)).count() == len(rows) - len(want)


QUOTING = ['a,b', '"a","b"', '"a""b",c', '""', '"",""', '"a', 'a"b,c', '"a"b,c', '"a" ,b', ' "a",b', '"a,b"', 'x,"y""",z', '"""",q', 'a,"b"c"d",e', '"a"",b', ',,', '"']


def strict(line):
    try:
        row = next(csv.reader([line], strict=True))
    except csv.Error:
        return None
    # The reader takes a quote within an unquoted field as text.
    outside, inside = "", False
    for c in line:
        if c == '"':
            inside = not inside
        outside += c if not inside and c != '"' else ""
    bare = [f for f in row if '"' in f]
    return row if not bare or all(('"' + f.replace('"', '""') + '"') in line for f in bare) else None


def test_quoting(spark):
    got = {r.line_id: r.reason for r in failed_lines(table(spark, [("csv", q) for q in QUOTING])).collect()}
    assert set(got) == set(range(len(QUOTING)))  # none has 33 fields
    assert {k for k, r in got.items() if r == "quoting"} == {k for k, q in enumerate(QUOTING) if strict(q) is None}


def test_no_records_and_totals(spark):
    rows = [("fps", None), ("fps", ""), ("csv", "   "), ("fps", "# x"), ("fps", " ".join(GOOD)), ("fps", " ".join(GOOD)), ("fps", "a b"), (None, "x" * 100_000)]
    df = table(spark, rows)
    assert {r.line_id: r.reason for r in failed_lines(df).collect()} == {6: "columns", 7: "columns"}
    report = spark.createDataFrame([("f", "lines:events.fps", 8), ("f", "rows:events.fps", 4), ("g", "rows:events.fps", 1)], "file_path string, counts_name string, counts_n long")
    out = {r.file_path: r for r in reconciled_counts(df, report).collect()}
    assert out["f"].agree and out["f"].n_valid == 2 and not out["g"].agree
    assert failed_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize("field", ["latitude", "rake_a"])
def test_field_order_is_first(spark, field):
    df = table(spark, [("fps", " ".join(changed(**{field: "bad", "is_significant": "7"})))])
    assert failed_lines(df).head().field == field
