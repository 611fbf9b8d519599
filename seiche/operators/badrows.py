"""Rows that fail to parse, set apart with the reason while the valid rows are loaded.

Structure first (quoting, number of fields), then values: every distinct value of a column is cast
once, the invalid ones form a dictionary with reasons, and the dictionary is joined back.

Defined results: null lines, blank lines and comment lines are no records; an empty table gives
empty results; repeated rows are judged one by one; fields of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seiche.session import written

NUMBER = r"^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Rule:
    """What a column accepts: ``sql`` is a condition on ``v`` (the text), true where valid."""

    sql: str
    why: str


@dataclass(frozen=True)
class Layout:
    """The fields of a record in order, a rule for each, and pairs of fields judged together."""

    names: tuple[str, ...]
    rules: dict[str, Rule] = field(hash=False)
    default: Rule = Rule("true", "value")
    missing_from: int = 0  # from this field on, stars or NaN mean missing
    required: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str, str, str], ...] = ()  # (field, other, SQL on v and other, why)


def _number(extra: str = "", why: str = "not a plain number") -> Rule:
    test = f"v rlike '{NUMBER}'"
    return Rule(f"({test}) and ({extra})" if extra else test, why)


_D = "try_cast(v as double)"

# The fields of events.fps in order.
FPS_FIELDS = (
    "num", "date", "time", "latitude", "dlat", "longitude", "dlon", "depth", "ddepth", "mlw", "id", "moment", "ev_mag_ath",
    "event_type", "sh_min", "sh_max", "azim_comp", "relative_size", "corner_freq", "fault_radius", "stress_drop", "peak_slip",
    "source_file", "strike_a", "dip_a", "rake_a", "strike_b", "dip_b", "rake_b", "num_of_polarities", "num_of_amplitudes",
    "unknown_pacc", "is_significant",
)

_COUNT = Rule("v rlike '^[+]?[0-9]+$' or v rlike '^-0+$' or v rlike '^-0*9$'", "no count")
_RAKE = _number(f"{_D} between -180 and 180 or {_D} = -999", "rake beyond 180 degrees")

FPS = Layout(
    names=FPS_FIELDS,
    rules={
        "num": Rule("v rlike '^[0-9]+$'", "num is not digits"),
        "date": Rule("v rlike '^[0-9]{8}$' and try_to_date(v, 'yyyyMMdd') is not null and substring(v, 1, 4) <> '0000'", "no such date"),
        "time": Rule(r"v rlike '^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9](\\.[0-9]*)?$'", "no time of day"),
        "latitude": _number(f"abs({_D}) <= 90", "latitude beyond 90 degrees"),
        "longitude": _number(f"abs({_D}) <= 180", "longitude beyond 180 degrees"),
        "id": Rule("v like '/%'", "id does not start with a slash"),
        "event_type": Rule("v rlike '^[A-Za-z]{2}$'", "event_type is not two letters"),
        "source_file": Rule("v in ('sp3', 'ap3', 'FILE')", "unknown source_file"),
        **{k: _number(f"abs({_D}) <= 360", "strike beyond 360 degrees") for k in ("strike_a", "strike_b")},
        **{k: _number(f"{_D} between 0 and 90 or {_D} = -9", "dip outside 0 to 90") for k in ("dip_a", "dip_b")},
        **{k: _RAKE for k in ("rake_a", "rake_b")},
        **{k: _COUNT for k in ("num_of_polarities", "num_of_amplitudes")},
        "is_significant": _number(f"{_D} in (0, 1, -9)", "flag is none of 0, 1, -9"),
    },
    default=_number(),
    missing_from=3,
    required=("latitude", "longitude", "id", "event_type", "source_file"),
    pairs=tuple((k, "source_file", f"not ({_D} = -999 and v rlike '{NUMBER}') or other = 'FILE'", "rake -999 without FILE") for k in ("rake_a", "rake_b")),
)


def split_quoted(line: Column) -> tuple[Column, Column]:
    """(quoting is sound, fields) of comma-separated text with double quotes, doubled inside.

    Splitting at the quotes leaves outside and inside parts in turn; the outside ones must begin
    and end at a comma or an end of the line. Linear in the length of the line.
    """
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1
    # An empty outside part within the line is a doubled quote, unless it stands at an end.
    sound = F.forall(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: (x["i"] % 2 == 1)
        | ((x["i"] == 0) & (x["i"] == last))
        | (
            ((x["i"] == 0) | x["p"].startswith(",") | ((x["p"] == "") & (x["i"] < last)) | ((x["i"] == last) & (x["p"] == "")))
            & ((x["i"] == last) | x["p"].endswith(",") | (x["p"] == ""))
        ),
    )
    text = F.transform(
        parts,
        lambda p, i: F.when(i % 2 == 1, F.translate(p, ",", "\x1f")).when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(p),
    )
    fields = F.transform(F.split(F.array_join(text, ""), ",", -1), lambda f: F.translate(f, "\x1f", ","))
    return (F.size(parts) % 2 == 1) & sound, fields


def parsed_lines(lines: DataFrame, *, line_id: str = "line_id", layout: str = "layout", raw: str = "raw_line", quoted: str = "csv") -> DataFrame:
    """Records of raw lines: line_id, sound (quoting), fields. Blank and comment lines are left out."""
    text = F.col(raw)
    rows = lines.filter(text.isNotNull() & (F.trim(F.regexp_replace(text, r"\s+", " ")) != "") & ~text.startswith("#"))
    is_csv = F.col(layout).eqNullSafe(quoted)
    sound, comma = split_quoted(text)
    blank = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", -1)
    return rows.select(F.col(line_id).alias("line_id"), (~is_csv | sound).alias("sound"), F.when(is_csv, comma).otherwise(blank).alias("fields"))


def invalid_values(cells: DataFrame, layout: Layout) -> DataFrame:
    """The dictionary of invalid values: (pos, value, other, why), each distinct value judged once."""
    distinct = cells.groupBy("pos", "value", "other").agg(F.count("*").alias("n"))
    missing = r"(v rlike '^[*]+$' or lower(v) = 'nan')"
    cases, partners = [], {p[0]: p for p in layout.pairs}
    for i, name in enumerate(layout.names):
        rule = layout.rules.get(name, layout.default)
        valid = f"coalesce({rule.sql}, false)"
        if i >= layout.missing_from and name not in layout.required:
            valid = f"({missing} or {valid})"
        if name in partners:
            _, _, also, why = partners[name]
            cases.append(f"when pos = {i} and {valid} and not coalesce({also}, false) then '{why}'")
        cases.append(f"when pos = {i} and not {valid} then '{rule.why}'")
    # The count keeps the test above the aggregate: pushed below it, every cell would be judged.
    judged = distinct.withColumnRenamed("value", "v").withColumn("why", F.expr("if(n > 0, case " + " ".join(cases) + " end, null)"))
    return judged.filter("why is not null").drop("n").withColumnRenamed("v", "value")


def judged_records(lines: DataFrame, layout: Layout = FPS, **columns: str) -> DataFrame:
    """All records, parsed once and written: line_id, reason (quoting, columns or null) and fields."""
    parsed = parsed_lines(lines, **columns)
    structure = F.when(~F.col("sound"), "quoting").when(F.size("fields") != len(layout.names), "columns")
    return written(parsed.select("line_id", structure.alias("reason"), F.when(structure.isNull(), F.col("fields")).alias("fields")), "records")


def failures(records: DataFrame, layout: Layout = FPS) -> DataFrame:
    """The records that are not valid: line_id, reason (quoting, columns, value), field, why.

    The first reason that applies; for ``value`` the first field at fault. Equal values meet in
    the map tasks before the shuffle. The dictionary holds invalid values only; Spark broadcasts
    it when its measured size allows and otherwise joins by hash, splitting hot values.
    """
    none = F.lit(None).cast("string")
    broken = records.filter("reason is not null").select("line_id", "reason", none.alias("field"), none.alias("why"))
    at = {name: i for i, name in enumerate(layout.names)}
    partner = F.lit("")
    for name, other, _, _ in layout.pairs:
        partner = F.when(F.col("pos") == at[name], F.col("fields")[at[other]]).otherwise(partner)
    cells = records.filter("reason is null").select("line_id", "fields", F.posexplode("fields").alias("pos", "value")).select("line_id", "pos", "value", partner.alias("other"))
    dictionary = written(invalid_values(cells, layout), "invalid-values")
    hits = cells.join(dictionary, ["pos", "value", "other"]).groupBy("line_id").agg(F.min(F.struct("pos", "why")).alias("m"))
    names = F.array(*[F.lit(n) for n in layout.names])
    wrong = hits.select("line_id", F.lit("value").alias("reason"), names[F.col("m.pos")].alias("field"), F.col("m.why").alias("why"))
    return broken.unionByName(wrong)


def failed_lines(lines: DataFrame, layout: Layout = FPS, **columns: str) -> DataFrame:
    """``failures`` of raw lines."""
    return failures(judged_records(lines, layout, **columns), layout)


def loaded_lines(lines: DataFrame, layout: Layout = FPS, **columns: str) -> DataFrame:
    """The valid records as typed rows: line_id and one column a field, missing values as null."""
    text = {"date", "time", "id", "event_type", "source_file"}
    records = judged_records(lines, layout, **columns)
    good = records.filter("reason is null").join(failures(records, layout).select("line_id"), "line_id", "left_anti")

    def typed(i: int, name: str) -> Column:
        value = F.col("fields")[i]
        if name in text:
            return value.alias(name)
        number = value.try_cast("double")
        return F.when(~F.isnan(number), number).alias(name)

    return good.select("line_id", *[typed(i, n) for i, n in enumerate(layout.names)])


def reconciled_counts(lines: DataFrame, report: DataFrame, layout: Layout = FPS, *, file_path: str = "file_path", line_id: str = "line_id", **columns: str) -> DataFrame:
    """Per file: lines, records, valid and failed records, the reported totals and whether they agree."""
    records = judged_records(lines, layout, line_id=line_id, **columns)
    state = records.select("line_id").join(failures(records, layout).select("line_id", "reason"), "line_id", "left").withColumn("is_record", F.lit(1))
    rows = lines.select(F.col(line_id).alias("line_id"), F.col(file_path).alias("file_path")).join(state, "line_id", "left")
    counted = rows.groupBy("file_path").agg(
        F.count("*").alias("n_lines"),
        F.count("is_record").alias("n_records"),
        F.count("reason").alias("n_failed"),
    )
    said = report.groupBy("file_path").agg(
        F.max(F.when(F.col("counts_name").startswith("lines:"), F.col("counts_n"))).alias("said_lines"),
        F.max(F.when(F.col("counts_name").startswith("rows:"), F.col("counts_n"))).alias("said_records"),
    )
    out = counted.join(said, "file_path", "full_outer")
    agree = F.col("n_lines").eqNullSafe(F.col("said_lines")) & F.col("n_records").eqNullSafe(F.col("said_records"))
    return out.select("file_path", "n_lines", "n_records", (F.col("n_records") - F.col("n_failed")).alias("n_valid"), "n_failed", "said_lines", "said_records", agree.alias("agree"))
