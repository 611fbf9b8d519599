"""Identifiers, codes, bit masks and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event type codes and the published types.
EVENT_TYPES = {"qu": "earthquake", "sm": "earthquake", "te": "earthquake", "un": "earthquake", "ql": "earthquake", "ex": "explosion", "xx": "not locatable", "ne": "not existing"}
# Reasons a component of an epoch is dropped, by bit.
REASONS = ("outlier", "declared", "icing", "snow", "network")


def event_type(code: Column, table: dict[str, str] = EVENT_TYPES) -> Column:
    """The published type: the code as it is, then in lower case; unknown is other, blank null."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    plain = F.trim(code)
    return F.when(plain != "", F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, F.lower(plain)), F.lit("other")))


def canonical_number(value: Column) -> Column:
    """An event number spelled with or without SIL, zeros and blanks; null for anything else."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(value)), r"^(?:SIL)?0*([0-9]+)$", 1), F.lit(""))


def path_key(value: Column) -> Column:
    """The day and time part of an event path, in lower case; null for anything else."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"(\d{4}/[a-z]{3}/\d{2}/\d{2}:\d{2}:\d{2}/\d{2}:\d{2}:\d{3})$", 1), F.lit(""))


def path_day(value: Column) -> Column:
    """The day of an event path /YYYY/mon/DD/..., by English month names."""
    month = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.regexp_extract(F.lower(value), r"/?(\d{4})/([a-z]{3})/(\d{2})/", 2))
    text = F.concat_ws("-", F.regexp_extract(value, r"/?(\d{4})/", 1), F.lpad(((month + 2) / 3).cast("int").cast("string"), 2, "0"), F.regexp_extract(F.lower(value), r"/[a-z]{3}/(\d{2})/", 1))
    return F.when((month > 0) & (month % 3 == 1), F.try_to_date(text, "yyyy-MM-dd"))


def baseline_ends(code: Column) -> tuple[Column, Column]:
    """The two four-character stations of AAAA-BBBB."""
    pattern = r"^\s*([A-Za-z0-9]{4})-([A-Za-z0-9]{4})\s*$"
    return F.nullif(F.upper(F.regexp_extract(code, pattern, 1)), F.lit("")), F.nullif(F.upper(F.regexp_extract(code, pattern, 2)), F.lit(""))


def reason_names(bits: Column, names: tuple[str, ...] = REASONS) -> Column:
    """The names of the set bits, comma-separated."""
    parts = [F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)]
    return F.concat_ws(",", *parts)


def wrap_correction(offset_m: Column, quantum_m: float = 10.0) -> Column:
    """The multiple of the quantum nearest to an offset, halves to even."""
    return F.rint(offset_m / quantum_m) * quantum_m


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# The coefficients of a published rational approximation of the normal quantile (numerator and denominator, middle and tail).
_MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def sigma_divisor(percent: Column) -> Column:
    """How many sigmas a two-sided confidence level spans; 1 where it is missing, null outside (0, 100).

    The quantile at 0.5 + p/200, by rational approximation (relative error below 1.2e-9).
    """
    q = percent / 200.0
    r = q * q
    middle = q * _polynomial(r, _MIDDLE[0]) / _polynomial(r, _MIDDLE[1])
    s = F.sqrt(-2 * F.log(0.5 - q))
    tail = -_polynomial(s, _TAIL[0]) / _polynomial(s, _TAIL[1])
    known = percent.isNotNull() & ~F.isnan(percent)
    return F.when(~known, F.lit(1.0)).when((percent > 0) & (percent < 100), F.when(q <= 0.5 - 0.02425, middle).otherwise(tail))
