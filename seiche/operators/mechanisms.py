"""Fault-plane solutions as one frame: from archive rows, blocks, list rows and details, marked and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seiche.functions import mechanism
from seiche.functions.geo import number
from seiche.operators.windows import first_per_key

TOLERANCE_DEG = 5.0
PLANE = ("strike", "dip", "rake")


def _plane(rows: DataFrame, p: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{c}{p}") for c in PLANE)


def with_planes(rows: DataFrame, one: Column, two: Column) -> DataFrame:
    """Adds strike1 … rake2 of two plane structs."""
    return rows.withColumns({f"{c}{k}": p[c] for k, p in ((1, one), (2, two)) for c in PLANE})


def marked(rows: DataFrame, tolerance_deg: float = TOLERANCE_DEG) -> DataFrame:
    """Adds planes_inconsistent: whether the second plane is not the auxiliary of the first; null without one."""
    return rows.withColumn("planes_inconsistent", mechanism.inconsistent(_plane(rows, "1"), _plane(rows, "2"), tolerance_deg))


def classes(rows: DataFrame, rule: str = "frohlich") -> DataFrame:
    """Adds faulting_class of the first plane."""
    a = mechanism.axes(*_plane(rows, "1"))
    return rows.withColumn("faulting_class", mechanism.faulting_class(a["p"][1], a["b"][1], a["t"][1], rule))


def from_archive(rows: DataFrame, blocks: DataFrame | None = None, tolerance_deg: float = TOLERANCE_DEG) -> DataFrame:
    """Solutions of archive rows (id, source_file, strike_a … rake_b, has_solution), normalised, with their block's quality and label.

    ``blocks`` (id, acceptable_pct, faulting, strike_a, dip_a, rake_a) are joined on the id where their
    plane a is that of the row within the tolerance.
    """
    rows = rows.filter("has_solution")
    rows = with_planes(rows, mechanism.normalised_plane(F.col("strike_a"), F.col("dip_a"), F.col("rake_a")), mechanism.normalised_plane(F.col("strike_b"), F.col("dip_b"), F.col("rake_b")))
    rows = rows.withColumn("method", F.concat(F.lit("sil_"), "source_file"))
    if blocks is not None:
        b = blocks.select(F.col("id"), F.col("acceptable_pct").alias("_q"), mechanism.faulting_label(F.col("faulting")).alias("_label"), *[F.col(f"{c}_a").alias(f"_{c}") for c in PLANE])
        rows = rows.join(b, "id", "left")
        near = mechanism.plane_angle(_plane(rows, "1"), tuple(F.col(f"_{c}") for c in PLANE)) <= tolerance_deg
        rows = rows.withColumns({"quality": F.when(near, F.col("_q")), "sil_faulting_class": F.when(near, F.col("_label"))}).drop("_q", "_label", *[f"_{c}" for c in PLANE])
    return marked(rows, tolerance_deg)


def from_blocks(events: DataFrame, blocks: DataFrame, tolerance_deg: float = TOLERANCE_DEG) -> DataFrame:
    """Events (id) with the planes of their block, where it has both."""
    planes = [f"{c}_{p}" for p in "ab" for c in PLANE]
    b = blocks.dropna(subset=planes).select("id", *planes)
    rows = events.join(b, "id")
    return marked(with_planes(rows, mechanism.normalised_plane(*[F.col(f"{c}_a") for c in PLANE]), mechanism.normalised_plane(*[F.col(f"{c}_b") for c in PLANE])), tolerance_deg)


def from_list(rows: DataFrame, *, event: str = "event", order: list[Column], reviewed: Column) -> tuple[DataFrame, DataFrame]:
    """(planes, counts) of list rows with strike, dip and slip: the first reviewed row of an event, whole planes only.

    The second plane is computed. The counts tell the rows without a plane, with a part of one or an
    impossible dip, and repeated ones.
    """
    picks = rows.filter(reviewed)
    one = first_per_key(picks, [event], order)
    s, d, r = number("strike"), number("dip"), number("slip")
    given = F.when(s.isNotNull(), 1).otherwise(0) + F.when(d.isNotNull(), 1).otherwise(0) + F.when(r.isNotNull(), 1).otherwise(0)
    state = F.when(given == 0, "no_plane").when((given < 3) | ~d.between(0, 90), "bad_plane").otherwise("planes")
    one = one.withColumn("_state", state)
    counts = one.groupBy(F.col("_state").alias("what")).agg(F.count("*").alias("n")).unionByName(picks.agg((F.count("*") - F.count_distinct(event)).alias("n")).select(F.lit("duplicate_rows").alias("what"), "n"))
    kept = one.filter("_state = 'planes'").drop("_state")
    kept = kept.withColumn("_p", mechanism.normalised_plane(s, d, r))
    kept = with_planes(kept, F.col("_p"), mechanism.auxiliary_plane(F.col("_p.strike"), F.col("_p.dip"), F.col("_p.rake"))).drop("_p")
    return kept.withColumn("planes_from", F.lit("list")), counts


def detail_planes(details: DataFrame, tolerance_deg: float = TOLERANCE_DEG) -> DataFrame:
    """Details (event, strike_a … rake_b) as planes 1 and 2, a second one only if whole, and consistent."""
    whole = lambda p: number(f"strike_{p}").isNotNull() & number(f"dip_{p}").between(0, 90) & number(f"rake_{p}").isNotNull()
    rows = details.filter(F.coalesce(whole("a"), F.lit(False)))
    one = mechanism.normalised_plane(*[F.col(f"{c}_a") for c in PLANE])
    two = F.when(F.coalesce(whole("b"), F.lit(False)), mechanism.normalised_plane(*[F.col(f"{c}_b") for c in PLANE]))
    rows = with_planes(rows, one, two)
    apart = mechanism.same_plane(_plane(rows, "1"), _plane(rows, "2"))
    return rows.withColumn("consistent", F.when(F.col("strike2").isNotNull(), apart <= tolerance_deg))


def overridden(planes: DataFrame, details: DataFrame, *, event: str = "event") -> DataFrame:
    """List planes with those of their detail in their place where there is one."""
    d = details.select(event, *[F.col(f"{c}{k}").alias(f"_{c}{k}") for k in (1, 2) for c in PLANE], F.lit(True).alias("_has"))
    rows = planes.join(d, event, "left")
    new = {f"{c}{k}": F.when(F.col("_has"), F.col(f"_{c}{k}")).otherwise(F.col(f"{c}{k}")) for k in (1, 2) for c in PLANE}
    rows = rows.withColumns(new | {"planes_from": F.when(F.col("_has"), "detail").otherwise(F.col("planes_from"))})
    return rows.drop("_has", *[f"_{c}{k}" for k in (1, 2) for c in PLANE])


def checked(rows: DataFrame) -> DataFrame:
    """Issues of a marked frame: inconsistent planes that are marked are warnings, unmarked ones errors: level, n."""
    apart = mechanism.inconsistent(_plane(rows, "1"), _plane(rows, "2"), TOLERANCE_DEG)
    level = F.when(apart & F.coalesce("planes_inconsistent", F.lit(False)), "warning").when(apart, "error")
    return rows.groupBy(level.alias("level")).agg(F.count("*").alias("n")).filter("level is not null")
