"""Best representative of each duplicate group, by rule and by token-level consensus.

``survivors`` orders the records of a group by trust, completeness and recency and takes fields
that the survivor lacks from the best record that has one. ``consensus`` aligns the distinct
values of a column token by token to the heaviest of them, lets their weights vote at each place
and emits the existing value nearest to the consensus.

Defined results: records without a key are no member of any group; exact repeats are records of
their own; all-null columns give null; ties end with the smallest record number; an empty table
gives an empty result. Groups are aggregated in the map tasks, never collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seiche.session import written

def event_number(value: Column) -> Column:
    """The number in an identifier spelled with or without SIL, zeros and blanks; null if there is none."""
    return F.regexp_extract(F.upper(F.regexp_replace(value, r"\s+", "")), r"^(?:SIL)?0*([0-9]+)$", 1).try_cast("long")


def not_missing(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """The number unless it is null, NaN or outside [low, high]."""
    kept = value.isNotNull() & ~F.isnan(value)
    if low is not None:
        kept = kept & value.between(low, high)
    return F.when(kept, value)


def survivors(records: DataFrame, *, key: Column, order: list[Column], number: Column, fill: dict[str, Column], at_least: int = 2) -> DataFrame:
    """One row a group of at least ``at_least`` records: key, survivor, and <name>_from for each fill.

    ``order`` sorts smallest first and must not contain nulls. <name>_from is the number of the
    first record in that order whose fill is not null.
    """
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], number.alias("number"))
    rows = records.select(key.alias("key"), rank.alias("rank"), *[c.alias(f"f_{name}") for name, c in fill.items()]).filter(F.col("key").isNotNull())
    aggs = [F.min(F.when(F.col(f"f_{name}").isNotNull(), F.col("rank"))).getField("number").alias(f"{name}_from") for name in fill]
    best = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rank").getField("number").alias("survivor"), *aggs)
    return best.filter(F.col("n") >= at_least).drop("n")


def tokens(value: str) -> list[str]:
    """Runs of letters, runs of digits, single other characters."""
    return re.findall(r"[^\W\d_]+|\d+|\s+|.", value, re.S)


def placed(backbone: list[str], value: list[str]) -> list[tuple[int, str]]:
    """The value's tokens at places of the backbone: 2k + 1 is its k-th token, 2k what stands before it.

    A global alignment by dynamic programming; a token of the backbone that the value has nothing for
    gets "", tokens that stand together between two of its tokens are one.
    """
    n, m = len(backbone), len(value)
    if backbone == value:
        return [(2 * k + 1, t) for k, t in enumerate(value)]
    equal = np.array(backbone, object)[:, None] == np.array(value, object)[None, :]
    score = np.zeros((n + 1, m + 1), np.int64)
    score[:, 0], score[0, :] = -2 * np.arange(n + 1), -2 * np.arange(m + 1)
    step = -2 * np.arange(m + 1)
    for i in range(1, n + 1):
        # Gaps along a row cost 2 each: a running maximum of the score less what its place costs.
        row = score[i - 1] - 2
        row[1:] = np.maximum(row[1:], score[i - 1, :-1] + np.where(equal[i - 1], 3, -1))
        score[i] = np.maximum.accumulate(row - step) + step
    out: list[tuple[int, str]] = []
    between: dict[int, str] = {}
    i, j = n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (3 if equal[i - 1, j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((2 * i + 1, value[j]))
        elif i and score[i, j] == score[i - 1, j] - 2:
            i -= 1
            out.append((2 * i + 1, ""))
        else:
            j -= 1
            between[2 * i] = value[j] + between.get(2 * i, "")
    return sorted([*out, *between.items()])


def consensus(records: DataFrame, *, key: Column, columns: dict[str, Column], weight: Column) -> DataFrame:
    """One row a group and column: key, column, value (an existing one), n_values, consensus.

    Weights are summed per distinct value. The heaviest value of a group is its backbone, to which
    every other is aligned by itself; a pair of texts is aligned once, in however many groups it is.
    The weights vote at each place of the backbone, and between its places against having nothing
    there. All sums are combined before they are shuffled: no group is gathered, only the places of
    its backbone.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("string").alias("value")) for n, c in columns.items()]))
    votes = records.select(key.alias("key"), weight.cast("double").alias("weight"), each.alias("e")).select("key", "e.*", "weight").filter("key is not null and value is not null")
    votes = written(votes.groupBy("key", "column", "value").agg(F.sum("weight").alias("weight")), "consensus-votes")
    first = F.min(F.struct((-F.col("weight")).alias("w"), F.col("value").alias("value"))).getField("value")
    groups = votes.groupBy("key", "column").agg(F.count("*").alias("n_values"), F.sum("weight").alias("held"), first.alias("backbone"))
    groups = written(groups, "consensus-groups")
    alone = groups.filter("n_values = 1").select("key", "column", F.col("backbone").alias("value"), "n_values", F.col("backbone").alias("consensus"))

    split = votes.join(groups.filter("n_values > 1"), ["key", "column"])
    pairs = split.select("backbone", "value").distinct()

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [placed(tokens(b), tokens(v)) for b, v in zip(pdf.backbone, pdf.value)]
            yield pd.DataFrame({"backbone": pdf.backbone, "value": pdf.value, "places": [[{"place": p, "token": t} for p, t in q] for q in parts]})

    places = written(pairs.mapInPandas(aligned, "backbone string, value string, places array<struct<place:int,token:string>>"), "consensus-places")
    split = split.join(places, ["backbone", "value"])
    cast = split.select("key", "column", "held", "weight", F.explode("places").alias("p")).groupBy("key", "column", "held", "p").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct("weight", F.col("p.token").alias("token")))
    won = cast.groupBy("key", "column", "held", F.col("p.place").alias("place")).agg(best.alias("best"), F.sum("weight").alias("said"))
    # Between two tokens of the backbone, having nothing is the vote of the values that say nothing there.
    won = won.withColumn("token", F.when((F.col("place") % 2 == 0) & (F.col("best.weight") <= F.col("held") - F.col("said")), F.lit("")).otherwise(F.col("best.token")))
    agreed = won.groupBy("key", "column").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("places"))
    agreed = agreed.select("key", "column", F.array_join(F.transform("places", lambda x: x["token"]), "").alias("consensus"))
    near = F.struct(F.levenshtein("value", "consensus").alias("d"), (-F.col("weight")).alias("w"), F.col("value").alias("value"))
    chosen = votes.join(agreed, ["key", "column"]).groupBy("key", "column").agg(F.min(near).getField("value").alias("value"), F.count("*").alias("n_values"), F.first("consensus").alias("consensus"))
    return chosen.unionByName(alone)
