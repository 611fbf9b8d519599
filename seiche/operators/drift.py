"""Schemas that drift between the files of a feed.

The property objects of every file are profiled: presence, JSON types and a sketch of each column's
values. Removed and added keys of consecutive files whose sketches allow it are compared in the
events both files hold; those that agree are the edges of a bipartite graph, weighted by events,
sketches and names, whose matching gives the renames. The matched columns are unified under one name.

Defined results: a body that is no JSON object, or has no object at ``root``, contributes no keys
but its file still exists; a null value counts as the key being present; an empty table gives an
empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.session import written

#: A theta sketch of 2 to the SKETCH_BITS entries counts exactly below that many distinct values.
SKETCH_BITS = 12
SKETCHED = 1 << (SKETCH_BITS - 1)

#: JSON types by the first word of a variant's type.
_KIND = """case
  when t in ('BIGINT','DOUBLE','FLOAT') or t like 'DECIMAL%' then 'number'
  when t = 'STRING' then 'string' when t = 'BOOLEAN' then 'boolean'
  when t like 'ARRAY%' then 'array' when t like 'OBJECT%' then 'object' end"""


def property_cells(features: DataFrame, *, feed: str = "feed", file_no: str = "file_no", body: str = "body", root: str = "$.properties", event_key: str = "event_id") -> DataFrame:
    """One row per (feed, file_no, event, key, value) with ``kind``, the JSON type (null for null).

    ``value`` is the canonical JSON text, so 5 and "5" differ and key order does not matter.
    """
    props = F.expr(f"try_cast(try_variant_get(try_parse_json(`{body}`), '{root}', 'variant') as map<string,variant>)")
    rows = features.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), props.alias("props"))
    rows = rows.select("feed", "file_no", F.to_json(F.col("props").getItem(event_key)).alias("event"), F.explode_outer("props").alias("key", "v"))
    rows = rows.withColumn("t", F.expr("schema_of_variant(v)"))
    return rows.select("feed", "file_no", "event", "key", F.expr(_KIND).alias("kind"), F.when(F.col("t") != "VOID", F.to_json("v")).alias("value"))


#: JSON types in the order that decides between equally common ones.
KINDS = ("string", "object", "number", "boolean", "array")


def profile(cells: DataFrame) -> DataFrame:
    """Per (feed, file_no, key): rows, nulls, the commonest type and a sketch of the distinct values.

    Aggregated before the shuffle, so a feed that holds a third of all rows costs one row per
    key, file and map task. A sketch has a bounded size and counts exactly below ``SKETCHED``.
    """
    each = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    out = cells.groupBy("feed", "file_no", "key").agg(F.count("*").alias("n_rows"), *each, F.expr(f"theta_sketch_agg(value, {SKETCH_BITS})").alias("sketch"))
    most = F.array_max(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS]))
    known = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    return out.select("feed", "file_no", "key", "n_rows", (F.col("n_rows") - known).alias("n_null"), F.when(most["n"] > 0, most["kind"]).alias("kind"), "sketch")


def key_changes(profiles: DataFrame) -> DataFrame:
    """Added, removed and retyped keys between consecutive files, before renames are matched."""
    files = profiles.select("feed", "file_no").distinct()
    order = W.partitionBy("feed").orderBy("file_no")
    files = files.select("feed", "file_no", F.lag("file_no").over(order).alias("before"), F.lead("file_no").over(order).alias("after"))
    keyed = W.partitionBy("feed", "key").orderBy("file_no")
    seen = (
        profiles.join(files, ["feed", "file_no"])
        .filter(F.col("key").isNotNull())
        .withColumn("key_before", F.lag("file_no").over(keyed))
        .withColumn("key_after", F.lead("file_no").over(keyed))
        .withColumn("kind_before", F.last("kind", ignorenulls=True).over(keyed.rowsBetween(W.unboundedPreceding, -1)))
    )
    both = F.col("key_before").eqNullSafe(F.col("before"))

    def change(at: Column, kind: str, when: Column) -> Column:
        return F.when(when, F.struct(at.alias("file_no"), F.lit(kind).alias("change_kind")))

    changes = F.array_compact(
        F.array(
            change(F.col("file_no"), "added", F.col("before").isNotNull() & ~both),
            change(F.col("after"), "removed", F.col("after").isNotNull() & ~F.col("key_after").eqNullSafe(F.col("after"))),
            change(F.col("file_no"), "type_changed", F.col("before").isNotNull() & both & (F.col("kind") != F.col("kind_before"))),
        )
    )
    return seen.select("feed", "key", F.explode(changes).alias("c")).select("feed", "c.file_no", "key", "c.change_kind")


def rename_candidates(profiles: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of a removed and an added key of one file that their columns' profiles allow.

    Columns feed, file_no, before, old, new, jaccard (of the value sketches over the whole files) and
    name_gap. A pair is dropped where the sketches show that no value is on both sides, which they
    can tell for certain as long as both count exactly.
    """
    own = profiles.select("feed", F.col("file_no").alias("at"), "key", "sketch")
    removed = changes.filter("change_kind = 'removed'").select("feed", "file_no", F.col("key").alias("old"))
    added = changes.filter("change_kind = 'added'").select("feed", "file_no", F.col("key").alias("new"))
    removed = removed.join(files.filter("before is not null"), ["feed", "file_no"]).join(own.select("feed", F.col("at").alias("before"), F.col("key").alias("old"), F.col("sketch").alias("old_sketch")), ["feed", "before", "old"])
    added = added.join(own.select("feed", F.col("at").alias("file_no"), F.col("key").alias("new"), F.col("sketch").alias("new_sketch")), ["feed", "file_no", "new"])
    pairs = removed.join(added, ["feed", "file_no"])
    size = lambda sketch: F.expr(f"theta_sketch_estimate({sketch})")
    common = size("theta_intersection(old_sketch, new_sketch)")
    pairs = pairs.withColumns({"common": common, "all": size(f"theta_union(old_sketch, new_sketch, {SKETCH_BITS})"), "exact": (size("old_sketch") < SKETCHED) & (size("new_sketch") < SKETCHED)})
    gap = F.levenshtein(F.lower("old"), F.lower("new")) / F.greatest(F.length("old"), F.length("new"), F.lit(1))
    pairs = pairs.filter(~F.col("exact") | (F.col("common") > 0))
    return pairs.select("feed", "file_no", "before", "old", "new", (F.col("common") / F.greatest(F.col("all"), F.lit(1.0))).alias("jaccard"), gap.alias("name_gap"))


def rename_edges(cells: DataFrame, candidates: DataFrame, min_events: int = 2) -> DataFrame:
    """The candidates that agree in every event both files hold: the edges of the matching.

    Only cells of candidate keys take part, joined on (feed, file, event): no pairs within a group
    beyond the candidates of one event.
    """

    def side(key: str, at: str) -> DataFrame:
        wanted = candidates.select("feed", F.col(at).alias("at"), F.col(key).alias("key"), F.col("file_no").alias("to")).distinct()
        own = cells.withColumnRenamed("file_no", "at").join(wanted, ["feed", "at", "key"])
        return own.groupBy("feed", F.col("to").alias("file_no"), "event", F.col("key").alias(key)).agg(F.sort_array(F.collect_set("value")).alias(f"{key}_values"))

    old, new = side("old", "before"), side("new", "file_no")
    # Every event that both files hold counts, also where the new key is missing there.
    held = cells.filter(F.col("event").isNotNull()).join(candidates.select("feed", "file_no").distinct(), ["feed", "file_no"], "left_semi").select("feed", "file_no", "event").distinct()
    old = old.filter((F.size("old_values") > 0) & F.col("event").isNotNull()).join(held, ["feed", "file_no", "event"], "left_semi")
    edges = old.join(candidates, ["feed", "file_no", "old"]).join(new, ["feed", "file_no", "event", "new"], "left")
    out = edges.groupBy("feed", "file_no", "old", "new").agg(F.count("*").alias("n_events"), F.count_if(F.col("old_values") == F.col("new_values")).alias("n_agree"), F.first("jaccard").alias("jaccard"), F.first("name_gap").alias("name_gap"))
    return out.filter((F.col("n_agree") == F.col("n_events")) & (F.col("n_events") >= min_events)).drop("n_agree")


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching (Hungarian method); only cells above zero are matched."""
    n_rows, n_cols = weight.shape
    n = max(n_rows, n_cols)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : n_rows + 1, 1 : n_cols + 1] = -weight
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            gap = cost[i0, 1:] - u[i0] - v[1:]
            better = ~used[1:] & (gap < slack[1:])
            slack[1:][better] = gap[better]
            way[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, slack[1:])))
            delta = slack[j1]
            u[match[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, n_cols + 1) if match[j] <= n_rows and weight[match[j] - 1, j - 1] > 0]


def matched_renames(edges: DataFrame) -> DataFrame:
    """One-to-one renames of each file: the matching of largest total weight over its edges.

    A group holds the edges between the removed and added keys of one file, as many as the
    schema allows, never rows of data.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for no, edges in pdf.groupby("file_no"):
            olds, news = sorted(set(edges.old)), sorted(set(edges.new))
            weight = np.zeros((len(olds), len(news)))
            row, col = {k: i for i, k in enumerate(olds)}, {k: i for i, k in enumerate(news)}
            most = edges.n_events.max()
            for r in edges.itertuples():
                # All edges agree everywhere: more events first, then like sketches, then like names.
                weight[row[r.old], col[r.new]] = 1 + r.n_events / (1 + most) + 0.1 * r.jaccard + 0.01 * (1 - r.name_gap)
            found += [(pdf.feed.iloc[0], no, olds[i], news[j]) for i, j in best_assignment(weight)]
        return pd.DataFrame(found, columns=["feed", "file_no", "old", "new"])

    # An edge whose keys have no other is its own matching; the rest is solved, some files of a feed together.
    edges = written(edges, "drift-edges")
    degree = lambda key: F.count("*").over(W.partitionBy("feed", "file_no", key))
    edges = edges.withColumn("alone", (degree("old") == 1) & (degree("new") == 1))
    contested = written(edges.filter("not alone").drop("alone"), "drift-contested")
    out = edges.filter("alone").select("feed", "file_no", "old", "new")
    if contested.isEmpty():
        return out
    return out.unionByName(contested.withColumn("part", F.floor(F.col("file_no") / 50)).groupBy("feed", "part").applyInPandas(solve, out.schema))


def schema_changes(features: DataFrame, *, min_events: int = 2, **columns: str) -> DataFrame:
    """Every change of a key between a file and the one before it in its feed.

    Columns feed, file_no, field_name, new_name, change_kind (added, removed, renamed,
    type_changed). A rename replaces the removed and the added row of its two keys.
    """
    # Parsed once: the cells are read again by the profile and by both sides of the rename edges.
    cells = written(property_cells(features, **columns), "drift-cells")
    profiles = written(profile(cells), "drift-profiles")
    changes = written(key_changes(profiles), "drift-changes")
    order = W.partitionBy("feed").orderBy("file_no")
    files = profiles.select("feed", "file_no").distinct().withColumn("before", F.lag("file_no").over(order))
    candidates = written(rename_candidates(profiles, changes, files), "drift-candidates")
    renames = written(matched_renames(rename_edges(cells, candidates, min_events)), "drift-renames")
    gone = renames.select("feed", "file_no", F.col("old").alias("key"), F.lit("removed").alias("change_kind")).unionByName(renames.select("feed", "file_no", F.col("new").alias("key"), F.lit("added").alias("change_kind")))
    plain = changes.join(gone, ["feed", "file_no", "key", "change_kind"], "left_anti")
    return plain.select("feed", "file_no", F.col("key").alias("field_name"), F.col("key").alias("new_name"), "change_kind").unionByName(
        renames.select("feed", "file_no", F.col("old").alias("field_name"), F.col("new").alias("new_name"), F.lit("renamed").alias("change_kind"))
    )


def unified_features(features: DataFrame, *, feature_id: str = "feature_id", feed: str = "feed", file_no: str = "file_no", body: str = "body", root: str = "$.properties", event_key: str = "event_id", min_events: int = 2) -> DataFrame:
    """All features as one consistent table: renamed keys under the name they had first.

    Columns feature_id, feed, file_no, properties: a map of canonical name to a struct of ``text``
    (the JSON text), and ``number`` or ``flag`` where all the column's values in its feed can be read
    as such. A key that is added again under a name that is in use by another, renamed column is
    a column of its own, called name#file. A null stays an entry with null text. A chain of renames is
    followed to its start by walking the feed's changes in order, which are as many as its changes
    of schema, not as its rows.
    """
    names = {"feed": feed, "file_no": file_no, "body": body, "root": root, "event_key": event_key}
    changes = written(schema_changes(features, min_events=min_events, **names).filter(F.col("change_kind").isin("renamed", "added")), "drift-all-changes")

    def lives(pdf: pd.DataFrame) -> pd.DataFrame:
        """From which file on a key stands for which column."""
        now: dict[str, str] = {}
        used: set[str] = set()
        out = []
        for no, group in pdf.sort_values("file_no").groupby("file_no"):
            renamed = group[group.change_kind == "renamed"]
            olds = {r.field_name: now.pop(r.field_name, r.field_name) for r in renamed.itertuples()}
            used |= set(olds.values())
            for r in renamed.itertuples():
                now[r.new_name] = olds[r.field_name]
                out.append((pdf.feed.iloc[0], r.new_name, no, now[r.new_name]))
            for r in group[group.change_kind == "added"].itertuples():
                taken = r.field_name in used
                now[r.field_name] = f"{r.field_name}#{no}" if taken else r.field_name
                out.append((pdf.feed.iloc[0], r.field_name, no, now[r.field_name]))
        return pd.DataFrame(out, columns=["feed", "key", "from_no", "column"])

    touched = changes.filter("change_kind = 'renamed'").select("feed").distinct()
    named = changes.join(touched, "feed", "left_semi").groupBy("feed").applyInPandas(lives, "feed string, key string, from_no long, column string")
    named = named.withColumn("until_no", F.lead("from_no").over(W.partitionBy("feed", "key").orderBy("from_no")))
    props = F.expr(f"try_cast(try_variant_get(try_parse_json(`{body}`), '{root}', 'variant') as map<string,variant>)")
    texts = F.transform_values("props", lambda k, v: F.nullif(F.to_json(v), F.lit("null")))
    rows = features.select(F.col(feature_id).alias("feature_id"), F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), props.alias("props"))
    rows = written(rows.select("feature_id", "feed", "file_no", texts.alias("texts")), "unified-texts")

    # What each key of each file stands for and can be read as: as many rows as the files' profiles.
    number = lambda text: F.regexp_replace(text, '^"(.*)"$', "$1").try_cast("double")
    flag = lambda text: F.regexp_replace(text, '^"(.*)"$', "$1").try_cast("boolean")
    cells = rows.select("feed", "file_no", F.explode("texts").alias("key", "text"))
    odd = lambda as_type: F.count_if(F.col("text").isNotNull() & as_type("text").isNull())
    found = written(cells.groupBy("feed", "file_no", "key").agg(odd(number).alias("no_number"), odd(flag).alias("no_flag")), "unified-keys")
    in_force = (F.col("file_no") >= F.col("from_no")) & (F.col("until_no").isNull() | (F.col("file_no") < F.col("until_no")))
    columns = found.join(named, ["feed", "key"]).filter(in_force).select("feed", "file_no", "key", "column")
    found = found.join(columns, ["feed", "file_no", "key"], "left").withColumn("column", F.coalesce("column", "key"))
    whole = W.partitionBy("feed", "column")
    found = found.withColumns({"numeric": F.sum("no_number").over(whole) == 0, "logical": F.sum("no_flag").over(whole) == 0})
    meanings = found.groupBy(F.col("feed").alias("m_feed"), F.col("file_no").alias("m_no")).agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("column", "numeric", "logical")))).alias("meaning"))
    rows = rows.join(meanings, F.col("feed").eqNullSafe(F.col("m_feed")) & F.col("file_no").eqNullSafe(F.col("m_no")), "left")

    def entry(e: Column) -> Column:
        m, text = F.col("meaning")[e["key"]], e["value"]
        value = F.struct(text.alias("text"), F.when(m["numeric"], number(text)).alias("number"), F.when(m["logical"] & ~m["numeric"], flag(text)).alias("flag"))
        return F.struct(m["column"].alias("key"), value.alias("value"))

    entries = F.array_sort(F.transform(F.map_entries("texts"), entry))
    once = F.filter("entries", lambda e, i: (i == 0) | (e["key"] != F.try_element_at(F.col("entries"), i)["key"]))
    rows = rows.select("feature_id", "feed", "file_no", entries.alias("entries"))
    return rows.select("feature_id", "feed", "file_no", F.map_from_entries(once).alias("properties"))
