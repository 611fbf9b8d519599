"""The queries of the operators for training data, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seiche.llm.consensus import consensus, event_number, not_missing, survivors
from seiche.llm.leaks import leaked_windows, leaks
from seiche.llm.nearest_time import complete_records, matched_by_time
from seiche.llm.quality import distributions, no_prose, statistics, tails
from seiche.llm.tokens import encoded, vocabulary_use
from seiche.session import written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tolerance = _read(spark, sf_dir, "match_tolerance")
    # Two rows, fixed: the largest tolerance bounds how far the merge has to look.
    reach = tolerance.agg(F.max("tol_seconds")).head()[0] or 0.0
    sil = complete_records(_read(spark, sf_dir, "sil_events"), keep=("evaluation_mode",))
    sil = sil.join(tolerance, "evaluation_mode").withColumnsRenamed({"tol_seconds": "tol_s"})
    other = complete_records(_read(spark, sf_dir, "seiscomp_events"))
    # Written once: the slices' bounds are taken from the same rows that are matched.
    pairs = matched_by_time(written(sil, "left-events"), other, reach_s=reach)
    return pairs.select(F.col("right_id").alias("seiscomp_event_id"), F.col("left_id").alias("sil_event_id"))


# The numeric fields whose presence makes a record complete.
COMPLETE = ("depth_km", "m_ml", "m_mlw", "m_autmag", "seismic_moment", "quality", "strike", "dip", "slip")


def _present(name: str) -> Column:
    return not_missing(F.col(name), -3, 10) if name in ("m_ml", "m_mlw", "m_autmag") else not_missing(F.col(name))


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.lower(F.trim(F.col(c)))
    trust = _read(spark, sf_dir, "system_trust").select(plain("originating_system").alias("system"), "trust_order")
    quakes = _read(spark, sf_dir, "skjalftalisa_quakes").select("row_id", "event_id", "originating_system", "updated_time", "event_code", *COMPLETE)
    return quakes.withColumn("system", plain("originating_system")).join(trust, "system", "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = sum((_present(c).isNotNull().cast("int") for c in COMPLETE), F.lit(0))
    latest = -F.coalesce(F.unix_micros(F.col("updated_time").cast("timestamp")), F.lit(-(2**62)))
    best = survivors(
        _trusted(spark, sf_dir),
        key=event_number(F.col("event_id")),
        order=[F.coalesce("trust_order", F.lit(2**62)), -filled, latest],
        number=F.col("row_id"),
        fill={"autmag": _present("m_autmag")},
    )
    return best.select(F.col("key").alias("event_id"), F.col("survivor").alias("row_id"), F.coalesce("autmag_from", F.lit(0)).cast("long").alias("autmag_row_id"))


def p6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event number: the system and event code nearest to the group's weighted consensus."""
    weight = 1 / F.coalesce("trust_order", F.lit(9))
    columns = {"originating_system": F.trim("originating_system"), "event_code": F.col("event_code"), "event_id": F.trim("event_id")}
    rows = consensus(_trusted(spark, sf_dir), key=event_number(F.col("event_id")), columns=columns, weight=weight)
    return rows.select(F.col("key").alias("event_id"), "column", "value", "n_values", "consensus")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_read(spark, sf_dir, "documents"))


def p8_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_use(encoded(_read(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_windows(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with up to one substituted word in each window of twelve."""
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"), substitutions=1)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return no_prose(_read(spark, sf_dir, "documents"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(_read(spark, sf_dir, "documents"))


def p10_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions(statistics(_read(spark, sf_dir, "documents")))


def p10_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each document that are in the tails of the prose of its language, by robust z-scores."""
    return tails(written(statistics(_read(spark, sf_dir, "documents")), "text-statistics"))


QUERIES = {f.__name__: f for f in (p4_found, p6_found, p6_consensus, p8_ids, p8_vocabulary, p9_found, p9_overlaps, p10_found, p10_statistics, p10_distributions, p10_tails)}

_FILLED = " + ".join(f"(CASE WHEN {c} IS NOT NULL AND NOT isnan({c})" + (f" AND {c} BETWEEN -3 AND 10" if c.startswith("m_") else "") + " THEN 1 ELSE 0 END)" for c in COMPLETE)

SQL = {
    "p4_found": """
WITH sil AS (
  SELECT event_id, origin_time t, coordinates[1] lon, coordinates[2] lat, evaluation_mode,
         row_number() OVER (PARTITION BY event_id ORDER BY loaded_at, row_id) n
  FROM sil_events WHERE origin_time IS NOT NULL AND coordinates[1] IS NOT NULL AND coordinates[2] IS NOT NULL),
sc AS (
  SELECT event_id, origin_time t, coordinates[1] lon, coordinates[2] lat,
         row_number() OVER (PARTITION BY event_id ORDER BY loaded_at, row_id) n
  FROM seiscomp_events WHERE origin_time IS NOT NULL AND coordinates[1] IS NOT NULL AND coordinates[2] IS NOT NULL),
pairs AS (
  SELECT a.event_id sil_event_id, b.event_id seiscomp_event_id, abs(epoch_us(b.t) - epoch_us(a.t)) dt,
         2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2)
           + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) km, m.tol_km
  FROM sil a JOIN match_tolerance m USING (evaluation_mode)
  JOIN sc b ON b.t BETWEEN a.t - to_microseconds(CAST(round(m.tol_seconds * 1000000) AS BIGINT))
                       AND a.t + to_microseconds(CAST(round(m.tol_seconds * 1000000) AS BIGINT))
  WHERE a.n = 1 AND b.n = 1)
SELECT seiscomp_event_id, sil_event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sil_event_id ORDER BY dt, seiscomp_event_id) n FROM pairs WHERE km <= tol_km)
WHERE n = 1""",
    "p6_found": f"""
WITH q AS (
  SELECT TRY_CAST(regexp_extract(upper(regexp_replace(event_id, '\\s+', '', 'g')), '^(SIL)?0*([0-9]+)$', 2) AS BIGINT) ev, row_id,
         coalesce(t.trust_order, 4611686018427387904) o, {_FILLED} f, updated_time,
         m_autmag IS NOT NULL AND NOT isnan(m_autmag) AND m_autmag BETWEEN -3 AND 10 has
  FROM skjalftalisa_quakes k LEFT JOIN system_trust t ON lower(trim(k.originating_system)) = lower(trim(t.originating_system))),
r AS (
  SELECT *, row_number() OVER (PARTITION BY ev ORDER BY o, f DESC, updated_time DESC NULLS LAST, row_id) n,
         count(*) OVER (PARTITION BY ev) c FROM q WHERE ev IS NOT NULL)
SELECT ev AS event_id, max(row_id) FILTER (n = 1) AS row_id, coalesce(arg_min(row_id, n) FILTER (has), 0) AS autmag_row_id
FROM r WHERE c > 1 GROUP BY ev""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\\[A-Za-z]+', ' ', 'g')), '[\p{L}\p{N}]+') w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\\[A-Za-z]+', ' ', 'g')), '[\p{L}\p{N}]+') w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
}
