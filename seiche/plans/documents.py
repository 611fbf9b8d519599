"""Small documents that steer or record the work: byte-stable JSON, station entries of YAML files, checked readers.

Each document is of one size whatever the data: settings and results per station, read and written
by the driver. Writers go through a temporary name and an atomic rename; readers refuse what they do
not know. Text goes in and out, so that a document can also live in a table or a service.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from seiche.operators.predicates import Selection
from seiche.plans.grammar import Stage, Term, parse_region, parse_stage, parse_term

NOISE_VERSION, DECAY_SCHEMA, K_SCHEMA, PARAMETER_SCHEMA = 1, 1, 1, 1


def stable_json(document: object) -> str:
    """JSON with its keys in order; equal documents give equal bytes."""
    return json.dumps(document, sort_keys=True, indent=1, ensure_ascii=False, allow_nan=False) + "\n"


def write_text(path: str, text: str) -> None:
    """All of the text or nothing: a reader never sees half of it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(f".{target.name}.{os.getpid()}.part")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, target)


def checked(text: str, key: str, known: object, what: str) -> dict:
    """The document, if it is of the known version."""
    document = json.loads(text)
    if document.get(key) != known:
        raise ValueError(f"{what} {key} {document.get(key)!r}, not {known!r}")
    return document


def noise_record(text: str) -> dict:
    return checked(text, "record_version", NOISE_VERSION, "noise record")


def decay_record(text: str) -> dict:
    return checked(text, "schema", DECAY_SCHEMA, "decay")


def k_table(text: str, frame: str) -> tuple[dict, str]:
    """(the table of rate scales, the digest of its text); another schema or frame raises."""
    table = checked(text, "schema", K_SCHEMA, "k table")
    if table.get("frame") != frame:
        raise ValueError(f"k table frame {table.get('frame')!r}, not {frame!r}")
    return table, hashlib.sha256(text.encode()).hexdigest()[:16]


def parameter_document(records: Iterable[dict], *, frame: str, generated_at: str | None = None) -> dict:
    """The stations' parameter records as one document; with no time of making, equal records give equal text."""
    out: dict = {"schema": PARAMETER_SCHEMA, "frame": frame, "stations": {}}
    for r in sorted(records, key=lambda r: r["station"]):
        out["stations"][r["station"]] = {k: v for k, v in r.items() if k != "station"}
    return out | ({"generated_at": generated_at} if generated_at else {})


def merged_entry(document: dict | None, keys: list[str], station: str, value: object | None) -> dict:
    """The document with one station's entry at a path of keys set, or with None taken out; everything else stays.

    Blocks that hold nothing any more go, too. Something else than a mapping on the way raises.
    """
    document = dict(document or {})
    node, chain = document, []
    for k in keys:
        child = node.get(k, {})
        if not isinstance(child, dict):
            raise ValueError(f"{k!r} is no mapping")
        chain.append((node, k))
        child = dict(child)
        node[k] = child
        node = child
    if value is None:
        node.pop(station, None)
    else:
        node[station] = value
    for parent, k in reversed(chain):
        if not parent[k]:
            del parent[k]
    return document


def merge_yaml(text: str, keys: list[str], station: str, value: object | None) -> str:
    """``merged_entry`` on YAML text."""
    import yaml

    document = yaml.safe_load(text) or {}
    if not isinstance(document, dict):
        raise ValueError("the document is no mapping")
    return yaml.safe_dump(merged_entry(document, keys, station, value), sort_keys=False, allow_unicode=True)


def station_models(document: Mapping) -> dict[str, tuple[Term, ...]]:
    """The terms of each station's model, each checked."""
    return {sta: tuple(parse_term(t) for t in (entry or {}).get("terms", ())) for sta, entry in document.items()}


def stage_plans(document: Mapping) -> dict[str, tuple[Stage, ...]]:
    """The stages of each station's plan in order; a name may come once in a plan."""
    out = {}
    for sta, specs in document.items():
        plan = tuple(parse_stage(s) for s in specs or ())
        if len({s.name for s in plan}) != len(plan):
            raise ValueError(f"{sta}: a stage's name comes twice")
        out[sta] = plan
    return out


def secular_store(document: Mapping) -> dict[str, dict[str, dict[str, float]]]:
    """station -> component -> parameter -> value of saved backgrounds; every value is a finite number."""
    out = {}
    for sta, components in document.items():
        out[sta] = {c: {n: float(v) for n, v in values.items()} for c, values in components.items()}
        if any(v != v or abs(v) == float("inf") for values in out[sta].values() for v in values.values()):
            raise ValueError(f"{sta}: a saved value is not finite")
    return out


def quake_regions(document: Mapping) -> dict[str, tuple[Selection, dict]]:
    """name -> (selection, its further fields) of named regions: a box, a polygon, or a circle, with bounds."""
    out = {}
    for name, entry in document.items():
        kinds = [k for k in ("bbox", "polygon", "radius") if entry.get(k)]
        if len(kinds) != 1:
            raise ValueError(f"{name}: one of bbox, polygon and radius")
        ranges = {c: (entry.get(f"min_{c}"), entry.get(f"max_{c}")) for c in ("depth_km", "magnitude") if entry.get(f"min_{c}") is not None or entry.get(f"max_{c}") is not None}
        types = tuple(entry["event_types"]) if entry.get("event_types") else None
        if kinds == ["bbox"]:
            selection = Selection(box=tuple(map(float, entry["bbox"])), ranges=ranges, event_types=types)
        elif kinds == ["polygon"]:
            selection = Selection(polygon=tuple((float(x), float(y)) for x, y in entry["polygon"]), ranges=ranges, event_types=types)
        else:
            circle = parse_region(",".join(map(str, entry["radius"]))).circle
            selection = Selection(circle=circle, ranges=ranges, event_types=types)
        out[name] = (selection, {k: v for k, v in entry.items() if k in ("area", "default", "title")})
    return out


def active_stations(document: Mapping) -> set[str]:
    """All stations of the volcanic areas, none without such a section."""
    areas = (document.get("volcanic_areas") or {}).values()
    return {str(s).upper() for a in areas for s in ((a or {}).get("stations") if isinstance(a, dict) else a) or ()}


def reasoned_rules(spark: SparkSession, rows: Iterable[dict], kind: str) -> DataFrame:
    """Reviewed rules of stations as a table, refused where one lacks its reason or what it does.

    ``exclusions``: station, drop_dir, drop_before_year, reason (a folder or a year, or both);
    ``junctions``: station, component (N, E, U), before_year, offset_m, reason.
    """
    text = lambda r, k: (str(r.get(k) or "")).strip()
    number = lambda r, k: float(text(r, k)) if text(r, k) else None
    out = []
    for n, r in enumerate(rows, 2):
        station, reason = text(r, "station").upper(), text(r, "reason")
        if not station or not reason:
            raise ValueError(f"row {n}: a rule has a station and a reason")
        if kind == "exclusions":
            one = (station, text(r, "drop_dir") or None, number(r, "drop_before_year"), reason)
            if one[1] is None and one[2] is None:
                raise ValueError(f"row {n}: a folder or a year")
        else:
            one = (station, text(r, "component").upper(), number(r, "before_year"), number(r, "offset_m"), reason)
            if one[1] not in ("N", "E", "U") or one[2] is None or one[3] is None:
                raise ValueError(f"row {n}: a component, a year and an offset")
        out.append((n, *one))
    schema = "rule_no int, station string, drop_dir string, drop_before_year double, reason string" if kind == "exclusions" else "rule_no int, station string, component string, before_year double, offset_m double, reason string"
    return spark.createDataFrame(out, schema)


def excluded_epochs(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """station, yearf of epochs declared to be blunders; a value that is no number raises."""
    return spark.createDataFrame(sorted({(str(r["sta"]).strip().upper(), float(r["yearf"])) for r in rows}), "station string, yearf double")
