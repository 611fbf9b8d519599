"""Schema drift against a brute-force reading of the definition."""

import itertools
import json
import random

import numpy as np

from seiche.operators.drift import best_assignment, schema_changes, unified_features

SCHEMA = "feature_id long, feed string, file_no long, body string, key string, value string"


def table(spark, rows):
    return spark.createDataFrame([(k, f, n, b, "clash", "clash") for k, (f, n, b) in enumerate(rows)], SCHEMA)


def body(**props):
    return json.dumps({"type": "Feature", "properties": props})


def kind(v):
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def brute(rows):
    files = {}
    for feed, no, text in rows:
        files.setdefault(feed, {}).setdefault(no, []).append(json.loads(text)["properties"])
    out = set()
    for feed, by_no in files.items():
        nos = sorted(by_no)
        last = {}
        for k, no in enumerate(nos):
            now = {key for p in by_no[no] for key in p}
            kinds = {key: {kind(p[key]) for p in by_no[no] if p.get(key) is not None} for key in now}
            if k:
                old = by_no[nos[k - 1]]
                before = {key for p in old for key in p}
                removed, added = before - now, now - before
                pairs = []
                for r, a in itertools.product(sorted(removed), sorted(added)):
                    events = {p["event_id"] for p in old} & {p["event_id"] for p in by_no[no]}
                    seen = [(next(p.get(r) for p in old if p["event_id"] == e), next(p.get(a) for p in by_no[no] if p["event_id"] == e)) for e in events]
                    seen = [s for s in seen if s[0] is not None]
                    if len(seen) >= 2 and all(x == y for x, y in seen):
                        pairs.append((r, a))
                for r, a in pairs:
                    out.add((feed, no, r, a, "renamed"))
                    removed.discard(r), added.discard(a)
                out |= {(feed, no, x, x, "removed") for x in removed} | {(feed, no, x, x, "added") for x in added}
                out |= {(feed, no, x, x, "type_changed") for x in now & before if kinds[x] and last.get(x) and kinds[x] != last[x]}
            for key, ks in kinds.items():
                if ks:
                    last[key] = ks
    return out


def found(df):
    return {tuple(r) for r in schema_changes(df).select("feed", "file_no", "field_name", "new_name", "change_kind").collect()}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for feed in ("a", "b", "c"):
        names = {k: k for k in ("mag", "depth", "phases", "kind")}
        events = []
        for no in range(1, 7):
            events = events[-4:] + [f"e{feed}{no}{k}" for k in range(3)]
            if no > 1 and rng.random() < 0.7:
                k = rng.choice(list(names))
                names[k] = rng.choice([None, f"{k}_{no}"]) if names[k] else k
            text_phases = rng.random() < 0.3
            for e in events:
                p = {"event_id": e}
                for k, name in names.items():
                    if name:
                        v = int.from_bytes((e + k).encode()[-3:], "big")
                        p[name] = str(v) if k == "phases" and text_phases else v
                rows.append((feed, no, body(**p)))
        rows.append((feed, 6, rows[-1][2]))
    assert found(table(spark, rows)) == brute(rows)


def test_edge_cases(spark):
    rows = [
        ("f", 1, body(event_id="x", a=1, n=None)), ("f", 1, body(event_id="y", a=2)), ("f", 1, "not json"), ("f", 1, None), ("f", 1, '{"properties": 5}'),
        ("f", 3, body(event_id="x", b=1, n=[1])), ("f", 3, body(event_id="y", b=2)), (None, 1, body(event_id="q", a=1)),
    ]
    assert found(table(spark, rows)) == {("f", 3, "a", "b", "renamed")}
    assert found(table(spark, [])) == set()
    names = {r.feature_id: set(r.properties or {}) for r in unified_features(table(spark, rows)).collect()}
    assert names[5] == {"event_id", "a", "n"} and names[0] == {"event_id", "a", "n"} and names[2] == set()


def test_unified_table_is_typed_and_keeps_lives_apart(spark):
    rows = [
        ("f", 1, body(event_id="x", a=1, p=5, q=True)), ("f", 1, body(event_id="y", a=2, p=None, q=False)),
        ("f", 2, body(event_id="x", b=1, p="7", q=True)), ("f", 2, body(event_id="y", b=2, p="8", q=False)),
        ("f", 3, body(event_id="x", b=1, a="new", p="9")), ("f", 3, body(event_id="y", b=2, a="z", p=1)),
    ]
    out = {r.feature_id: r.properties for r in unified_features(table(spark, rows)).collect()}
    assert [out[k]["a"].number for k in range(6)] == [1.0, 2.0] * 3
    assert out[4]["a#3"].text == '"new"' and out[4]["a#3"].number is None and "b" not in out[2]
    assert [out[k]["p"].number for k in range(6)] == [5.0, None, 7.0, 8.0, 9.0, 1.0] and out[1]["p"].text is None
    assert (out[0]["q"].flag, out[1]["q"].flag, out[0]["event_id"].number) == (True, False, None)


def test_sketches_prune_only_what_cannot_match(spark):
    many = [("f", 1, body(event_id=f"e{k}", old=k, other=-k - 1)) for k in range(3000)]
    more = [("f", 2, body(event_id=f"e{k}", new=k)) for k in range(2990, 6000)]
    assert found(table(spark, many + more)) == {("f", 2, "old", "new", "renamed"), ("f", 2, "other", "other", "removed")}


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        w = np.where(rng.random((n, m)) < 0.6, rng.integers(1, 9, (n, m)), 0).astype(float)
        best = max(sum(w[i, j] for i, j in zip(rows, cols)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert np.isclose(sum(w[i, j] for i, j in best_assignment(w)), best)
