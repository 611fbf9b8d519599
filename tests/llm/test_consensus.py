"""Survivors against sorting each group; consensus of planted variants."""

import random

from pyspark.sql import functions as F

from seiche.llm.consensus import consensus, event_number, not_missing, placed, survivors, tokens


def test_numbers(spark):
    cases = {"SIL001": 1, " 0042 ": 42, "sil7": 7, "SIL 9": 9, "x1": None, "": None, "SIL": None, "0": 0, "1.5": None, "9" * 30: None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    assert {r.v: r.n for r in df.select("v", event_number(F.col("v")).alias("n")).collect()} == cases | {None: None}


def test_survivors_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(30) if rng.random() < 0.95 else None, rng.choice([1, 2, 3]), rng.randrange(3), rng.choice([None, float("nan"), 1.0, 99.0, -3.0, 10.0]), "clash") for k in range(300)]
    df = spark.createDataFrame(rows, "row_id long, ev long, o long, f long, m double, key string")
    out = survivors(df, key=F.col("ev"), order=[F.col("o"), -F.col("f")], number=F.col("row_id"), fill={"m": not_missing(F.col("m"), -3, 10)})
    want = {}
    for e in range(30):
        g = sorted((r for r in rows if r[1] == e), key=lambda r: (r[2], -r[3], r[0]))
        if len(g) > 1:
            want[e] = (g[0][0], next((r[0] for r in g if r[4] in (1.0, -3.0, 10.0)), None))
    assert {r.key: (r.survivor, r.m_from) for r in out.collect()} == want
    assert survivors(df.limit(0), key=F.col("ev"), order=[F.col("o")], number=F.col("row_id"), fill={}).count() == 0


def test_places_spell_the_value():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(2))
        out = placed(a, b)
        assert "".join(t for _, t in out) == "".join(b) and [p for p, _ in out] == sorted({p for p, _ in out})
        assert {p for p, _ in out if p % 2} == {2 * k + 1 for k in range(len(a))}
    assert placed(tokens("Mount Alpha"), tokens("Mt Alpha North")) == [(1, "Mt"), (3, " "), (5, "Alpha"), (6, " North")]


def test_consensus_of_variants(spark):
    rows = [(1, "Mount Alpha North", 3.0), (1, "Mount Alpha", 1.0), (1, "Mt Alpha North", 1.0), (1, "Mount Alpha North", 1.0), (2, "ab1", 1.0), (2, "ab 1", 1.0), (2, "ab  1", 1.0), (3, "", 1.0), (3, "x", 2.0)]
    got = {r.key: (r.value, r.consensus, r.n_values) for r in consensus(spark.createDataFrame(rows, "k long, v string, w double"), key=F.col("k"), columns={"v": F.col("v")}, weight=F.col("w")).collect()}
    assert got[1] == ("Mount Alpha North", "Mount Alpha North", 3) and got[3] == ("x", "x", 2) and got[2][0] in ("ab1", "ab 1", "ab  1") and got[2][2] == 3


def test_consensus_of_groups(spark):
    rng = random.Random(3)
    rows = [(1, "Site 12 north ridge", 1.0)] * 3
    for _ in range(120):  # a hot group of many spellings
        w = "Site 12 north ridge".split()
        w[rng.randrange(4)] = f"x{rng.randrange(1000)}"
        rows.append((1, " ".join(w), 1.0))
    rows += [(2, "only", 1.0), (3, None, 1.0), (None, "lost", 1.0)]
    df = spark.createDataFrame(rows, "k long, v string, w double")
    got = {(r.key, r.column): r.value for r in consensus(df, key=F.col("k"), columns={"v": F.col("v")}, weight=F.col("w")).collect()}
    assert got == {(1, "v"): "Site 12 north ridge", (2, "v"): "only"}
    assert consensus(df.limit(0), key=F.col("k"), columns={"v": F.col("v")}, weight=F.col("w")).count() == 0
