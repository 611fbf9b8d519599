"""Text statistics against loops, and kinds of documents."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from seiche.llm.quality import distributions, measured, no_prose, scored, sketches, statistics
from seiche.llm.utf8 import slices

PROSE = "We have shown that the strain of the crust is not constant, and that it follows the load. It was measured in the summer.\n"


def documents():
    rng = random.Random(2)
    number = lambda: f"{rng.uniform(-99, 99):.2f}"
    table = lambda sep, end="": "\n".join(sep.join(rng.choice([number(), "--", "ABC"]) for _ in range(5)) + end for _ in range(20))
    word = lambda: rng.choice(["seismic", "layer", "stable", "crust", "model"])
    out = [("prose", PROSE * rng.randint(2, 9)) for _ in range(80)]
    out += [("table", table(s, e)) for s, e in (("\t", ""), (",", ""), ("    ", ""), (" & ", " \\\\"), (" | ", ""))]
    out += [("list", "\n".join(f"{m(k)} {word()} {word()}" for k in range(20))) for m in (lambda k: f"({chr(97 + k)})", lambda k: f"{k + 1}.", lambda k: "-", lambda k: "\u2022", lambda k: "\\item", lambda k: f"\\bibitem{{k{k}}} A. Bolt,")]
    junk = lambda alphabet: "\n".join("".join(rng.choices(alphabet, k=60)) for _ in range(12))
    out += [("junk", junk(a)) for a in ("0123456789abcdef", string.ascii_letters + string.digits + "+/", "!#$%&*<>=?@^~{}[] ", "\u00c3\u00a2\u20ac\u0161\u00c5\u0192\u00b6", "bcdfghjklmnpqrstvwxz ")]
    out += [("prose", PROSE * 8 + table("\t")[:300]), ("prose", "\\section{A}\n" + PROSE * 3 + "\\begin{itemize}\n\\item " + PROSE + "\\end{itemize}")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, text, rng, "clash", 1.0) for k, (text, rng) in enumerate(rows)], "doc_id long, text string, lang string, junk string, no_prose double")


def test_kinds(spark):
    docs = documents()
    rows = [(t, "en" if k % 7 else None) for k, (_, t) in enumerate(docs)] + [(None, "en"), ("", None), (" \n ", "de")]
    got = {r.doc_id: r.doc_kind for r in no_prose(frame(spark, rows)).collect()}
    assert got == {k: kind for k, (kind, _) in enumerate(docs) if kind != "prose"}


@pytest.mark.parametrize("times", [1, 8])
def test_a_large_share_without_prose(spark, times):
    docs = documents()
    docs = [d for d in docs if d[0] == "prose"][:40] + [d for d in docs if d[0] != "prose"] * (3 * times)  # over half, and nine tenths
    got = {r.doc_id: r.doc_kind for r in no_prose(frame(spark, [(t, "en") for _, t in docs])).collect()}
    assert got == {k: kind for k, (kind, _) in enumerate(docs) if kind != "prose"}


def test_counts_match_loops():
    texts = ["One two, three.\nfour five\n\nsix!", "", "caf\u00e9 na\u00efve \u65e5\u672c\u8a9e", " \r\n", "\ufeffx", "a1b2 \\emph{word} end", None, "no stop\nstop;\r\nthe of"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (_, _, data, starts), = slices(batch, "text")
    m = measured(data, starts)
    assert m["n_chars"].tolist() == [len(t or "") for t in texts]
    assert m["n_words"].tolist() == [6, 0, 3, 0, 1, 4, 0, 5] and m["n_lines"].tolist() == [3, 0, 1, 0, 1, 1, 0, 3]
    assert m["stopped"].tolist() == [2, 0, 0, 0, 0, 0, 0, 1] and m["n_common"].tolist()[-1] == 3
    assert m["symbols"].tolist()[0] == 3


def test_slices_do_not_matter():
    texts = [t for _, t in documents()]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (_, _, data, starts), = slices(whole, "text")
    together = measured(data, starts)
    for k, t in enumerate(texts):
        (_, _, one, at), = slices(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]), "text")
        alone = measured(one, at)
        assert {c: v[0] for c, v in alone.items()} == {c: v[k] for c, v in together.items()}


def test_sketches_and_scores(spark):
    stats = statistics(frame(spark, [(t, "en") for _, t in documents()])).cache()
    assert {(r.lang, r.pooled) for r in sketches(stats).collect()} == {("en", False), (None, True)}
    values = sorted(r.word_length for r in stats.collect() if r.word_length is not None)
    q = next(r.q for r in distributions(stats).collect() if r.statistic == "word_length" and r.pooled)
    assert q[3] == pytest.approx(values[len(values) // 2], abs=0.2)
    assert scored(stats).filter("z_no_prose is null").count() == 0


@pytest.mark.parametrize("times", [1, 40])
def test_tails_do_not_move_with_what_is_no_prose(spark, times):
    from seiche.llm.quality import tails

    docs = documents()
    rows = [(t, "en") for kind, t in docs if kind == "prose"] + [(t, lang) for kind, t in docs if kind != "prose" for lang in ["en", "xx", None] * times]
    rows += [(PROSE * 3, "xx"), (None, "en"), ("", None)]
    stats = statistics(frame(spark, rows)).cache()
    got = tails(stats).collect()
    shares = {r.doc_id: r.no_prose for r in stats.collect()}
    # All that is no prose is in the tail, in languages with next to no prose among all of it; plain prose is in none.
    found = {r.doc_id for r in got if r.statistic == "no_prose"}
    assert found >= {k for k, s in shares.items() if s is not None and s > 0.5} and len(rows) - 3 not in {r.doc_id for r in got}
    assert {r.lang for r in got} == {"en", "xx", None} and all((r.z is None) == (r.lang != "en") and r.pz is not None for r in got)
    values = sorted(s for k, s in shares.items() if s is not None and s <= 0.5)
    q = np.quantile(values, [0.25, 0.5, 0.75], method="inverted_cdf")
    one = next(r for r in got if r.statistic == "no_prose" and r.lang == "xx")
    assert one.pz == pytest.approx((one.value - q[1]) / max((q[2] - q[0]) / 1.349, 0.01), rel=0.05)
    assert tails(stats.filter("no_prose > 0.5")).count() == 0


def test_empty(spark):
    assert no_prose(frame(spark, [])).count() == 0
    assert no_prose(frame(spark, [(None, None)])).count() == 0
