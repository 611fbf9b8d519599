"""Leaks against comparing every window."""

import random
import re

import pytest

from seiche.llm import leaks as module
from seiche.llm.leaks import leaks, masks_for

WORD = re.compile(r"[^\W_]+")


def words(text):
    return [w.lower() for w in WORD.findall(re.sub(r"\\[A-Za-z]+", " ", text or ""))]


def brute(docs, items, window, substitutions):
    out = set()
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            if any(sum(x != y for x, y in zip(a[p : p + window], b[q : q + window])) <= substitutions for p in range(len(a) - window + 1) for q in range(len(b) - window + 1)):
                out.add((d, i))
    return out


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)] + ["\u00e9t\u00e9", "na\u00efve", "3rd", "\u65e5\u672c"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for k in range(25)] + [(25, None), (26, "")]
    docs = [(0, None), (1, ""), (2, "  \n"), (3, "\\" * 50)]
    for d in range(4, 120):
        own = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 2:
            b = words(rng.choice(items[:25])[1])
            n = rng.choice([10, 11, 12, 13, 20])
            p = rng.randint(0, max(0, len(b) - n))
            part = [x.upper() if rng.random() < 0.3 else x for x in b[p : p + n]]
            if rng.random() < 0.4 and part:
                part[rng.randrange(len(part))] = "zzz"
            k = rng.randint(0, len(own))
            own[k:k] = part
        glue = [" ", "\n", "  ", ", ", " \\emph{", "} ", "--", "\r\n% ", "\u2014"]
        docs.append((d, "".join(w + rng.choice(glue) for w in own)))
    docs.append((5, docs[5][1]))
    return docs, items


@pytest.mark.parametrize("substitutions", [0, 1, 2])
@pytest.mark.parametrize("most_bits", [28, 3])
def test_brute_force(spark, substitutions, most_bits, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(module, "LEAST_BITS", 3)
    monkeypatch.setattr(module, "MOST_BITS", most_bits)  # a filter that lets everything through gives the same
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaks(d, i, substitutions=substitutions).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 12, substitutions)


def test_longest_overlap_and_text_ends(spark):
    item = " ".join(f"x{k}" for k in range(30))
    docs = [(0, "a " + " ".join(f"x{k}" for k in range(3, 22)) + " b"), (1, " ".join(f"x{k}" for k in range(6))), (2, " ".join(f"x{k}" for k in range(6, 14)))]
    out = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_windows, r.n_words) for r in out] == [(0, 9, 8, 19)]


def test_masks_cover_every_choice_of_substitutions():
    from itertools import combinations

    for s in (1, 2, 3):
        kept = [set(m.tolist()) for m in masks_for(12, s)]
        assert all(any(not set(c) & m for m in kept) for c in combinations(range(12), s))


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks(d, i).count() == 0
    assert leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).count() == 0
