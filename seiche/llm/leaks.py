"""Evaluation texts leaking into training text: spaced seeds over windows of words, joined by Spark.

A window of twelve words is hashed under fixed masks that ignore some of its positions: with k
substitutions to be allowed the positions fall into k + 2 interleaved classes (three at least), and
each mask ignores k of them (one at least), so that any k substituted words are ignored by some mask;
without substitutions one mask finds every window. The seeds of all windows of the evaluation items
are rows of a table. A filter of bits over them, of bounded size, goes to the tasks, which hash
the windows of their documents and send on only those that may be among the items'; these are joined
to the items' seeds, and the words of both sides are compared around each hit.

Words are runs of letters and digits in lower case; commands (a backslash and letters) and
everything else separate words.

Defined results: null, empty and short texts leak nothing; an item shorter than the window cannot
leak; repeated rows are reported once; texts of any length are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.llm.utf8 import DIGIT, LETTER, classes, slices
from seiche.session import written

#: Bits of the filter for each seed of the items, and its least and greatest size as powers of two. Beyond the
#: greatest size it only lets more windows through to the join, which is exact.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 32, 16, 28
#: The filter is put together from this many parts.
FILTER_PARTS = 8


@lru_cache(1)
def lower_case() -> np.ndarray:
    """Each code point's lower case, where that is one code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
    return table


@lru_cache(4)
def powers(n: int) -> np.ndarray:
    base = np.full(n, 0x9FB21C651E98DF25, np.uint64)
    base[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(base, dtype=np.uint64)


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, lower-case code points, word begins, word ends)."""
    if len(data) and data.max() >= 0x80:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[starts]
    else:
        cp, begins = data.astype(np.uint32), starts
    n = len(cp)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), cp, none, none
    kind = classes()[cp]
    word = (kind == LETTER) | (kind == DIGIT)
    slashes = np.flatnonzero(cp == 0x5C)
    if len(slashes):
        # The letters of a command, up to the first other character or the end of the text.
        latin = ((cp | 0x20) >= 0x61) & ((cp | 0x20) <= 0x7A) & (cp < 0x80)
        stops = np.append(np.flatnonzero(~latin), n)
        end = np.minimum(stops[np.searchsorted(stops, slashes + 1)], np.append(begins, n)[np.searchsorted(begins, slashes, "right")])
        size = end - slashes - 1
        at = np.repeat(slashes + 1 - np.cumsum(size) + size, size) + np.arange(size.sum())
        word[at] = False
    low = lower_case()[cp]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    inner = np.unique(begins[(begins > 0) & (begins < n)])  # empty texts begin where the next one does
    cut = inner[word[inner] & word[inner - 1]]  # a word that would run on from one text to the next
    bounds = np.flatnonzero(edge)
    first, last = np.sort(np.append(bounds[::2], cut)), np.sort(np.append(bounds[1::2], cut))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), low, none, none
    size = last - first
    head = np.cumsum(size) - size
    at = np.flatnonzero(word)
    with np.errstate(over="ignore"):
        value = low[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA5A5A5A5A5A5A5A5)
        value *= powers(1 << int(size.max()).bit_length())[np.arange(len(at)) - np.repeat(head, size)]
        hashes = np.add.reduceat(value, head)
        hashes ^= hashes >> np.uint64(31)
    return hashes, np.searchsorted(first, begins), low, first, last


def masks_for(window: int, substitutions: int) -> list[np.ndarray]:
    """The positions each mask looks at; see the module's text."""
    n = max(3, substitutions + 2)
    place = np.arange(window)
    masks = [place[~np.isin(place % n, ignored)] for ignored in combinations(range(n), max(1, substitutions))]
    return masks if substitutions else masks[:1]


def seeds(hashes: np.ndarray, window: int, mask: np.ndarray) -> np.ndarray:
    """The seed of the window that begins at each word."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in mask:
            out += hashes[k : k + n] * (powers(window + 1)[k] * np.uint64(2) + np.uint64(1))
    return out ^ (out >> np.uint64(33))


def filter_places(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three places of each seed in a filter of 2 to the ``bits`` bits."""
    low = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        mixed = (seed ^ (seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return [seed & low, (seed >> np.uint64(32)) & low, (mixed >> np.uint64(64 - bits)) & low]


def window_rows(batch: pa.RecordBatch, text: str, number: str, masks: list[np.ndarray], window: int, known: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """number, seed, place (of the window's first word in its text) and words of the windows that may be known (all without a filter)."""
    for row, _, data, starts in slices(batch, text):
        hashes, first, low, begin, end = words_of(data, starts)
        for k, mask in enumerate(masks):
            seed = seeds(hashes, window, mask)
            if not len(seed):
                continue
            with np.errstate(over="ignore"):
                seed += np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
            at = np.arange(len(seed)) if known is None else np.flatnonzero(np.logical_and.reduce([(known[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in filter_places(seed, bits)]))
            of = np.searchsorted(first, at, "right") - 1
            inside = at + window <= first[of + 1]
            at, of = at[inside], of[inside]
            if not len(at):
                continue
            touched = np.unique(at[:, None] + np.arange(window))
            spelled = [low[begin[w] : end[w]].astype("<u4").tobytes().decode("utf-32-le") for w in touched.tolist()]
            words = [" ".join(spelled[i : i + window]) for i in np.searchsorted(touched, at).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(number).take(pa.array(row + of)).cast(pa.int64()), pa.array(seed[at].view(np.int64)), pa.array((at - first[of]).astype(np.int64)), pa.array(words, pa.string())], names=["number", "seed", "place", "words"]
            )


WINDOWS = "number long, seed long, place long, words string"


def seed_filter(seed_rows: DataFrame) -> tuple[np.ndarray, int]:
    """A filter over the seeds: each of a few parts is made by one task, the driver joins these."""
    n = seed_rows.count()
    bits = int(np.clip(math.ceil(math.log2(max(n, 1) * BITS_A_SEED)), LEAST_BITS, MOST_BITS))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            seed = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            for p in filter_places(seed, bits):
                np.bitwise_or.at(own, p >> np.uint64(3), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["part"])

    known = np.zeros(1 << (bits - 3), np.uint8)
    for part in seed_rows.select("seed").coalesce(FILTER_PARTS).mapInArrow(marked, "part binary").toLocalIterator():
        known |= np.frombuffer(part[0], np.uint8)
    return known, bits


def leaked_windows(documents: DataFrame, items: DataFrame, *, window: int = 12, substitutions: int = 0, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, doc_place, item_place of every pair of windows that differ in no more words than asked for."""
    spark = documents.sparkSession
    masks = masks_for(window, substitutions)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from window_rows(batch, "text", "number", masks, window, None, 0)

    item_rows = written(items.select(F.col(item_id).cast("long").alias("number"), F.col(item_text).alias("text")).mapInArrow(of_items, WINDOWS), "item-windows")
    known, bits = seed_filter(item_rows)
    shared = spark.sparkContext.broadcast(known)

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from window_rows(batch, "text", "number", masks, window, shared.value, bits)

    doc_rows = documents.select(F.col(doc_id).cast("long").alias("number"), F.col(text).alias("text")).mapInArrow(of_documents, WINDOWS)
    left = doc_rows.select("seed", F.col("number").alias("doc_id"), F.col("place").alias("doc_place"), F.col("words").alias("doc_words"))
    right = item_rows.select("seed", F.col("number").alias("item_id"), F.col("place").alias("item_place"), F.col("words").alias("item_words"))
    hits = left.join(right, "seed")
    if substitutions:
        differ = F.size(F.filter(F.zip_with(F.split("doc_words", " "), F.split("item_words", " "), lambda x, y: x != y), lambda d: d))
        hits = hits.filter(differ <= substitutions)
    else:
        hits = hits.filter(F.col("doc_words") == F.col("item_words"))
    return hits.select("doc_id", "item_id", "doc_place", "item_place")


def leaks(documents: DataFrame, items: DataFrame, **how: object) -> DataFrame:
    """One row a document and item: doc_id, item_id, n_windows, n_words (of the longest overlap).

    Takes what ``leaked_windows`` takes.
    """
    hits = leaked_windows(documents, items, **how).distinct()
    line = ["doc_id", "item_id", (F.col("doc_place") - F.col("item_place")).alias("line")]
    rows = hits.select(*line, "doc_place")
    run = F.col("doc_place") - F.row_number().over(W.partitionBy("doc_id", "item_id", "line").orderBy("doc_place"))
    runs = rows.withColumn("run", run).groupBy("doc_id", "item_id", "line", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_windows"), (F.max("n") + (how.get("window", 12) - 1)).alias("n_words"))
