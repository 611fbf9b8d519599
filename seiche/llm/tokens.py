"""Encoding of a corpus with a public byte-level BPE vocabulary, by replay of its merges.

Each task cuts its share of the corpus into words with array operations, keeps the distinct words
and replays every merge over them in rank order: an inverted index leads from a pair's rank to the
positions that hold the pair, and a merge updates only the two neighbours it touches. Words met
before are not replayed again. No data is shuffled; what is sent to the tasks is the merge table,
whose size is that of the vocabulary.

Defined results: an empty and a null text give an empty list; strings of special tokens are
ordinary text; repeated rows give repeated rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from seiche.llm.utf8 import LETTER, SPACE, byte_classes, slices

TOKENIZERS = "/opt/tokenizers"

#: A task forgets its words beyond so many bytes of them and goes on; they are replayed when met again.
WORD_BYTES = 64 << 20


def _byte_names() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def merge_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the 256 bytes, merges as rows left, right, result in rank order) of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return np.array([vocab[c] for c in _byte_names()], np.int32), np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32)


def word_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the words: runs of letters, digits, others or blanks, as byte-level BPE cuts them.

    One blank before a run belongs to it; of several, all but the last stand alone; 's, 't, 're,
    've, 'm, 'll and 'd after a run of another kind are words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    text_edge = starts[(starts < n)]
    edge[text_edge] = True
    ends = np.flatnonzero(edge[1:] & (kind[:-1] == SPACE)) + 1
    ends = ends[~np.isin(ends, text_edge, assume_unique=False)] if len(text_edge) > 1 else ends
    last = ends - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    edge[last] = True
    edge[ends[data[last] == 0x20]] = False
    quotes = np.flatnonzero((data[:-1] == 0x27) & edge[:-1] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(quotes):
        limit = np.append(text_edge, n)[np.searchsorted(text_edge, quotes, "right")]
        one = data[quotes + 1]
        inside = quotes + 1 < limit
        short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        two = data[np.minimum(quotes + 2, n - 1)]
        long = inside & (quotes + 2 < limit) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((short, 2), (long, 3)):
            at = quotes[hit]
            edge[at + 1] = False
            after = at + size
            edge[after[after < limit[hit]]] = True
    return np.flatnonzero(edge)


def packed(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each word as one integer."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    size = np.clip(size, 0, 8)
    mask = np.where(size == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (size.astype(np.uint64) * np.uint64(8))) - np.uint64(1))
    return eight[np.minimum(at, len(data))] & mask


def distinct_words(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, the distinct words). Exact: words are compared, not their hashes."""
    low, high = packed(data, at, size), packed(data, at + 8, size - 8)
    with np.errstate(over="ignore"):
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64))
    mixed ^= mixed >> np.uint64(29)
    codes, found = pd.factorize(mixed)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    rep = first[codes]
    apart = (low[rep] != low) | (high[rep] != high) | (size[rep] != size) | (size > 16)
    text = data.tobytes()
    words = [text[at[i] : at[i] + size[i]] for i in first]
    odd = np.flatnonzero(apart)
    if len(odd):
        known = {w: k for k, w in enumerate(words)}
        for i in odd:
            codes[i] = known.setdefault(text[at[i] : at[i] + size[i]], len(known))
        words = list(known)
    return codes, words


@dataclass
class Replay:
    """The ids of all words met so far, and the merges to find those of new ones."""

    byte_ids: np.ndarray
    merges: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict)
    held: int = 0

    def __post_init__(self) -> None:
        self.rank = {(int(a) << 20) | int(b): r for r, (a, b, _) in enumerate(self.merges)}
        self.forget()

    def forget(self) -> None:
        self.known, self.held = {}, 0
        self.offsets, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words, after replaying the merges over those that are new."""
        if self.held > WORD_BYTES:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            base = len(self.known)
            self.known.update((w, base + k) for k, w in enumerate(new))
            self.held += sum(map(len, new)) + 100 * len(new)
            offsets, flat = self.replay(new)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Every merge in rank order over the words; (offsets, ids)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        sym, after, before = ids.tolist(), after.tolist(), before.tolist()
        rank_of, merges = self.rank.get, self.merges.tolist()
        index: dict[int, list[int]] = {}
        for p in range(n):
            q = after[p]
            if q >= 0:
                r = rank_of(sym[p] << 20 | sym[q])
                if r is not None:
                    index.setdefault(r, []).append(p)
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            left, right, merged = merges[rank]
            places = index.pop(rank)
            places.sort()  # of overlapping pairs the first is merged
            for p in places:
                q = after[p]
                if sym[p] != left or q < 0 or sym[q] != right:
                    continue
                sym[p], sym[q] = merged, -1
                nxt = after[p] = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    r = rank_of(merged << 20 | sym[nxt])
                    if r is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(queue, r)
                        index[r].append(p)
                prv = before[p]
                if prv >= 0:
                    r = rank_of(sym[prv] << 20 | merged)
                    if r is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(queue, r)
                        index[r].append(prv)
        left_over = np.array(sym, np.int32)
        alive = left_over >= 0
        return np.concatenate([[0], np.cumsum(alive)[ends - 1]]), left_over[alive]


def encode_slice(replay: Replay, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, their ids one after the other)."""
    at = word_starts(data, starts)
    if not len(at):
        return np.zeros(len(starts), np.int32), np.zeros(0, np.int32)
    size = np.diff(np.append(at, len(data)))
    codes, words = distinct_words(data, at, size)
    number = replay.add(words)[codes]
    begin = replay.offsets[number]
    count = replay.offsets[number + 1] - begin
    ends = np.cumsum(count)
    take = np.repeat(begin - ends + count, count)
    take += np.arange(ends[-1])
    first_word = np.searchsorted(at, starts)
    return np.append(0, ends)[first_word].astype(np.int32), replay.flat[take]


def encoded(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row a document: doc_id and ids, the token ids of its whole text."""
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(merge_table(f"{tokenizers}/{vocabulary}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(*table.value)
        for batch in batches:
            for row, end, data, starts in slices(batch, text):
                offsets, ids = encode_slice(replay, data, starts)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(doc_id).slice(row, end - row), lists], names=["doc_id", "ids"])

    rows = documents.select(doc_id, text)
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def vocabulary_use(encoded_documents: DataFrame) -> DataFrame:
    """How often each token id occurs: id, n. Counted in the map tasks before the shuffle."""
    from pyspark.sql import functions as F

    return encoded_documents.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
