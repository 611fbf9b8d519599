"""Character classes and slices of many texts at once, on their UTF-8 bytes with numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3

# Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Texts are worked on in slices of about so many bytes; a longer text makes a slice of its own.
SLICE_BYTES = 8 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: letter, digit (any number), white space or other."""
    first = "".join(map(unicodedata.category, map(chr, range(0x110000))))
    major = np.frombuffer(first.encode(), np.uint8)[::2]
    table = np.where(major == ord("L"), LETTER, np.where(major == ord("N"), DIGIT, OTHER)).astype(np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) for runs of rows; starts has one entry more than rows.

    Null texts are empty. The bytes are whole texts, one after the other.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points whose first bytes are at ``lead`` (all beyond ASCII)."""
    b = data[lead].astype(np.uint32)
    size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
    cp = np.where(size == 4, b & 0x07, np.where(size == 3, b & 0x0F, b & 0x1F))
    for k in (1, 2, 3):
        more = size > k
        cp = np.where(more, (cp << 6) | (data[np.minimum(lead + k, len(data) - 1)] & 0x3F), cp)
    return cp


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = classes()
    ascii_table = np.zeros(256, np.uint8)
    ascii_table[:128] = table[:128]
    out = ascii_table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        own = table[code_points(data, lead)]
        out[lead] = own
        b = data[lead]
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            at = lead[b >= least] + k
            keep = at < len(out)
            out[at[keep]] = own[b >= least][keep]
    return out
