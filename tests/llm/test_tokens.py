"""Token ids against the tokenizer's own library."""

import random

import pyarrow as pa
import pytest

from seiche.llm import tokens, utf8
from seiche.llm.tokens import TOKENIZERS, Replay, encode_slice, encoded, merge_table, vocabulary_use
from seiche.llm.utf8 import slices

ODD = [
    "don't 'tis 're's  'S 's 'll've\n's  \t x", "", None, "a" * 5000, "   x\u00a0\u00a0y\u2003\u3000 ", "'", "'s", "x's", "  's", " 's", "e\u0301 \u0e01\u0e33 \x85 \x1c a", "\0\0 \0a\0\0\0", "<|endoftext|> hi", "''s ''' 'd'd",
    "\u65e5\u672c\u8a9e \uff11\uff12\uff13 \u00b2\u00b3\u00bd", "\U0001f469\u200d\U0001f469 \U0001f600", "a\r\n\r\n b", "aaab " * 30, " " * 50, "\n\n\n", "x\n\n\n", "'r", "'re", "'ve'l", "it'll", "\ufeffx", "1234567890" * 40,
]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def own(texts):
    replay = Replay(*merge_table(f"{TOKENIZERS}/byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for row, end, data, starts in slices(batch, "text"):
        offsets, ids = encode_slice(replay, data, starts)
        out += [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(end - row)]
    return out


def texts():
    rng = random.Random(4)
    pieces = ["the", " The", "'s", "'", " ", "  ", "\n", "\t", "12", "\u00e9", "\u65e5", "!?", "\\cmd{", "\u00a0", "zqx", "\0", "longerwordthansixteenbytes", "-"]
    return ODD + ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(400)]


def test_same_ids(library):
    assert own(texts()) == [library(t) for t in texts()]


def test_small_slices_and_forgotten_words(library, monkeypatch):
    monkeypatch.setattr(utf8, "SLICE_BYTES", 50)
    monkeypatch.setattr(tokens, "WORD_BYTES", 10)
    assert own(texts()) == [library(t) for t in texts()]


def test_documents(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(3, ODD[3], "clash")]
    df = encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    got = sorted((r.doc_id, r.ids) for r in df.collect())
    assert got == sorted((k, library(t)) for k, t, _ in rows)
    use = {r.id: r.n for r in vocabulary_use(df).collect()}
    assert sum(use.values()) == sum(len(i) for _, i in got)
    assert encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
