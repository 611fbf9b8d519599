"""Per-document text quality: statistics, their distributions per language, and what is no prose.

Each task measures its documents with array operations over characters, words and lines. The
statistics go into mergeable quantile sketches per language and over all; a value becomes a robust
z-score against the sketches' quartiles. Documents most of whose characters are no prose are flagged
whatever the others are like, and called by the kind of line that most of these characters are in.

Defined results: null, empty and blank texts have zero words and null shares and are never
flagged; repeated rows give repeated rows; a null language is a group of its own; texts of any
length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seiche.llm.leaks import lower_case
from seiche.llm.utf8 import DIGIT, LETTER, SPACE, classes, slices
from seiche.session import written

# Frequent short words of English, German, French and Icelandic.
COMMON = {
    "en": "the of and to in a is that it was for on are as with be by at from this not but or an so one may then were they has had its if we our no",
    "de": "der die das und ist nicht ein in zu den mit von auf es ob aus als wie dass dem des im wir sie oder zur mehr hat auch nach bei",
    "fr": "le la les de des et un une est en que qui dans pour pas ne sur au il par plus avec ce se son du ou nous soit bien",
    "is": "og að er í á sem ekki við var um til en það af með fyrir ef þá því hún hann sér eða úr frá svo þar",
}

STATISTICS = ("word_length", "symbol_ratio", "punctuated", "common", "listed", "tabled", "junk", "no_prose")

# Commands that begin an entry of an enumeration, bibliography or glossary.
ENTRY_COMMANDS = ("item", "bibitem", "gls", "newacronym", "newglossaryentry")

_BULLETS = [ord(c) for c in "-*•‣◦·–—▪"]
_STOPS = [ord(c) for c in ".!?;:…。！？；："]


def _pack(words: list[str]) -> np.ndarray:
    return np.unique(np.array([sum(ord(c) << (12 * k) for k, c in enumerate(w)) for w in words if len(w) <= 5], np.uint64))


def _sums(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs that begin at starts (not empty, in order) of n values."""
    total = np.zeros(n + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[np.append(starts[1:], n)] - total[starts]


def measured(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of a slice."""
    if len(data) and data.max() >= 0x80:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[starts]
    else:
        cp, begins = data.astype(np.uint32), starts
    n, n_texts = len(cp), len(starts) - 1
    names = ("n_chars", "n_words", "word_chars", "symbols", "n_lines", "stopped", "n_common", "c_list", "c_table", "c_junk", "c_all")
    if not n:
        return {k: np.zeros(n_texts, np.int64) for k in names}
    kind = classes()[cp]
    letter, digit, space = kind == LETTER, kind == DIGIT, kind == SPACE
    low = lower_case()[cp]
    ascii_letter = (low >= 0x61) & (low <= 0x7A) & (cp < 0x80)

    # Words: runs of letters.
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = letter[0], letter[-1]
    np.not_equal(letter[1:], letter[:-1], out=edge[1:n])
    inner = np.unique(begins[(begins > 0) & (begins < n)])  # empty texts begin where the next one does
    bounds = np.flatnonzero(edge)
    cut = inner[letter[inner] & letter[inner - 1]]
    first, last = np.sort(np.append(bounds[::2], cut)), np.sort(np.append(bounds[1::2], cut))
    size = last - first

    def within(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(flag, out=total[1:])
        return total[last] - total[first]

    vowel_table = np.zeros(0x80, bool)
    vowel_table[[ord(c) for c in "aeiouy"]] = True
    far = letter & (cp >= 0x370)
    accented = letter & (cp >= 0xC0) & (cp < 0x370)
    vowels = within((vowel_table[np.minimum(low, 0x7F)] & (low < 0x80)) | accented)
    upper, plain, foreign = within(low != cp), within(ascii_letter), within(far)
    before, after = np.maximum(first - 1, 0), np.minimum(last, n - 1)
    opens, closes = (first == 0) | np.isin(first, inner), (last == n) | np.isin(last, inner)  # at an edge of their text
    beside_digit = (~opens & digit[before]) | (~closes & digit[after])
    command = ~opens & (cp[before] == 0x5C)
    latin = (size >= 2) & (size <= 30) & (vowels * 8 >= size) & (plain * 2 >= size) & ((upper == 0) | ((upper == 1) & (cp[first] != low[first]))) & ~beside_digit
    readable = np.where(foreign * 2 >= size, size, np.where(latin & ~command, size, 0))

    code = np.zeros(len(first), np.uint64)
    short = size <= 5
    for k in range(5):
        code |= np.where(short & (size > k), low[np.minimum(first + k, n - 1)].astype(np.uint64) << np.uint64(12 * k), np.uint64(0))
    common_codes = _pack(" ".join(COMMON.values()).split())
    at = np.minimum(np.searchsorted(common_codes, code), len(common_codes) - 1)
    # Letters that do not fit the code are in no common word.
    common = short & (foreign == 0) & (common_codes[at] == code)

    # Lines: up to a line feed or the end of a text.
    line_edge = np.zeros(n, bool)
    line_edge[begins[begins < n]] = True
    feeds = np.flatnonzero(cp == 0x0A)
    line_edge[feeds[feeds + 1 < n] + 1] = True
    lines = np.flatnonzero(line_edge)
    ends = np.append(lines[1:], n)
    ink = ~space & (cp != 0xFEFF)
    n_ink = _sums(ink, lines, n)
    ink_at = np.flatnonzero(ink)
    if not len(ink_at):
        zero = {k: np.zeros(n_texts, np.int64) for k in names}
        return zero | {"n_chars": np.diff(begins)}
    near = np.searchsorted(ink_at, lines)
    head = ink_at[np.minimum(near, len(ink_at) - 1)]
    tail = ink_at[np.maximum(np.searchsorted(ink_at, ends) - 1, 0)]
    filled = n_ink > 0

    def at_head(k: int) -> np.ndarray:
        """The character k after a line's first, 0 beyond the line."""
        return np.where(head + k < ends, cp[np.minimum(head + k, n - 1)], 0)

    line_of_word = np.searchsorted(lines, first, "right") - 1
    r = np.bincount(line_of_word, readable, len(lines))
    marks = np.bincount(line_of_word, np.where(command, size + 1, 0), len(lines))
    # Cells: tabs, bars, ampersands, commas before no blank, and gaps of two blanks or more.
    blank = cp == 0x20
    nxt_ink = np.append(ink[1:], False)
    nxt_ink[inner - 1] = False
    gap = np.zeros(n, bool)
    gap[2:] = ink[2:] & blank[1:-1] & blank[:-2]
    gap[head] = False
    cell = (cp == 0x09) | (cp == 0x7C) | (cp == 0x26) | ((cp == 0x2C) & nxt_ink) | gap
    n_cells = _sums(cell, lines, n)
    odd_table = np.zeros(0x80, bool)
    odd_table[[ord(c) for c in "!\"#$'*;<=>?@[]^`{}~"]] = True
    odd = _sums(np.where(cp < 0x80, odd_table[np.minimum(cp, 0x7F)], ~letter & ink & (cp != 0x2212) & (cp != 0x2013)), lines, n)
    mojibake = _sums(accented, lines, n)

    c0, c1, c2, c3 = (at_head(k) for k in range(4))
    is_digit = lambda c: (c >= 0x30) & (c <= 0x39)
    is_alnum = lambda c: is_digit(c) | (((c | 0x20) >= 0x61) & ((c | 0x20) <= 0x7A))
    closing = lambda c: (c == 0x2E) | (c == 0x29)
    blank_or_end = lambda c: (c == 0x20) | (c == 0x09)
    marker = np.isin(c0, _BULLETS) & blank_or_end(c1)
    marker |= (c0 == 0x28) & is_alnum(c1) & ((c2 == 0x29) | (is_alnum(c2) & ((c3 == 0x29) | (is_alnum(c3) & (at_head(4) == 0x29)))))
    marker |= (c0 == 0x5B) & is_digit(c1) & ((c2 == 0x5D) | (is_digit(c2) & ((c3 == 0x5D) | (is_digit(c3) & (at_head(4) == 0x5D)))))
    marker |= is_alnum(c0) & closing(c1) & blank_or_end(c2) & (is_digit(c0) | (c0 >= 0x61))
    marker |= is_digit(c0) & is_digit(c1) & ((closing(c2) & blank_or_end(c3)) | (is_digit(c2) & closing(c3) & blank_or_end(at_head(4))))
    for name in ENTRY_COMMANDS:
        same = c0 == 0x5C
        for k, c in enumerate(name):
            same &= at_head(k + 1) == ord(c)
        follow = at_head(len(name) + 1) | 0x20
        marker |= same & ~((follow >= 0x61) & (follow <= 0x7A))
    is_letter = lambda c: ((c | 0x20) >= 0x61) & ((c | 0x20) <= 0x7A)
    markup = (c0 == 0x5C) & is_letter(c1) & is_letter(c2)

    body = np.maximum(n_ink - marks, 1)
    words_in, common_in = np.bincount(line_of_word[~command], minlength=len(lines)), np.bincount(line_of_word[common & ~command], minlength=len(lines))
    sentence = (words_in >= 6) & (common_in * 4 >= words_in)  # an entry that is a sentence is prose
    listed = filled & marker & (r >= 0.3 * body) & ~sentence
    tabled = filled & ~listed & (n_cells >= 1) & (odd <= 0.1 * n_ink + 1) & (r < 0.3 * body) & (mojibake <= 0.1 * n_ink)
    junk = filled & ~listed & ~tabled & ~markup & (r < 0.35 * body) & (n_ink >= 4)

    text_of_line = np.searchsorted(begins, lines, "right") - 1
    per_text = lambda w: np.bincount(text_of_line, w, n_texts).astype(np.int64)
    text_of_word = np.searchsorted(begins, first, "right") - 1
    is_word = ~command
    per_word = lambda w: np.bincount(text_of_word, w, n_texts).astype(np.int64)
    symbol = np.zeros(n + 1, np.int64)
    np.cumsum(ink & ~letter & ~digit, out=symbol[1:])
    return {
        "n_chars": np.diff(begins),
        "n_words": per_word(is_word),
        "word_chars": per_word(np.where(is_word, size, 0)),
        "symbols": symbol[begins[1:]] - symbol[begins[:-1]],
        "n_lines": per_text(filled),
        "stopped": per_text(filled & np.isin(cp[tail], _STOPS)),
        "n_common": per_word(common & is_word),
        "c_list": per_text(np.where(listed, n_ink, 0)),
        "c_table": per_text(np.where(tabled, n_ink, 0)),
        "c_junk": per_text(np.where(junk, n_ink, 0)),
        "c_all": per_text(n_ink),
    }


def statistics(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: doc_id, lang, n_chars, n_words and the STATISTICS (null for blank texts).

    word_length is the mean, symbol_ratio symbols to characters, punctuated the share of lines
    that end in punctuation, common the share of common words; listed, tabled and junk are the
    shares of visible characters in such lines, no_prose their sum.
    """
    names = ("n_chars", "n_words", "word_chars", "symbols", "n_lines", "stopped", "n_common", "c_list", "c_table", "c_junk", "c_all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, starts in slices(batch, text):
                m = measured(data, starts)
                own = [batch.column(c).slice(row, end - row) for c in (doc_id, lang)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(m[k]) for k in names]], names=["doc_id", "lang", *names])

    counts = documents.select(doc_id, text, lang).mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{k} long" for k in names))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.select(
        "doc_id", "lang", "n_chars", "n_words",
        share("word_chars", "n_words").alias("word_length"), share("symbols", "n_chars").alias("symbol_ratio"), share("stopped", "n_lines").alias("punctuated"),
        share("n_common", "n_words").alias("common"), share("c_list", "c_all").alias("listed"), share("c_table", "c_all").alias("tabled"), share("c_junk", "c_all").alias("junk"),
        F.when(F.col("c_all") > 0, (F.col("c_list") + F.col("c_table") + F.col("c_junk")) / F.col("c_all")).alias("no_prose"),
    )


def sketches(stats: DataFrame) -> DataFrame:
    """Per language, and over all (grouping 1), a mergeable quantile sketch of each statistic.

    A sketch has a fixed size whatever it has seen; map tasks send one a language.
    """
    own = stats.filter(F.col("no_prose").isNotNull())
    each = own.groupBy("lang").agg(F.count("*").alias("n_docs"), *[F.expr(f"kll_sketch_agg_double({s})").alias(s) for s in STATISTICS])
    each = written(each, "quality-sketches")
    merged = each.groupBy().agg(F.sum("n_docs").alias("n_docs"), *[F.kll_merge_agg_double(s).alias(s) for s in STATISTICS])
    return each.withColumn("pooled", F.lit(False)).unionByName(merged.withColumns({"pooled": F.lit(True), "lang": F.lit(None).cast("string")}))


def distributions(stats: DataFrame) -> DataFrame:
    """Quartiles and the 1st, 5th, 95th and 99th percentile of each statistic: lang, pooled, n_docs, statistic, q."""
    cuts = "array(0.01D, 0.05D, 0.25D, 0.5D, 0.75D, 0.95D, 0.99D)"
    each = F.array(*[F.struct(F.lit(s).alias("statistic"), F.expr(f"kll_sketch_get_quantile_double({s}, {cuts})").alias("q")) for s in STATISTICS])
    return sketches(stats).filter("n_docs > 0").select("lang", "pooled", "n_docs", F.explode(each).alias("e")).select("lang", "pooled", "n_docs", "e.*")


def scored(stats: DataFrame, among: DataFrame | None = None, least: int = 1) -> DataFrame:
    """The statistics with z_<name> (own language) and pz_<name> (all documents), robust z-scores.

    The distributions are those of ``among``, or of the statistics themselves; languages with fewer
    than ``least`` documents there have no scores of their own.
    A score is the distance from the median over the interquartile range scaled to a standard
    deviation; the range is held to at least 0.01 so that constant statistics do not divide by zero.
    """
    cuts = written(distributions(stats if among is None else among).filter(F.col("pooled") | (F.col("n_docs") >= least)), "quality-quantiles")
    wide = cuts.groupBy("lang", "pooled").pivot("statistic", list(STATISTICS)).agg(F.first("q"))
    if among is not None or least > 1:
        known = cuts.filter(~F.col("pooled")).select(F.col("lang").alias("q_lang")).distinct()
        others = stats.select("lang").distinct().join(known, F.col("lang").eqNullSafe(F.col("q_lang")), "left_anti")
        wide = wide.unionByName(others.withColumn("pooled", F.lit(False)), allowMissingColumns=True)
    # The pooled quantiles stand beside each language's, so that one join by language brings both.
    over_all = W.partitionBy(F.lit(0))
    q = wide.select("lang", "pooled", *[F.col(s).alias(f"q_{s}") for s in STATISTICS], *[F.max(F.when(F.col("pooled"), F.col(s))).over(over_all).alias(f"p_{s}") for s in STATISTICS])
    q = q.filter(~F.col("pooled")).drop("pooled").withColumnRenamed("lang", "q_lang")
    rows = stats.join(q, F.col("lang").eqNullSafe(F.col("q_lang")), "left").drop("q_lang")
    z = lambda s, p: (F.col(s) - F.col(f"{p}_{s}")[3]) / F.greatest((F.col(f"{p}_{s}")[4] - F.col(f"{p}_{s}")[2]) / 1.349, F.lit(0.01))
    rows = rows.withColumns({f"z_{s}": z(s, "q") for s in STATISTICS} | {f"pz_{s}": z(s, "p") for s in STATISTICS})
    return rows.drop(*[f"{p}_{s}" for p in "qp" for s in STATISTICS])


def tails(stats: DataFrame, *, most: float = 0.5, beyond: float = 3.0, least: int = 20) -> DataFrame:
    """Statistics in the tails: doc_id, lang, n_words, statistic, value, z, pz, one row a document and statistic.

    A value is in a tail where its robust z-score exceeds ``beyond`` on either side, among the prose of
    its language (z), or among all prose (pz) where its language has fewer than ``least`` documents of it.
    The distributions are those of the documents with a share of no prose up to ``most``: what is no
    prose doesn't move them, however much of it there is.
    """
    rows = scored(stats, stats.filter(F.col("no_prose") <= most), least)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value"), F.col(f"z_{s}").alias("z"), F.col(f"pz_{s}").alias("pz")) for s in STATISTICS]))
    return rows.select("doc_id", "lang", "n_words", each.alias("e")).select("doc_id", "lang", "n_words", "e.*").filter(F.abs(F.coalesce("z", "pz")) > beyond)


def no_prose(documents: DataFrame, *, most: float = 0.5, **columns: str) -> DataFrame:
    """Documents most of whose characters are no prose: doc_id, doc_kind (list, table or junk).

    The share itself decides, not its z-score: where a quarter of the documents or more are no
    prose, the quartiles lie among them and no document is in a tail.
    """
    flagged = statistics(documents, **columns).filter(F.col("no_prose") > most)
    kind = F.when((F.col("listed") >= F.col("tabled")) & (F.col("listed") >= F.col("junk")), "list").when(F.col("tabled") >= F.col("junk"), "table").otherwise("junk")
    return flagged.select("doc_id", kind.alias("doc_kind"))
