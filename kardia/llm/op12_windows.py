"""Removal of words in windows that occur more than once, found by level-wise doubling.

A window is ``length`` consecutive words of a document, ``[^\\x20\\x09-\\x0D]+``, unchanged. A window can only
repeat if the windows inside it do. So lengths are tried from a quarter (``base``) over the half to the whole, each at most
twice the one before, and only windows that repeat at one length are extended to the next:

1. **Quarter.** Of a whole window, its *anchor* is the quarter window of lowest hash (the first such). Equal windows have equal
   anchors at the same place, so quarters that aren't anchors needn't be counted. Neighbouring
   windows with one anchor form a *span*, a row with its place, its hash and those of its quarter and halves.
   Quarters that occur once end here, and with them all windows of their spans.
2. **Half.** Equal spans are one from here on. A span that occurs twice is repeated as a whole. The others, and what they meet, are
   extended from the quarter to the half that holds it, forwards or backwards; halves in one distinct span end here.
3. **Whole.** The windows of the spans left are compared by themselves, 128 bits of hash each. Where none is left at a length, the
   later ones have nothing to do. Longer windows aren't tried: they cover no word that these don't.

Words of repeated windows are dropped, as judged on the input. Every count is an aggregate that combines on the map side, every look-up
an equi-join of spans with distinct hashes, so a passage that a third of the documents hold is one distinct span, and
its members are rows that a skewed join may split. Documents are told apart by id and text: rows of one id and different texts
are judged each by itself, and equal rows repeat each other. A null text has no words; a null id is an id like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from kardia.llm.common import arrow_schema, bounded_batches, discard, documents, map_rows, materialise

LENGTH = 35  # words of a window
SLICE = 1 << 18  # words, and bytes times 4, that are hashed at a time; bounds a worker's memory on long texts

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2^64
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
_SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of a base modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Runs:
    """Hashes of runs of a number array: a polynomial modulo 2^64, mixed with the length."""

    def __init__(self, numbers: np.ndarray, base: int = _BASES[0]):
        n = 1 << max(10, len(numbers).bit_length())  # few sizes, so that the powers are kept
        self.inverse = powers(pow(base, -1, 1 << 64), n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers * powers(base, n)[:len(numbers)])))

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        h = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts] + np.asarray(lengths).astype(np.uint64) * _MIX
        for _ in range(2):
            h = (h ^ h >> np.uint64(32)) * _MIX
        return h ^ h >> np.uint64(29)


def words_in(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie behind each other in ``raw``, and the first word of each text (and the end); ``edges`` are the texts' borders in bytes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SEPARATES[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    full = edges[:-1][edges[:-1] < edges[1:]]  # borders of texts that aren't empty
    first[full] |= inside[1:-1][full]
    before = full[full > 0] - 1
    last[before] |= inside[1:-1][before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # some bytes at a time, whole words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 4 * SLICE, "right")))
        low = starts[at]
        out[at:to] = Runs(_BYTES[raw[low:ends[to - 1]]]).hashes(starts[at:to] - low, ends[at:to] - starts[at:to])
        at = to
    return out, np.searchsorted(starts, edges)


def sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` numbers, from runs of 1, 2, 4 ... numbers."""
    size, out = 1, x
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[:len(x) - width + 1], out[width - size:][:len(x) - width + 1])


def spans_in(words: np.ndarray, text: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Spans of word hashes; ``text`` numbers each word's text. ``off`` is how far the anchor lies behind the first window, 0 hashes are those not needed."""
    base, half = -(-length // 4), -(-length // 2)
    runs = Runs(words)
    n = len(words) - length + 1
    whole = text[:n] == text[length - 1:]
    bits = np.uint64(len(words).bit_length())
    low = runs.hashes(np.arange(len(words) - base + 1), base)
    ordered = (low >> bits << bits) | np.arange(len(low), dtype=np.uint64)
    anchor = (sliding_minima(ordered, length - base + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    same = (anchor[1:] == anchor[:-1]) & whole[1:] & whole[:-1] & (text[1:n] == text[:n - 1])
    first = np.flatnonzero(whole & ~np.concatenate(([False], same)))
    n_win = np.flatnonzero(whole & ~np.concatenate((same, [False]))) - first + 1
    at = anchor[first]
    off = at - first
    ahead, back = off - n_win + 1 <= length - half, off > length - half
    forwards, backwards = np.zeros((2, len(first)), np.uint64)
    forwards[ahead] = runs.hashes(at[ahead], half)
    backwards[back] = runs.hashes(at[back] + base - half, half)
    return {"first": first, "n_win": n_win, "off": off, "quarter": low[at], "span": runs.hashes(first, n_win + length - 1), "forwards": forwards, "backwards": backwards}


_SPANS = StructType([StructField(c, IntegerType() if c in ("at", "n_win", "off") else LongType())
                     for c in ("k1", "k2", "at", "n_win", "off", "quarter", "span", "forwards", "backwards")])


def spans(docs: DataFrame, length: int) -> DataFrame:
    """Spans of ``docs(k1, k2, text)``, ``at`` in words from the text's beginning."""
    bounded_batches(docs.sparkSession)
    arrow = arrow_schema(_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, edges = text_bytes(b.column("text"))
            words, begins = words_in(raw, edges)
            text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            keys = {k: b.column(k).to_numpy() for k in ("k1", "k2")}
            for s in range(0, len(words) - length + 1, SLICE):
                part = slice(s, s + SLICE + length - 1)
                found = spans_in(words[part], text[part], length)
                of = text[s + found["first"]]
                cols = {"k1": keys["k1"][of], "k2": keys["k2"][of], "at": s + found["first"] - begins[of],
                        **{c: found[c] for c in ("n_win", "off")}, **{c: found[c].view(np.int64) for c in ("quarter", "span", "forwards", "backwards")}}
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return docs.select("k1", "k2", "text").mapInArrow(run, _SPANS)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, one behind the other, and the texts' borders."""
    column = column.cast(pa.large_string())
    _, borders, data = column.buffers()
    at = np.frombuffer(borders, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def distinct_spans(counted: DataFrame) -> DataFrame:
    """One row for equal spans, with their number ``n`` and the place of one of them."""
    rest = [c for c in _SPANS.names if c not in ("quarter", "span")]
    return counted.groupBy("quarter", "span").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in rest])


def met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key several rows share, one of them a span that occurs once (all others are known to repeat)."""
    several = rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1")
    return rows.join(several.select(*keys), keys, "left_semi")


def halves(distinct: DataFrame) -> DataFrame:
    """Both extensions of the quarters that several distinct spans share: ``(quarter, span, n, k1, k2, at, n_win, off, forth, half)``."""
    ways = F.filter(F.array(*[F.struct(F.lit(forth).alias("forth"), F.col(c).alias("half")) for forth, c in ((True, "forwards"), (False, "backwards"))]), lambda w: w["half"] != 0)
    return met(distinct, ["quarter"]).select("quarter", "span", "n", "k1", "k2", "at", "n_win", "off", F.inline(ways))


def whole_windows(left: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``(w1, w2, quarter, span, n, k1, k2, at)`` of the windows of the spans left, hashed from their documents' texts."""
    half = -(-length // 2)
    per_doc = left.groupBy("k1", "k2").agg(F.collect_list(F.struct("quarter", "span", "n", "at", "n_win", "off", "forth")).alias("spans"))

    def run(cols):
        out = {c: [] for c in ("w1", "w2", "quarter", "span", "n", "k1", "k2", "at")}
        for k1, k2, text, found in zip(cols["k1"], cols["k2"], cols["text"], cols["spans"]):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            words, _ = words_in(raw, np.array([0, len(raw)]))
            hashes = [Runs(words, base) for base in _BASES]
            for s in found:
                at = s["at"] + np.arange(s["n_win"])
                # a window is extended forwards if the half behind its anchor lies in it
                at = at[(s["off"] + s["at"] - at <= length - half) == s["forth"]]
                out["w1"] += hashes[0].hashes(at, length).view(np.int64).tolist()
                out["w2"] += hashes[1].hashes(at, length).view(np.int64).tolist()
                out["at"] += at.tolist()
                for c, v in (("quarter", s["quarter"]), ("span", s["span"]), ("n", s["n"]), ("k1", k1), ("k2", k2)):
                    out[c] += [v] * len(at)
        return out

    joined = docs.join(per_doc, ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "spans")
    windows = map_rows(joined, run, "w1 long, w2 long, quarter long, span long, n long, k1 long, k2 long, at int")
    return windows.distinct()  # equal rows of a document have been read several times


def keyed(docs: DataFrame) -> DataFrame:
    """``(k1, k2, doc_id, text)``; the keys are 128 bits of id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(12), "text", "doc_id").alias("k2"), "doc_id", "text")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(k1, k2, at, n_win)`` of ``docs(k1, k2, doc_id, text)``: each of the ``n_win`` windows from word ``at`` on occurs elsewhere, too."""
    every = materialise(spans(docs, length), "window-spans")
    # a written look-up side lets Spark split a skewed quarter's rows on the other
    again = materialise(every.groupBy("quarter").agg(F.count("*").alias("c")).where("c > 1").select("quarter"), "window-again")
    found = materialise(every.join(again, "quarter", "left_semi"), "window-quarters")
    discard(every, again)
    distinct = materialise(distinct_spans(found), "window-distinct")
    left = materialise(met(halves(distinct), ["forth", "half"]), "window-halves")
    whole = found.join(distinct.where("n > 1").select("quarter", "span"), ["quarter", "span"], "left_semi").select("k1", "k2", "at", "n_win")
    single = met(whole_windows(left, docs, length), ["w1", "w2"]).where("n = 1").select("k1", "k2", "at", F.lit(1).alias("n_win"))
    return whole.union(single).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept)`` for each row: runs of removed words (first, end), and the kept words joined by one space."""
    if length < 1:
        raise ValueError("a window has one word at least")
    docs = keyed(documents(docs, id_col, text_col))
    # words covered by the windows of one document: bounded by its text
    marks = repeated_windows(docs, length).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n_win")).alias("marks"))

    def run(cols):
        out = {c: [] for c in ("doc_id", "n_words", "n_removed", "removed", "kept")}
        for doc_id, text, found in zip(cols["doc_id"], cols["text"], cols["marks"]):
            words = text.encode("utf-8").split()  # at the separators named above
            step = np.zeros(len(words) + 1, np.int64)
            for m in found or []:
                step[m["at"]] += 1
                step[m["at"] + m["n_win"] + length - 1] -= 1
            gone = np.concatenate(([False], np.cumsum(step)[:-1] > 0, [False]))
            turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["removed"].append([{"first": a, "end": b} for a, b in zip(turns[::2], turns[1::2])])
            ends = [0, *turns, len(words)]
            out["kept"].append(b" ".join(w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]).decode("utf-8"))
        return out

    joined = docs.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks")
    return map_rows(joined, run, "doc_id long, n_words long, n_removed long, removed array<struct<first: int, end: int>>, kept string")
