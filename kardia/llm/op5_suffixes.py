"""Repeated passages by sparse suffix arrays.

Of a document's suffixes (at word borders) only those at content-selected places
are retained: the minimisers, that is, in each window of ``WINDOW`` places the one
whose first ``SEED`` words hash lowest. Any passage of ``WINDOW + DEPTH - 1`` words holds a
whole window, so both its copies retain the suffix at the same word of it, followed by ``DEPTH``
more words of the passage.

1. Retained suffixes are compared at depth: their first ``DEPTH`` words, as a 64-bit hash.
   Suffixes alone at that depth, or in one document only, are dropped.
2. The rest are sorted by the words that follow and, apart, by the words that go before
   (backwards); the nearest of other documents in these orders have the longest common extensions. The matches
   are extended by them to the right and to the left, up to the next retained place.
3. Extended matches of a document are united; a united passage of at least ``LEAST`` words is
   reported with its place in the original text, and with the classes of its matches: where
   their words stand in the lowest document that holds them.

Words are those of :mod:`op3_decontaminate`: A-Z lower-cased, without punctuation. Everything
reported lies in matches of ``DEPTH`` words or more with another document, and every passage
of ``WINDOW + DEPTH - 1`` = 51 words that two documents share is found, and links the two by a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from kardia.llm.common import arrow_schema, bounded_batches, discard, documents, map_rows, materialise
from kardia.llm.op3_decontaminate import NORMAL
from kardia.llm.op12_windows import sliding_minima, text_bytes, words_in

SEED = 10  # words that decide which suffix is retained
WINDOW = 22  # neighbouring places of which one is retained, at least
DEPTH = 30  # words by which suffixes are first compared
LEAST = 50  # words of a reported passage
REACH = WINDOW - 1  # words of an extension; beyond them the next retained suffix goes on

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie behind each other in ``raw``, and the first word of each text (and the end); ``edges`` are the texts' borders in bytes."""
    return words_in(np.frombuffer(raw.tobytes().translate(NORMAL), np.uint8), edges)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words: a polynomial of their hashes modulo 2^64, put together from runs of 1, 2, 4 ... words, and mixed."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, done, power = np.zeros(m, np.uint64), 0, 1  # of the first words of each run; base to the number of words done
    part, size, step = hashes, 1, int(_BASE)  # runs of this size; base to that size
    while True:
        if n & size:
            out += part[done:done + m] * np.uint64(power)
            done, power = done + size, power * step % (1 << 64)
        if done == n:
            break
        part = part[:-size] + part[size:] * np.uint64(step)
        size, step = 2 * size, step * step % (1 << 64)
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ out >> np.uint64(29)


def retained(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the retained suffixes: the first lowest seed of each window; none in a text too short for a whole window. ``text`` numbers each word's text."""
    places = len(hashes) - DEPTH + 1
    if places < WINDOW:
        return np.zeros(0, np.int64)
    seeds, bits = run_hashes(hashes, SEED)[:places], np.uint64(places.bit_length())
    first = sliding_minima((seeds >> bits << bits) | np.arange(places, dtype=np.uint64), WINDOW) & np.uint64((1 << int(bits)) - 1)
    whole = text[:len(first)] == text[WINDOW + DEPTH - 2:]
    return np.unique(first[whole]).astype(np.int64)


def doc_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that order documents by id, and texts of one id by a hash."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (doc_id.bitwiseXOR(F.lit(-1 << 63)), F.xxhash64(text))]))


def suffixes(docs: DataFrame) -> DataFrame:
    """``(doc, at, depth_hash, back)`` of the retained suffixes of ``docs(doc, text)``; ``back`` words before is the text's first one with this hash."""
    bounded_batches(docs.sparkSession)
    schema = StructType.fromDDL("doc binary, at int, depth_hash long, back int")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, begins = word_hashes(*text_bytes(b.column("text")))
            text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            places = retained(words, text)
            deep, of = run_hashes(words, DEPTH)[places] if len(places) else np.zeros(0, np.uint64), text[places]
            order = np.lexsort((places, deep, of))  # equal ones of a text behind each other, the first one first
            fresh = np.ones(len(order), bool)
            fresh[1:] = (deep[order][1:] != deep[order][:-1]) | (of[order][1:] != of[order][:-1])
            back = np.empty(len(places), np.int64)
            back[order] = places[order] - places[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else 0
            cols = {"doc": b.column("doc").take(pa.array(of)), "at": pa.array(places - begins[of], pa.int32()), "depth_hash": pa.array(deep.view(np.int64)), "back": pa.array(back, pa.int32())}
            yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return docs.select("doc", "text").mapInArrow(run, schema)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First code point and end of each word of a text."""
    raw = text.encode("utf-8", "replace")
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]


def contexts(docs: DataFrame) -> DataFrame:
    """The words beside each shared suffix of ``docs(doc, text, shared)``: on its left backwards, on its right behind the depth.

    Of each suffix the sides that ``left`` and ``right`` ask for. A word is 32 bits of its hash. ``chars`` are the code points where the match begins (left) or ends
    (right) if it goes on by 0, 1, 2 ... words.
    """
    def run(cols):
        out = {c: [] for c in ("doc", "at", "side", "depth_hash", "first", "words", "chars")}
        for doc, text, shared in zip(cols["doc"], cols["text"], cols["shared"]):
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            h = word_hashes(raw, np.array([0, len(raw)]))[0].astype(np.uint32)
            starts, ends = word_places(text)
            n, numbers = len(h), h.tolist()
            # the words and steps of any run are slices of these
            behind, before = h.astype(">u4").tobytes(), h[::-1].astype(">u4").tobytes()
            width = "<u4" if n > 1 and max(np.diff(starts).max(), np.diff(ends).max()) > 0xFFFF else "<u2"
            size = int(width[2])
            to_left, to_right = np.diff(starts)[::-1].astype(width).tobytes(), np.diff(ends).astype(width).tobytes()
            starts, ends = starts.tolist(), ends.tolist()
            for s in shared:
                at = s["at"]
                low, end = max(0, at - REACH), at + DEPTH
                high = min(n, end + REACH)
                sides = []
                if s["left"]:
                    sides.append(("l", numbers[at - 1] if at else -1, before[4 * (n - at):4 * (n - low)],
                                  starts[at].to_bytes(8, "little") + to_left[size * (n - 1 - at):size * (n - 1 - low)]))
                if s["right"]:
                    sides.append(("r", numbers[end] if end < n else -1, behind[4 * end:4 * high],
                                  ends[end - 1].to_bytes(8, "little") + to_right[size * (end - 1):size * (high - 1)]))
                for side in sides:
                    for c, v in zip(out, (doc, at, side[0], s["depth_hash"], *side[1:])):
                        out[c].append(v)
        return out

    return map_rows(docs, run, "doc binary, at int, side string, depth_hash long, first long, words binary, chars binary")


def unpacked(chars: bytes, side: str, words: int, known: int) -> int:
    """Where a match that goes on by ``words`` words begins or ends, of ``known`` words: the first number, and the steps to the others in two bytes each, or
    in four where a text has longer ones."""
    steps = np.frombuffer(chars[8:], "<u2" if len(chars) - 8 == 2 * known else "<u4")[:words]
    return int.from_bytes(chars[:8], "little") + int(steps.sum()) * (-1 if side == "l" else 1)


def common_words(a: bytes, b: bytes) -> int:
    for i in range(0, min(len(a), len(b)), 4):
        if a[i:i + 4] != b[i:i + 4]:
            return i // 4
    return min(len(a), len(b)) // 4


def extensions(sides: DataFrame) -> DataFrame:
    """``(doc, at, side, words, char)``: by how many words each suffix's match goes on, on either side, and to where.

    Contexts are dealt by suffix, side and first word, for others have nothing in common, and
    sorted. Each is compared with the nearest one of another document on either side as they stream
    by: what it has in common with it is the least of what the neighbours between have in common.
    Only neighbours of one document are held, which are no more than its places.
    """
    tasks = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = sides.repartition(tasks, "depth_hash", "side", "first").sortWithinPartitions("depth_hash", "side", "words", "doc", "at")
    schema = StructType.fromDDL("doc binary, at int, side string, words int, char long")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # the last rows, all of one document: which row of another one follows is not known yet
        for b in batches:
            cols, done = b.to_pydict(), []
            for doc, at, side, deep, words, chars in zip(*(cols[c] for c in ("doc", "at", "side", "depth_hash", "words", "chars"))):
                row = [doc, at, side, 0, words, chars, 0, deep]  # at 3 words common with the nearest row of another document, at 6 with the row before
                if held:
                    last = held[-1]
                    near = last[7] == deep and last[2] == side
                    n = common_words(last[4], words) if near else 0
                    if near and last[0] == doc:
                        row[3], row[6] = min(n, last[3]), n
                    else:
                        row[3] = n
                        done += settled(held, n)
                        held = []
                held.append(row)
            yield finished(done)
        yield finished(settled(held, 0))

    def settled(rows: list[list], n: int) -> list[list]:
        """Rows of one document, of which the last has n words in common with the row of another document that follows."""
        for row in reversed(rows):
            row[3] = max(row[3], n)
            n = min(n, row[6])
        return rows

    def finished(rows: list[list]) -> pa.RecordBatch:
        doc, at, side, words = ([r[i] for r in rows] for i in range(4))
        char = [unpacked(r[5], r[2], r[3], len(r[4]) // 4) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((doc, at, side, words, char), arrow)], schema=arrow)

    return lined.mapInArrow(run, schema)


def sides_needed(found: DataFrame) -> DataFrame:
    """``found`` with ``left`` and ``right``: is the suffix to be extended there?

    Where the shared suffix before begins within ``DEPTH`` words and is of the same class, an extension to the left adds nothing: it
    either ends inside that suffix's words, or its partner holds these, too, and is found there. Likewise to the right. What is needed in one document
    is needed in all that hold the suffix, for it is compared with them."""
    by = Window.partitionBy("doc").orderBy("at")  # a document's shared suffixes: bounded by its text
    shift = F.col("place") - F.col("at")

    def goes_on(other):
        return F.coalesce((F.abs(other("at") - F.col("at")) <= DEPTH) & (other("lowest") == F.col("lowest")) & (other("shift") == F.col("shift")), F.lit(False))

    own = found.withColumn("shift", shift)
    own = own.select("*", (~goes_on(lambda c: F.lag(c).over(by))).alias("head"), (~goes_on(lambda c: F.lead(c).over(by))).alias("tail")).drop("shift")
    own = materialise(own, "suffixes-own")
    asked = materialise(own.groupBy("depth_hash").agg(F.max("head").alias("left"), F.max("tail").alias("right")).where("left OR right"), "suffixes-asked")
    return own.drop("head", "tail").join(asked, "depth_hash", "left").fillna(False, ["left", "right"])


def id_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "big") - (1 << 63)


def united(matches: list[tuple]) -> list[tuple]:
    """(first word, end, first char, end, partner, matches) of ``(first word, end, first char, end, partner, at, class_doc, class_at)``.

    Matches that overlap or touch are united; the smallest partner stays.
    """
    out: list[tuple] = []
    for m in sorted(matches):
        a, b, start, end, partner = m[:5]
        if out and a <= out[-1][1]:
            a0, b0, start0, end0, partner0, own = out[-1]
            own.append(m)
            out[-1] = (a0, max(b, b0), min(start, start0), max(end, end0), min(partner, partner0), own)
        else:
            out.append((a, b, start, end, partner, [m]))
    return out


def classes(matches: list[tuple]) -> list[dict]:
    """The runs of a passage's matches whose words stand one after the other in the lowest document that holds them.

    A run that repeats itself within ``DEPTH`` words counts once.
    """
    runs: dict[int, list] = {}  # of each class document, the last run: the dict, and the last match's place here and there
    out = []
    for _, _, start, end, _, at, doc, place in sorted(matches, key=lambda m: m[5]):
        run, at0, place0 = runs.get(doc, (None, 0, 0))
        if run is not None and at - at0 <= DEPTH and place - place0 in (0, at - at0):
            run["class_words"] = place + DEPTH - run["class_at"]
            run["start"], run["end"] = min(start, run["start"]), max(end, run["end"])
        else:
            run = {"class_doc": doc, "class_at": place, "class_words": DEPTH, "start": start, "end": end}
            out.append(run)
        runs[doc] = (run, at, place)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, start, end, n_words, partner_id, classes)``: passages that a document shares with another one, in code points.

    ``partner_id`` is the smallest id of another document with a part of the
    passage. A passage may join texts that are shared with different documents; ``classes`` lists
    them. Words ``class_at`` to ``class_at + class_words`` of ``class_doc``, the lowest document that holds
    them (possibly this one), stand in this document, between ``start`` and ``end``, which
    are as far as its matches go with any document. Two documents share the words at which their
    classes of one ``class_doc`` overlap, so every link can be rebuilt from these rows without pairs. Null, empty and short texts have none. Rows without an id take no part. Different texts of
    one id are documents of their own, which may be each other's partners; equal rows are one. A class document is named by its id, and is the
    text of least hash where several texts of that id hold the words.
    """
    bounded_batches(docs.sparkSession)
    rows = documents(docs, id_col, text_col).where("doc_id IS NOT NULL")
    rows = rows.select(doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    kept = materialise(suffixes(rows).distinct(), "suffixes")  # equal rows are one document
    # written, so that the join below has plain exchanges on both sides and a passage that very many documents share can be split
    shared = materialise(kept.groupBy("depth_hash").agg(F.min("doc").alias("lowest"), F.max("doc").alias("highest"), F.min_by(F.col("at") - F.col("back"), "doc").alias("place")).where("lowest < highest"), "suffixes-common")
    found = materialise(sides_needed(kept.join(shared, "depth_hash")), "suffixes-shared")
    discard(kept, shared)
    asked = found.where("left OR right").select("doc", F.struct("at", "depth_hash", "left", "right").alias("s")).groupBy("doc").agg(F.collect_list("s").alias("shared"))
    texts = rows.join(asked, "doc").groupBy("doc").agg(F.first("text").alias("text"), F.first("shared").alias("shared"))
    longer = extensions(contexts(texts))
    other = F.when(F.col("lowest") < F.col("doc"), F.col("lowest")).otherwise(F.col("highest"))
    parts = longer.withColumn("partner", F.lit(None).cast("binary")).unionByName(found.select("doc", "at", other.alias("partner"), "lowest", "place"), allowMissingColumns=True)
    per_doc = parts.groupBy("doc").agg(F.collect_list(F.struct("at", "side", "words", "char", "partner", "lowest", "place")).alias("parts"))
    nowhere = {"l": {"words": 0, "char": 1 << 62}, "r": {"words": 0, "char": -1}}  # a side that another suffix of the run answers for

    def run(cols):
        out = []
        for doc, parts in zip(cols["doc"], cols["parts"]):
            matches = []
            for at, own in groupby(sorted(parts, key=lambda p: p["at"]), key=lambda p: p["at"]):
                own = list(own)
                side = nowhere | {p["side"]: p for p in own if p["side"]}
                partner, lowest, place = min((p["partner"], p["lowest"], p["place"]) for p in own if p["partner"] is not None)
                matches.append((at - side["l"]["words"], at + DEPTH + side["r"]["words"], side["l"]["char"], side["r"]["char"], id_of(partner), at, id_of(lowest), place))
            out += [{"doc_id": id_of(doc), "start": start, "end": end, "n_words": b - a, "partner_id": partner, "classes": classes(own)}
                    for a, b, start, end, partner, own in united(matches) if b - a >= least]
        return out

    return map_rows(per_doc, run, "doc_id long, start long, end long, n_words long, partner_id long, "
                    "classes array<struct<class_doc:long,class_at:int,class_words:int,start:long,end:long>>")
