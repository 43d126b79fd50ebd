"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text: each byte adds its gear value and shifts
what came before it by two bits, so a place's hash depends on the last 16 bytes only.
A chunk ends where the hash's top bits are zero; chunking is normalised, that is,
six bits must be zero before the normal size and only four after it, between a
least and a largest size. An insertion thus moves boundaries near it and no others.

The fingerprint is the set of chunk digests with the bytes that each stands for. The
likeness of a text to another is its containment: the share of its bytes whose
chunks are in the other's set.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from kardia.llm.common import arrow_schema, bounded_batches, documents

LEAST, NORMAL, LARGEST = 8, 32, 128  # bytes of a chunk
HARD, EASY = 26, 28  # the hash shifted by so many bits is zero at a boundary before and after the normal size
WINDOW = 16  # bytes that a hash depends on
FIRST_ID = -(1 << 63)  # the place of a null id


def _gear() -> np.ndarray:
    """256 values from the 32-bit xxHash of the byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 0x9E3779B1) for b in range(256)], np.uint32)


GEAR = _gear()


def boundaries(raws: list[bytes]) -> list[list[int]]:
    """The chunk ends of each byte string, the last one its length (none for an empty one)."""
    gap = b"\0" * WINDOW  # the texts stand in one array, apart, so that no hash reaches into the one before
    joined = np.frombuffer(gap + gap.join(raws) + gap, np.uint8)
    h = GEAR[joined]
    starts, at = [], WINDOW
    for r in raws:
        starts.append(at)
        h[at - WINDOW:at] = 0
        at += len(r) + WINDOW
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint32(2 * s)
    easy = np.flatnonzero((h >> np.uint32(EASY)) == 0)
    hard = easy[(h[easy] >> np.uint32(HARD)) == 0]
    # the end of the chunk that starts at each text's start and behind each easy place
    begin = np.union1d(np.array(starts, np.int64), easy + 1)
    far = np.int64(1 << 62)
    first_hard = np.append(hard, far)[np.searchsorted(hard, begin + LEAST - 1)]
    first_easy = np.append(easy, far)[np.searchsorted(easy, begin + NORMAL)]
    end = np.where(first_hard < begin + NORMAL, first_hard, np.where(first_easy < begin + LARGEST, first_easy, begin + LARGEST - 1)) + 1
    follow = np.searchsorted(begin, end)
    follow[begin[np.minimum(follow, len(begin) - 1)] != end] = -1  # behind a chunk of the largest size
    begin_l, end_l, follow_l, hard_l, easy_l = begin.tolist(), end.tolist(), follow.tolist(), hard.tolist(), easy.tolist()

    def next_end(at: int) -> int:
        i = bisect_left(hard_l, at + LEAST - 1)
        if i < len(hard_l) and hard_l[i] < at + NORMAL:
            return hard_l[i] + 1
        i = bisect_left(easy_l, at + NORMAL)
        return easy_l[i] + 1 if i < len(easy_l) and easy_l[i] < at + LARGEST else at + LARGEST

    out = []
    for start, r in zip(starts, raws):
        stop, ends = start + len(r), []
        at, k = start, bisect_left(begin_l, start)
        while at < stop:
            if k < 0:
                k = bisect_left(begin_l, at)
                if k == len(begin_l) or begin_l[k] != at:
                    k = -1
            at, k = (end_l[k], follow_l[k]) if k >= 0 else (next_end(at), -1)
            ends.append(min(at, stop) - start)
        out.append(ends)
    return out


def fingerprints(texts: list[str]) -> list[dict[int, int]]:
    """The bytes that each chunk digest stands for, of each text."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    out = []
    for raw, ends in zip(raws, boundaries(raws)):
        found: dict[int, int] = {}
        at = 0
        for end in ends:
            digest = xxhash.xxh32_intdigest(raw[at:end])
            found[digest] = found.get(digest, 0) + end - at
            at = end
        out.append(found)
    return out


def as_text(fingerprint: dict[int, int]) -> str:
    """Digests in hex, ascending, each with its bytes, joined by commas; empty for the empty text."""
    return ",".join([f"{d:08x}:{n}" for d, n in sorted(fingerprint.items())])


def from_text(text: str) -> dict[int, int]:
    return {int(d, 16): int(n) for d, _, n in (x.partition(":") for x in text.split(",") if x)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes that lie in chunks of b; an empty text is contained in an empty one only."""
    if not a:
        return float(not b)
    return sum(min(a[d], b[d]) for d in a.keys() & b.keys()) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text, and compare it with that and with the next document's.

    The next document is the one after it by id (of repeated ids, by text; null
    ids come first); after the last one comes the first. A null text is empty. A table of
    one row is its own next.

    Documents are dealt into ranges of ids and sorted there, in one shuffle; the
    first document of each range also goes to the range before it as a guest, so every
    row meets its neighbour in its own task.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).withColumn("place", F.coalesce("doc_id", F.lit(FIRST_ID)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * tasks  # several to a task, so that tasks are even without a sampling pass over the texts
    cuts = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first().q
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(np.int64), side="left"))

    # the first id of each range: as many pairs as there are ranges
    firsts = sorted((r.k, r.first) for r in rows.select(range_of("place").alias("k"), "place").groupBy("k").agg(F.min("place").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first of all goes to the last range

    @F.pandas_udf("array<int>")
    def seats(place: pd.Series) -> pd.Series:
        own = 2 * np.searchsorted(bounds, place.to_numpy(np.int64), side="left")
        return pd.Series([[o, 2 * before[p] + 1] if p in before else [o] for o, p in zip(own.tolist(), place.tolist())])

    dealt = rows.select("doc_id", "text", "place", F.explode(seats("place")).alias("seat"))
    dealt = dealt.select("doc_id", "text", "place", F.expr("seat div 2").alias("range"), (F.col("seat") % 2).alias("guest"))
    dealt = dealt.repartition(tasks, "range").sortWithinPartitions("range", "guest", "place", "text")
    bounded_batches(spark)
    schema = StructType.fromDDL(RESULT)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far, which waits for its next: range, id, text, fingerprint
        for b in batches:
            cols = b.select(["range", "guest", "doc_id", "text"]).to_pydict()
            line = [] if held is None else [held]
            line += zip(cols["range"], cols["guest"], cols["doc_id"], cols["text"], fingerprints(cols["text"]))
            pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[1] and x[0] == y[0]]
            changed = [edited(x[3], y[3]) for x, y in pairs]
            out = []
            for (x, y), text, fp in zip(pairs, changed, fingerprints(changed)):
                out.append({"doc_id": x[2], "n_chars": len(x[3]), "edited_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(),
                            "fingerprint": as_text(x[4]), "edited_fingerprint": as_text(fp),
                            "near_edited": containment(x[4], fp), "near_next": containment(x[4], y[4])})
            held = line[-1] if line else None
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema)
