"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits. Each
segment, padded with zeros to 23 bits, decodes to the index of its nearest Golay codeword;
a word one bit away decodes to one of at most six indices, which are the
fuzzy keys of the segment. Up to three differing bits fall on the segments so that
(pigeonhole) one of these holds, and each gives one kind of key:

* two segments are equal: both segments, exact;
* one segment is equal, another differs in one bit: the equal segment, exact,
  and an index of the other one;
* each segment differs in one bit: an index of each.

Words one bit apart have different parity, so only words of even parity
emit all their indices (probe) and words of odd parity just their own (index).
Equal keys are joined and each candidate's bits are counted, so no link is lost
and none is added. Copies share a fingerprint and enter the join as one row.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from kardia.llm.common import documents, map_rows, materialise
from kardia.llm.components import components
from kardia.llm.golay import codeword_index, near_indices

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
EXACT, ONE_OFF, ALL_OFF = 0, 3, 9  # first number of each kind of key
INDEX, PROBE, BOTH = 1, 2, 3


def simhash(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text: bits set in over half of its shingles' XXH64."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = zip(*(words[i:] for i in range(shingle_words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i:i + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row per document, the fingerprint as a signed long. Empty or null text: 0."""
    def run(cols):
        fps = np.array([simhash(t) for t in cols["text"]], np.uint64)
        return {"doc_id": cols["doc_id"], "fp": fps.view(np.int64)}

    return map_rows(documents(docs, id_col, text_col), run, "doc_id long, fp long")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, roles (index, probe or both) and positions in ``fps`` (int64) of all fuzzy keys."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [codeword_index(s) for s in seg]
    near = [near_indices(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    even = [np.bitwise_count(s) % 2 == 0 for s in seg]
    rows = np.arange(len(fps))
    keys, roles, at = [], [], []

    def put(kind: int, key: np.ndarray, role: int, row: np.ndarray) -> None:
        keys.append(key | (kind << 59))
        roles.append(np.full(len(key), role, np.int8))
        at.append(row)

    for kind, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        put(EXACT + kind, seg[x] << 22 | seg[y], BOTH, rows)
    for kind, (x, y) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        odd = ~even[y]
        put(ONE_OFF + kind, seg[x][odd] << 12 | own[y][odd], INDEX, rows[odd])
        probes = np.flatnonzero(even[y])
        many = np.repeat(probes, [len(near[y][i]) for i in probes])
        if len(probes):
            put(ONE_OFF + kind, seg[x][many] << 12 | np.concatenate([near[y][i] for i in probes]), PROBE, many)
    # all three differ in one bit, so all three parities differ: the parities of the index side are part of the key
    parity = even[1].astype(np.int64) * 2 + even[2]
    odd = ~even[0]
    put(ALL_OFF, (own[0][odd] << 24 | own[1][odd] << 12 | own[2][odd]) << 2 | parity[odd], INDEX, rows[odd])
    probes = np.flatnonzero(even[0])
    if len(probes):
        mixed = [(near[0][i][:, None, None] << 24 | near[1][i][None, :, None] << 12 | near[2][i][None, None, :]).ravel() << 2 | (3 - parity[i]) for i in probes]
        put(ALL_OFF, np.concatenate(mixed), PROBE, np.repeat(probes, [len(m) for m in mixed]))
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(at)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct links ``(u, v)``, u < v, between the distinct fingerprints ``fps(fp)`` within ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find links of up to {MAX_BITS} bits")

    def run(cols):
        f = np.array(cols["fp"], np.int64)
        key, role, at = fuzzy_keys(f) if len(f) else (f, f, f)
        return {"key": key, "role": role, "fp": f[at]}

    keys = map_rows(fps.select("fp"), run, "key long, role byte, fp long")
    probe = keys.where(F.col("role") >= PROBE).select("key", F.col("fp").alias("a"))
    index = keys.where(F.col("role") != PROBE).select("key", F.col("fp").alias("b"))
    near = (probe.key == index.key) & (probe.a != index.b) & (F.bit_count(probe.a.bitwiseXOR(index.b)) <= max_bits)
    return probe.join(index, near).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, first, root)`` of the distinct fingerprints of ``rows(doc_id, fp)``; ``root`` is the least one of its component, ``first`` its smallest id."""
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes, max_bits)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, its own
    included; rows without an id are linked but never name a component (null if
    no row of the component has an id). Repeated rows give repeated results.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash")
    rooted = _classes(rows, max_bits)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs``, as it is: that of the smallest id (null ids come last), of several texts of this id the one
    of least hash, of equal rows of both the least by its other columns.

    Components are those of the texts, so rows of one id whose texts differ too much for a link all stay. Extra columns may have any name.
    """
    def free(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    # 128 bits of id and text tell rows apart
    k1, k2 = F.xxhash64(docs[id_col], docs[text_col]), F.xxhash64(F.lit(7), docs[text_col], docs[id_col])
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(cols):
        fps = np.array([simhash(t) for t in cols["text"]], np.uint64)
        return {**{c: cols[c] for c in ("k1", "k2", "doc_id")}, "fp": fps.view(np.int64)}

    rows = materialise(map_rows(keyed, run, "k1 long, k2 long, doc_id long, fp long"), "simhash")
    rooted = _classes(rows, max_bits).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first")
    at, other = free("at"), free("other")
    kept = rows.join(rooted, "fp").groupBy("root").agg(first).select(F.col("first.k1").alias(at), F.col("first.k2").alias(other))
    found = docs.withColumns({at: k1, other: k2}).join(kept, [at, other], "left_semi")
    order = F.struct(*[F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))])
    row = free("row")
    return found.groupBy(at, other).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias(row)).select(*[F.col(row)[c].alias(c) for c in docs.columns])
