"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark.

Normal form: A-Z lower-cased, words are runs of ASCII letters and digits and of
everything beyond ASCII. Each item gives its windows of 13
consecutive words (a shorter item is one window); all windows together make one
automaton, which every document passes through once. Matches come back as word
ranges and, for reports, as code-point offsets in the original text.

The automaton is broadcast, so its size is bounded: the benchmark is taken in
groups of at most ``MAX_GROUP_BYTES`` of item text. A benchmark of one group, the
usual case, means one scan; a larger one is scanned once per group and the
results of a document are merged, so nothing is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import repeat

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from kardia.llm.common import documents, filter_texts, map_rows

WINDOW = 13
MAX_GROUP_BYTES = 1 << 20

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# lower-cases A-Z and turns each byte outside words into a space; bytes beyond ASCII belong to words
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[list[bytes]]:
    """All windows of ``size`` words; the whole of a shorter item; none without words."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield words[i:i + size]


class BenchmarkAutomaton:
    """Windows of benchmark items as one automaton over word numbers (0: a word of no item)."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            for w in windows(words_of(text or ""), size):
                key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w)
                owners[key] |= {item} - {None}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in owners.items():
            self.automaton.add_word(key, (len(key), found))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, ranges of hit words (disjoint, ascending, end exclusive) and the items found."""
        words = words_of(text)
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        if words and not self.empty:
            for last, (n, items) in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
                found |= items
                start, end = last + 1 - n, last + 1
                while ranges and ranges[-1][1] >= start:  # matches come by ascending end; a longer one may reach back over several
                    start = min(start, ranges.pop()[0])
                ranges.append((start, end))
        return len(words), ranges, found

    def spans(self, text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Word ranges as code-point offsets of the original text."""
        raw = text.encode("utf-8", "replace")
        places = [m.span() for m in WORD.finditer(raw.translate(NORMAL))] if ranges else []
        return [(len(raw[:places[a][0]].decode()), len(raw[:places[b - 1][1]].decode())) for a, b in ranges]


def contaminated(n_words: int, n_hit: int) -> bool:
    """At least a twentieth of the words is hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def benchmark_groups(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_bytes: int = MAX_GROUP_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """Benchmark rows in groups whose texts have at most ``max_bytes`` (a longer single item is a group)."""
    group, size = [], 0
    for row in benchmark.select(benchmark[id_col].cast("string").alias("i"), benchmark[text_col].alias("t")).toLocalIterator():
        n = len((row.t or "").encode())
        if group and size + n > max_bytes:
            yield group
            group, size = [], 0
        group.append((row.i, row.t))
        size += n
    yield group


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_spans array<struct<start:long,end:long>>"


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs``: words, hit words, items found, offsets of hit passages, verdict.

    A null text has no words. An empty benchmark hits nothing. A benchmark item
    without an id contaminates but is not listed. Repeated rows give repeated results.
    """
    rows = documents(docs, id_col, text_col)
    found = [_scan_group(rows, g) for g in benchmark_groups(benchmark, max_bytes=max_group_bytes)]
    if len(found) == 1:
        return found[0].drop("key", "ranges")
    # several groups: rows of one id and text have one result, counted so that repeated rows come back
    parts = reduce(DataFrame.unionAll, found).groupBy("doc_id", "key").agg(
        F.min("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), (F.count("*") / len(found)).cast("long").alias("copies"))

    def whole(cols):
        return [_result(d, n, merged([(r["start"], r["end"]) for r in ranges]), merged([(r["start"], r["end"]) for r in spans]), items, 0)
               for d, n, ranges, items, spans, copies in zip(*(cols[c] for c in ("doc_id", "n_words", "ranges", "items", "hit_spans", "copies"))) for _ in range(copies)]

    return map_rows(parts, whole, RESULT)


def _scan_group(rows: DataFrame, group: list) -> DataFrame:
    """:data:`RESULT` of one benchmark group, with the word ranges and a hash of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(group)
    schema = RESULT + ", ranges array<struct<start:long,end:long>>, key long"

    def run(cols):
        automaton = automaton_of(shared.value)
        out = []
        for doc_id, text, key in zip(cols["doc_id"], cols["text"], cols["key"]):
            n_words, ranges, items = automaton.scan(text)
            out.append(_result(doc_id, n_words, ranges, automaton.spans(text, ranges), items, key))
        return out

    return map_rows(rows.withColumn("key", F.xxhash64("text")), run, schema)


def _result(doc_id, n_words: int, ranges: list, spans: list, found, key: int) -> dict:
    n_hit = sum(b - a for a, b in ranges)
    items = sorted(found)
    pairs = lambda xs: [{"start": a, "end": b} for a, b in xs]
    return {"doc_id": doc_id, "n_words": n_words, "n_hit": n_hit, "n_items": len(items),
            "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
            "contaminated": contaminated(n_words, n_hit), "items": items,
            "hit_spans": pairs(spans), "ranges": pairs(ranges), "key": key}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _automaton(items: tuple) -> BenchmarkAutomaton:
    return BenchmarkAutomaton(list(items))


def automaton_of(group: list) -> BenchmarkAutomaton:
    """The automaton of a group, built once per worker process."""
    return _automaton(tuple(group))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, with all their columns."""
    groups = list(benchmark_groups(benchmark, max_bytes=max_group_bytes))
    if len(groups) > 1:
        bad = scan(docs.withColumn(id_col, F.xxhash64(text_col)), benchmark, id_col, text_col, max_group_bytes).where("contaminated")
        return docs.join(bad.select(F.col("doc_id").alias("_bad")).distinct(), F.xxhash64(docs[text_col]) == F.col("_bad"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(groups[0])

    def keep(texts: list[str]) -> list[bool]:
        automaton = automaton_of(shared.value)
        found = [automaton.scan(t) for t in texts]
        return [not contaminated(n, sum(b - a for a, b in ranges)) for n, ranges, _ in found]

    return filter_texts(docs, text_col, keep)
