"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found with bit-sliced position indexes.

**Index.** For a block of words, a bitset per (position, letter) says which words have that letter there, and one
per length which words have that length. **Search.** A word is read letter by letter; four bitsets say which words of the
block agree with what has been read so far: with no error, with one letter replaced, with one more letter (their positions
are shifted by one), and with one less. Each letter updates all four at once, 64 words in each operation, and for many
words of one length side by side. What is left at the end, at the right lengths, is near.

**Where to look.** Of two near words, one half is the same in both: the first ``m // 2`` letters or, seen from the end, the
last ``m // 2``, where ``m`` is the shorter length. So words meet in groups of (m, side, half), a word in four of them.
A group's halves are equal, so it holds as many words as there are endings of about ``m / 2`` letters: bounded for short words,
sparse for long ones. Large groups are split in blocks of about ``BLOCK`` words, and each block is searched for the words of
each, so a task holds two blocks, and no pair of words that aren't near is ever a row. A pair that agrees in both halves is
counted on the first side only.

**Roots.** A word's form is its near word of largest count, if that is at least twice its own. Following forms doubles
the count at each step, so pointer doubling settles in a few rounds of joins, each written to the shared folder.

A null text has no runs. A null id reads as the empty text in the checksum, and its rows count like any others; so do equal rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kardia.llm.common import documents, map_rows, materialise

LEAST_LETTERS = 5
LEAST_COUNT = 3
TYPO_EVERY = 97  # of the checksums, one in so many deletes a letter
BLOCK = 4096  # words of a block, on average, at most
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES_AT_ONCE = 1 << 22  # bytes of one bitset of all the words read side by side


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all runs of letters, with the deletions that the checksum of id and run decides."""
    runs = documents(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(h % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


class PositionIndex:
    """Bitsets over a block of words: which have a letter at a position, and which have a length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.row_bytes = -(-len(words) // 64) * 8
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.longest = int(lengths.max(initial=0))
        letters = np.zeros((len(words), self.longest), np.uint32)  # 0 behind a word's end
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            letters[at, :n] = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        self.sets = {(p, int(c)): self._bits(letters[:, p] == c) for p in range(self.longest) for c in np.unique(letters[:, p]) if c}
        self.of_length = {int(n): self._bits(lengths == n) for n in np.unique(lengths)}
        self.none = np.zeros(self.row_bytes // 8, np.uint64)

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.row_bytes, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all near pairs, for queries of one length."""
        m = len(queries[0])
        read = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32).reshape(len(queries), m)
        shape = (len(queries), self.row_bytes // 8)
        same = np.full(shape, ~np.uint64(0))
        replaced, more, less = np.zeros((3, *shape), np.uint64)

        def having(p: int, column: np.ndarray) -> np.ndarray:
            letters, which = np.unique(column, return_inverse=True)
            return np.stack([self.sets.get((p, int(c)), self.none) for c in letters])[which]

        for p in range(m):
            here, ahead = having(p, read[:, p]), having(p + 1, read[:, p])
            behind = having(p - 1, read[:, p]) if p else np.zeros(shape, np.uint64)
            less = less & behind | same  # this letter is missing in the word, or one before was
            more = (more | same) & ahead  # the word has one more letter before this one
            replaced = replaced & here | same & ~here
            same &= here
        at = lambda n: self.of_length.get(n, self.none)
        found = replaced & at(m) | (more | same) & at(m + 1) | less & at(m - 1)
        bits = np.unpackbits(found.view(np.uint8), axis=1, count=len(self.words), bitorder="little")
        return np.nonzero(bits)


def halves_of(word: F.Column) -> F.Column:
    """The groups of a word: for itself as the shorter one and as the longer one, the first and the last half."""
    def of(m):
        return [F.struct(m.alias("m"), F.lit(side).alias("side"), cut.alias("half"))
                for side, cut in ((0, F.substring(word, F.lit(1), F.floor(m / 2).cast("int"))), (1, F.right(word, F.floor(m / 2).cast("int"))))]
    n = F.char_length(word)
    return F.array(*of(n), *of(n - 1))


def blocks(vocab: DataFrame, block: int) -> DataFrame:
    """``(m, side, searched, read)``: two blocks of a group each, as arrays of (word, n); every block of a group meets every one."""
    rows = vocab.select("word", "n", F.inline(halves_of(F.col("word"))))
    sizes = rows.groupBy("m", "side", "half").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, ["m", "side", "half"]).withColumn("parts", F.ceil(F.col("size") / block))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    visits = F.concat(F.transform(others, lambda o: F.struct(F.col("own").alias("a"), o.alias("b"), F.lit(True).alias("index"))),
                      F.transform(others, lambda o: F.struct(o.alias("a"), F.col("own").alias("b"), F.lit(False).alias("index"))))
    seen = rows.select("m", "side", "half", F.struct("word", "n").alias("entry"), F.inline(visits))
    of = lambda index: F.collect_list(F.when(F.col("index") == index, F.col("entry")))  # noqa: E731 - null for the other kind, which the list leaves out
    return seen.groupBy("m", "side", "half", "a", "b").agg(of(True).alias("searched"), of(False).alias("read")).select("m", "side", "searched", "read")


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, form, form_n)`` of the words of ``vocab(word, n)`` that have near ones; form is the one of largest n, the smallest of them."""
    def run(cols):
        out = {c: [] for c in ("word", "n_near", "form_n", "form")}
        for m, side, searched, read in zip(cols["m"], cols["side"], cols["searched"], cols["read"]):
            index = PositionIndex([e["word"] for e in searched])
            for length in (m, m + 1):
                queries = [e["word"] for e in read if len(e["word"]) == length]
                step = max(1, QUERIES_AT_ONCE // max(1, index.row_bytes))
                for s in range(0, len(queries), step):
                    some = queries[s:s + step]
                    best: dict[str, list] = {}
                    for q, w in zip(*(x.tolist() for x in index.near(some))):
                        query, entry = some[q], searched[w]
                        if min(len(query), len(entry["word"])) != m or side and query[:m // 2] == entry["word"][:m // 2]:
                            continue  # a pair of another group, or of this one's first side
                        rank = (-entry["n"], entry["word"])
                        got = best.setdefault(query, [0, rank])
                        got[0] += 1
                        got[1] = min(got[1], rank)
                    for query, (count, (n, form)) in best.items():
                        for c, v in zip(out, (query, count, -n, form)):
                            out[c].append(v)
        return out

    found = map_rows(blocks(vocab, block), run, "word string, n_near long, form_n long, form string", rows=64)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: where following the forms ends. Each round follows twice as many as the one before."""
    state = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialise(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``vocab(word, n)``; no words give no rows."""
    vocab = materialise(vocab.select("word", "n"), "variant-words")
    near = materialise(near_words(vocab, block), "variant-near")
    known = F.col("form_n") >= 2 * F.col("n")
    judged = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                    F.when(known, F.col("form")).alias("form"), F.when(known, F.col("form_n")).alias("form_n"))
    judged = materialise(judged, "variant-forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
