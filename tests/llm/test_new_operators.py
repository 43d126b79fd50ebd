"""Operators 11 to 13 against plain versions, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kardia.llm import op11_merkle, op12_windows, op13_variants, queries

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- 11: merkle --------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    vals = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])


def plain_tree(nodes):
    """Root, and for each node its siblings, level by level, as (left, right)."""
    ways, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, p in enumerate(place):
            run = nodes[p // 3 * 3:p // 3 * 3 + 3]
            ways[n].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
            place[n] = p // 3
        nodes = [sha(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        made[s] = plain_tree([x[2] for x in trees[s]])
    root, tops = plain_tree([made[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, r), way in zip(trees[s], made[s][1]):
            odd = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2
            fold = leaf if odd else plain_leaf(r, r.text and r.text.replace("\n", ""))
            for left, right in way + top:
                fold = sha(left, fold, right)
            out.append((r.doc_id, leaf, made[s][0], root, sha(*[a + b for a, b in way + top]), fold, fold == root))
    return sorted(out, key=repr)


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_merkle_equals_plain_version(spark, levels, monkeypatch):
    """Blocks of 3 and 9 leaves make many rounds, blocks of 729 one."""
    monkeypatch.setattr(op11_merkle, "BLOCK_LEVELS", levels)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0" if levels == 1 else "true")
    assert rows_of(op11_merkle.tamper_test(docs), *MERKLE) == plain_manifest(docs.collect())


def test_merkle_edges(spark, edge_docs, no_docs, clashing):
    """Null columns, repeated rows (each a leaf of its own), one leaf alone, no rows, extra columns."""
    want = plain_manifest(edge_docs.collect())
    assert rows_of(op11_merkle.tamper_test(edge_docs), *MERKLE) == want
    assert rows_of(op11_merkle.tamper_test(clashing), *MERKLE) == want
    assert op11_merkle.tamper_test(no_docs).count() == 0
    one = edge_docs.where("doc_id = 8")
    assert rows_of(op11_merkle.tamper_test(one), *MERKLE) == plain_manifest(one.collect())
    (row,) = op11_merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.way == []


def test_merkle_finds_every_changed_text(spark):
    rows = op11_merkle.tamper_test(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (not changed)


def test_merkle_copies_of_one_row_are_spread(spark):
    """A third of all rows are one row; they lie in several ranges and in blocks of bounded size."""
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "'a' AS source", "'en' AS lang", "1L AS n_chars", "IF(id % 3 = 0, 'same', concat('t\\n', id)) AS text")
    ranks = op11_merkle.ranked(op11_merkle.leaves(docs).withColumnRenamed("leaf", "h"), ["doc_id", "h"])
    assert sorted(r["rank"] for r in ranks.select("rank").collect()) == list(range(3000))
    assert rows_of(op11_merkle.tamper_test(docs), *MERKLE) == plain_manifest(docs.collect())


# ---- 12: repeated windows ----------------------------------------------------

def plain_windows(rows, length):
    texts = [((r.text or "").encode().split(), r.doc_id) for r in rows]
    seen = Counter(tuple(w[i:i + length]) for w, _ in texts for i in range(len(w) - length + 1))
    out = []
    for w, doc_id in texts:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        runs = [(i, min(j for j in range(i, len(w) + 1) if j not in gone)) for i in sorted(gone) if i - 1 not in gone]
        out.append((doc_id, len(w), len(gone), runs, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def window_rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(x) for x in r.removed], r.kept) for r in df.collect()), key=repr)


def test_windows_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_windows(docs.collect(), 35)
    assert window_rows(op12_windows.remove_repeats(docs)) == want
    assert sum(r[2] > 0 for r in want) > 10
    got = rows_of(queries.op12_window_doubling(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(((d, n, g, sha(k)) for d, n, g, _, k in want), key=repr)


@pytest.mark.parametrize("length", [1, 2, 3, 8, 35])
def test_windows_on_random_texts(spark, length):
    """Few words, so that windows repeat in one text, overlap themselves, and share anchors with others."""
    rng = random.Random(length)
    pool = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(90)) for _ in range(6)]
    texts = []
    for i in range(60):
        cut = rng.choice(pool).split()
        a, n = rng.randrange(80), rng.randint(1, 60)
        own = [f"w{rng.randrange(1 << 30)}" for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(own + cut[a:a + n] + own[:3] + ["x"] * rng.randint(0, 40)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert window_rows(op12_windows.remove_repeats(docs, length)) == plain_windows(docs.collect(), length)


def test_windows_edges(spark, edge_docs, no_docs, clashing):
    """Null and empty texts, repeated rows, one id with two texts, no rows, extra columns."""
    base = edge_docs.unionByName(spark.createDataFrame([(7, " ".join(f"v{i}" for i in range(40)), "en", "s", 1), (70, " ".join(f"v{i}" for i in range(3, 44)), "en", "s", 1)], edge_docs.schema))
    want = plain_windows(base.collect(), 35)
    assert window_rows(op12_windows.remove_repeats(base)) == want
    assert {(r[0], r[2]) for r in want} >= {(7, 37), (70, 37)}
    assert window_rows(op12_windows.remove_repeats(clashing)) == plain_windows(edge_docs.collect(), 35)
    assert op12_windows.remove_repeats(no_docs).count() == 0


def test_window_spans_in_slices():
    """Spans cut at the slices' borders still hold each window once."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 60, 500, dtype=np.uint64)
    text = np.repeat([0, 1, 2], [30, 300, 170])
    for length in (1, 2, 5, 35):
        found = op12_windows.spans_in(words, text, length)
        places = sorted(int(i) for a, n in zip(found["first"], found["n_win"]) for i in range(a, a + n))
        assert places == [i for i in range(500 - length + 1) if text[i] == text[i + length - 1]]


# ---- 13: spelling variants ---------------------------------------------------

def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_vocabulary(rows):
    words = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    cuts = {}
    for w in words:  # near words leave the same letters somewhere
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            cuts.setdefault(k, set()).add(w)
    near = {w: set() for w in words}
    for group in cuts.values():
        for w in group:
            near[w] |= {v for v in group if v not in near[w] and plain_near(w, v)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_variants(plain_vocabulary(rows))
    assert rows_of(queries.op13_spelling_variants(spark, SF), *VARIANT) == want
    assert sum(r[1] is not None for r in want) > 20


@pytest.mark.parametrize("block", [3, 40, 4096])
def test_variants_of_dense_words(spark, block):
    """Words of few letters, lengths from 1 on, near each other in many ways; groups of one and of many blocks."""
    rng = random.Random(block)
    words = {"".join(rng.choice("abé" if rng.random() < 0.9 else "ÿ÷x") for _ in range(rng.randint(1, 9))): rng.randint(1, 60) for _ in range(500)}
    got = op13_variants.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4), block)
    assert rows_of(got, *VARIANT) == plain_variants(words)


def test_variants_follow_long_chains(spark):
    """Each form is twice as frequent and one letter on: eleven steps to the root."""
    chain = {"abcdefghijkl"[:i] + "zyxwvutsrqpo"[i:]: 2 ** i for i in range(13)}
    got = op13_variants.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))
    assert {r.root for r in got.collect()} == {"abcdefghijkl"}


def test_variants_edges(spark, edge_docs, no_docs, clashing):
    """Null ids and texts, repeated rows, no rows, extra columns."""
    want = plain_variants(plain_vocabulary(edge_docs.collect()))
    assert rows_of(op13_variants.variants(op13_variants.vocabulary(edge_docs)), *VARIANT) == want
    assert rows_of(op13_variants.variants(op13_variants.vocabulary(clashing)), *VARIANT) == want
    assert op13_variants.variants(op13_variants.vocabulary(no_docs)).count() == 0


def test_position_index_equals_brute_force():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    index = op13_variants.PositionIndex(words)
    for m in range(1, 8):
        queries_ = [w for w in words if len(w) == m]
        got = {(queries_[q], words[w]) for q, w in zip(*index.near(queries_))}
        assert got == {(q, w) for q in queries_ for w in words if plain_near(q, w)}
