"""Merkle manifest of a document table: one tree per source, and one tree over the sources' roots.

A leaf is the digest of a row's columns. In a source, leaves stand in ascending order of their id (null ids
first; rows of one id by their digests). While a tree has several nodes, each run of ``ARITY`` neighbours becomes
the digest of their digests.

1. Leaves are range-partitioned by source, id and digest; a leaf's rank is its place in its partition and the
   number of the source's leaves in the partitions before.
2. Ranks are written in digits of base ``ARITY``. ``BLOCK_LEVELS`` low digits are grouped away one after the other,
   the child nodes nested as structs; the first of these groupings deals rows by block, the others find them in place.
   A source of any size is thus many blocks of at most ``ARITY ** BLOCK_LEVELS`` leaves. Blocks are the leaves of the next round.
3. From the last round back to the first, a transform of the nested structs gives each child the siblings on its
   way to the root, and an explode emits it. Inside a block, proofs come without a join; whole blocks, one row in
   thousands, meet the way above them by their number.

A null id, source, language, count or text is a part of its leaf like any value (``-``). Equal rows are leaves of their own. An empty
table has no rows and no root. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kardia.llm.common import materialise

ARITY = 3
BLOCK_LEVELS = 6  # levels of a block: at most 729 leaves in one row
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<l: string, r: string>"


def encoded(c: Column) -> Column:
    """A value with its length in front, so that no two rows run together; null is ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(row[c]) for c in COLUMNS]), 256)


def tree_key(source: Column) -> Column:
    """Never null; null sources sort first, the others by their bytes."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(tree, doc_id, leaf, forged)``; ``forged`` is the leaf with ``tampered`` as its text, null where that is null or changes nothing."""
    row = {c: docs[c] for c in COLUMNS}
    leaf = leaf_digest(row)
    forged = F.when(tampered.isNotNull() & ~tampered.eqNullSafe(docs["text"]), leaf_digest(row | {"text": tampered})) if tampered is not None else F.lit(None).cast("string")
    return docs.select(tree_key(docs["source"]).alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("leaf"), forged.alias("forged"))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` from 0 and ``size`` in their tree, in ascending order of the columns.

    Rows equal in all of them are told apart by the number under which they were written, so that even many copies of one row are spread over ranges.
    """
    numbered = materialise(nodes.withColumn("line", F.monotonically_increasing_id()), "merkle-nodes")
    by = ["tree", *order, "line"]
    placed = materialise(numbered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()).drop("line"), "merkle-places")
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy("tree", part).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # a tree has as many rows here as the ranges it lies in
    before = counts.select("*", F.expr("sum(n) OVER (PARTITION BY tree ORDER BY part) - n").alias("before"), F.expr("sum(n) OVER (PARTITION BY tree)").alias("size")).drop("n")
    met = placed.withColumn("part", part).join(before, ["tree", "part"])
    return met.withColumn("rank", F.col("place") - F.col("first") + F.col("before")).drop("place", "first", "before", "part")


def digest_of(kids: Column) -> Column:
    return F.sha2(F.array_join(F.transform(kids, lambda k: k["h"]), ""), 256)


def roll_up(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes(tree, rank, size, node)`` -> blocks ``(tree, rank, size, node)``, ``node`` a struct with ``h`` and, nested, ``kids``.

    Each digit column is grouped away in turn. A tree that has come down to one node keeps it as it is.
    """
    digits = [F.expr(f"CAST(rank div {ARITY ** j} % {ARITY} AS INT)").alias(f"d{j}") for j in range(levels)]
    cur = nodes.select("tree", F.expr(f"rank div {ARITY ** levels}").alias("block"), "size", *digits, "node").repartition("tree", "block")
    for j in range(levels):
        keys = ["tree", "block", "size", *[f"d{i}" for i in range(levels - 1, j, -1)]]
        kids = cur.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), F.col("node.*")))).alias("kids"))
        alone = F.ceil(F.col("size") / ARITY ** j) == 1
        cur = kids.select(*keys, F.struct(F.when(alone, F.col("kids")[0]["h"]).otherwise(digest_of(F.col("kids"))).alias("h"), "kids").alias("node"))
    return cur.select("tree", F.col("block").alias("rank"), F.expr(f"(size + {ARITY ** levels - 1}) div {ARITY ** levels}").alias("size"), "node")


def ways_down(node: Column, way: Column, levels: int) -> Column:
    """The nodes ``levels`` below ``node`` as array of ``(node, way)``; a way lists the siblings to the left and right at each level, the lowest first."""
    def below(above: Column) -> Column:
        parent, kids = above["node"], above["node"]["kids"]

        def child(kid: Column, at: Column) -> Column:
            hashes = F.transform(kids, lambda k: k["h"])
            step = F.struct(F.array_join(F.slice(hashes, F.lit(1), at), "").alias("l"), F.array_join(F.slice(hashes, at + 2, F.lit(ARITY)), "").alias("r"))
            # a tree that has come down to one node keeps it: nothing is hashed there
            steps = F.when(kid["h"] != parent["h"], F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>"))
            return F.struct(kid.alias("node"), F.concat(steps, above["way"]).alias("way"))

        return F.transform(kids, child)

    found = F.array(F.struct(node.alias("node"), way.alias("way")))
    for _ in range(levels):
        found = F.flatten(F.transform(found, below))
    return found


def prove(nodes: DataFrame, payload: list[str], above: DataFrame | None = None) -> DataFrame:
    """``(tree, <payload>, h, way, root)`` of ``nodes(tree, rank, size, h, <payload>)``.

    ``above(tree, h, way, top)`` continues the ways from the trees' roots on, by the function that is given the roots; without it, ways end there.
    """
    rounds = [nodes.select("tree", "rank", "size", F.struct("h", *payload).alias("node"))]
    while True:
        blocks = materialise(roll_up(rounds[-1], BLOCK_LEVELS), "merkle-blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("size").alias("n")).first().n or 0) <= 1:
            break
        rounds.append(blocks.select("tree", "rank", "size", F.struct("node.h").alias("node")))
    top = rounds[-1].select("tree", F.col("node.h").alias("root"))
    no_way = F.array().cast(f"array<{_STEP}>")
    extra = []
    if above is not None:
        over = above(top)
        extra = [c for c in over.columns if c not in ("tree", "way")]
        down = top.join(over, "tree").select("tree", F.lit(0).cast("long").alias("rank"), "root", "way", *extra)
    else:
        down = top.select("tree", F.lit(0).cast("long").alias("rank"), "root", no_way.alias("way"))
    for blocks in reversed(rounds[1::2]):
        met = blocks.select("tree", "rank", "node").join(down, ["tree", "rank"])
        spread = met.select("tree", "rank", "root", *extra, F.posexplode(ways_down(F.col("node"), F.col("way"), BLOCK_LEVELS)).alias("at", "found"))
        down = spread.select("tree", (F.col("rank") * ARITY ** BLOCK_LEVELS + F.col("at")).alias("rank"), "root", *extra, "found.way", "found.node")
        if blocks is not rounds[1]:
            down = down.drop("node")
    return down.select("tree", "node.*", "root", "way", *extra)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, forged, subroot, root, way)`` for each row; see the module's text.

    ``way`` holds, from the leaf up to the root of all sources, the joined digests of the siblings to the left and to the right.
    """
    found = ranked(leaves(docs, tampered).withColumnRenamed("leaf", "h"), ["doc_id", "h"])

    def sources(top: DataFrame) -> DataFrame:
        trees = top.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("h"))
        return prove(ranked(trees, ["name"]), ["name"]).select(F.col("name").alias("tree"), "way", F.col("root").alias("top"))

    proofs = prove(found, ["doc_id", "forged"], sources)
    return proofs.select("doc_id", F.col("h").alias("leaf"), "forged", F.col("root").alias("subroot"), F.col("top").alias("root"), "way")


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way give."""
    return F.aggregate(way, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_digest(way: Column) -> Column:
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def tamper_test(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked against the untampered root after the line breaks of every row with an even checksum of its id are deleted.

    A row without an id isn't tampered with.
    """
    even = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    proofs = manifest(docs, F.when(even, F.translate(docs["text"], "\n", "")))
    fold = folded(F.coalesce("forged", "leaf"), F.col("way"))
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("way")).alias("proof_sha256"), fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
