"""The registered queries of the document operators, with their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kardia.llm import op1_planes, op2_automaton, op3_decontaminate, op4_chunks, op5_suffixes, op6_secrets, op7_simhash, op8_quality, op9_surrogates, op10_toxicity, op11_merkle, op12_windows, op13_variants, oracles
from kardia.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as compressed byte planes and read back from them."""
    return op1_planes.planes_roundtrip(table(spark, sf_dir, "documents"))


@register
def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the tokenization automaton."""
    return op2_automaton.roundtrip(table(spark, sf_dir, "documents"))


@register
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = op3_decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register
def op4_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunk fingerprints of all documents, against their edited texts and the next documents."""
    return op4_chunks.compare_neighbours(table(spark, sf_dir, "documents"))


@register
def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share, of all documents."""
    return op5_suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@register
def op6_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return op6_secrets.scan(table(spark, sf_dir, "documents")).drop("secrets")


@register
def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return op7_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op8_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return op8_quality.score(docs, op8_quality.fit(docs, table(spark, sf_dir, "labels")))


@register
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, after the check for collisions."""
    docs = op9_surrogates.checked(table(spark, sf_dir, "documents"), op9_surrogates.key_of(spark))
    return op9_surrogates.pseudonymise(docs, op9_surrogates.key_of(spark)).select("doc_id", "n_entities", "kinds", "text")


@register
def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return op10_toxicity.score(docs, op10_toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, checked after tampering with half of them."""
    return op11_merkle.tamper_test(table(spark, sf_dir, "documents"))


@register
def op12_window_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that occur elsewhere, too."""
    left = op12_windows.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words of the vocabulary of all documents, and the spellings that they are variants of."""
    return op13_variants.variants(op13_variants.vocabulary(table(spark, sf_dir, "documents")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
places AS (SELECT DISTINCT doc_id, n, i, w[i:i + n - 1] AS k
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, places.n FROM places JOIN wins ON places.n = wins.n AND places.k = wins.k),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op11_merkle_manifest"] = oracles.merkle()
ORACLES["op12_window_doubling"] = oracles.WINDOWS
ORACLES["op13_spelling_variants"] = oracles.variants()
