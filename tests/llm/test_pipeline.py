"""The pipeline against a plain version of its stages, and its stages on edge cases."""

import hashlib

import corpus_pipeline
from kardia.llm import op2_automaton, op3_decontaminate, op9_surrogates, op10_toxicity
from .test_operators import plain_components, plain_scan, plain_simhash

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = op10_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = op10_toxicity.Scorer(grammar)
    rows = [r for r in docs.collect() if scorer(r.text or "") < op10_toxicity.THRESHOLD]
    fps = [plain_simhash(r.text) for r in rows]
    rows = [r for r, c in zip(rows, plain_components(fps, [r.doc_id for r in rows])) if c == r.doc_id]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    automaton = op3_decontaminate.BenchmarkAutomaton(items)
    suspects = {r.doc_id for r in rows if automaton.scan(r.text or "")[1]}  # the plain scan is slow: it judges those and a few more
    rows = [r for i, r in enumerate(rows) if not ((r.doc_id in suspects or i % 25 == 0) and plain_scan(r.text, items)[-1])]
    surrogates = op9_surrogates.Surrogates(op9_surrogates.key_of(spark))
    want = {}
    for r in rows:
        text = surrogates.replace(r.text or "")[0]
        ids = op2_automaton.codec().encode([text])[0]
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_bear_edges(spark, edge_docs, no_docs, clashing):
    for docs in (edge_docs, no_docs, clashing):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns, name
            assert kept.count() <= n, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]
