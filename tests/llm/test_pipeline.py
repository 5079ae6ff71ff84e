"""The pipeline's stages against plain Python, each on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from brute import components
from corpus_fixtures import SF001, make_docs  # noqa: F401
from custlytics.llm import line_dedup, quality_rules
from test_line_dedup import brute as brute_lines


def test_stages_on_the_table(spark):
    source = spark.read.parquet(f"{SF001}/documents.parquet")
    docs, seen = source, []
    for name, stage in P.STAGES:
        before, docs = docs, P.materialize_table(stage(spark, docs, SF001), name)
        seen.append((before, docs))
    for _, out in seen[:-1]:
        assert out.columns == source.columns and out.dtypes == source.dtypes

    before, after = seen[0]
    good = {r.doc_id for r in quality_rules.measure(before).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == good

    before, after = seen[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d: t for d, (t, _, gone) in brute_lines(rows, line_dedup.MAX_EDITS, line_dedup.MIN_CHARS).items() if not gone or t.strip(quality_rules.SPACES)}
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen[2]
    groups = components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)

    before, after = seen[3]
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in before.collect()}
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 2

    before, after = seen[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before.collect())
    for r in rows:
        assert list(r.ids) == sp.encode(texts[r.doc_id]) + [2] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(map(tuple, P.run(spark, SF001).select("doc_id", "ids_sha256").collect())) == sorted((r.doc_id, r.ids_sha256) for r in rows)


def test_stages_take_odd_rows(spark, make_docs):
    text = "A clean text of the usual kind that is long enough for all of the rules to pass it."
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, text + " And it has a second sentence of its own in the end, as some do."), (5, "w" * 10_000)]
    for docs in (make_docs(rows, extra={"epoch": 1, "node": "x", "h1": 2}), make_docs(rows).limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF001)
            assert out.count() >= 0
            if name != "sentencepiece":
                assert out.columns == docs.columns
                docs = out
