"""The pipeline against a brute-force version, stage by stage."""

import corpus_pipeline
from pluvio.llm import mixing, quality_rules
from pluvio.llm.queries import vocabulary
from pluvio.llm.shared import read
from tests.llm import brute


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = read(spark, sf_dir, "documents")
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    groups = brute.components([(r.doc_id, r.text) for r in rows], 5, 80)
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    texts = {r.doc_id: x[2] for r, x in zip(rows, brute.without_repeats([(r.doc_id, r.text) for r in rows], 35), strict=True)}
    left = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.lang, r.source, len(texts[r.doc_id])) for r in rows], docs.schema)
    copies = {r.doc_id: r.n_copies for r in mixing.copies(left).collect()}
    want = []
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        want += [(i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(x))] * copies[i]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "mixing sources", "BPE"]
