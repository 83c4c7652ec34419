import hashlib

import corpus_pipeline
from ledgerloom.llm import bpe, copies, decontam, lines, quality, simhash

from .test_lines import brute as kept_lines


def firsts(docs):
    """docs without those that are connected with an earlier one by steps of 0.8 in five-word shingles."""
    sets = [set(copies.shingle_set(t.encode()).tolist()) for _, t in docs]
    group = list(range(len(docs)))
    for k, x in enumerate(sets):
        for j, y in enumerate(sets[:k]):
            if 5 * len(x & y) >= 4 * len(x | y) and group[j] != group[k]:
                low, high = sorted((group[j], group[k]))
                group = [low if g == high else g for g in group]
    return [d for k, d in enumerate(docs) if group[k] == k]


def test_run_against_plain_versions(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    docs = [(r.doc_id, r.text) for r in table("documents")]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(frame, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    docs = [(i, t) for i, t in docs if model.tails(quality.features(t.encode()))[-1] >= quality.KEEP]
    docs = sorted(kept_lines(docs, spare=0.8).items())
    docs = firsts(docs)
    search = decontam.searchers((r.item_id, r.text) for r in table("benchmark"))
    docs = [(i, t) for i, t in docs if not decontam.hits(decontam.words_of(t.encode()), search)[0]]
    assert 20 < len(docs) < 200
    want = {}
    for i, t in docs:
        ids = bpe.encode(t, *bpe.default_ranks())
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_columns(spark, docs_of, sf_dir, prose):
    docs = docs_of([(1, None), (2, ""), (3, prose(50, 1)), (4, prose(50, 1)), (5, prose(20_000, 2)), (5, prose(20_000, 2))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns, name
            out.collect()
    assert simhash.keep_firsts(docs).count() == 3 and lines.drop_recurring(docs).count() == 6
