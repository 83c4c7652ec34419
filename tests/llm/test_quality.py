import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import quality


def graded_texts(prose, n, seed0):
    bad, out = ["idiot", "scum", "trash"], []
    for i in range(n):
        words = prose(60 + i % 90, seed0 + i).split()
        g = i % 3
        if g == 0:
            words[i % 50] = bad[i % 3]
            words[(i * 7) % 50] = bad[(i + 1) % 3]
        if g == 1:
            words = [w + "&&&" for w in words]
        out.append((i, " ".join(words), g))
    return out


def test_held_out_accuracy(prose):
    learn, held = graded_texts(prose, 900, 0), graded_texts(prose, 300, 10_000)
    model = quality.fit([quality.features(t.encode()) for _, t, _ in learn], np.array([g for *_, g in learn]), 3)
    assert (np.diff(model.cuts) > 0).all()
    tails = np.array([model.tails(quality.features(t.encode())) for _, t, _ in held])
    guess = (tails > 0.5).sum(axis=1)
    assert (guess == np.array([g for *_, g in held])).mean() > 0.93
    assert (np.diff(tails, axis=1) <= 0).all()


def test_gradient():
    """Fitting lowers the loss to that of the labels' own shares where features tell nothing."""
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    model = quality.fit([np.array([5], dtype=np.int32)] * 600, grades, 3, rounds=600)
    tails = model.tails(np.array([5]))
    assert np.allclose(tails, [(grades > 0).mean(), (grades > 1).mean()], atol=0.02)


def test_against_a_plain_optimiser():
    """The penalised likelihood that fit() reaches is that of small plain steps on the same objective."""
    rng = np.random.default_rng(7)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(400)]
    true = rng.normal(size=12) * 2
    z = np.array([true[x].sum() for x in rows]) + rng.logistic(size=400)
    grades, l1 = (z > -1).astype(int) + (z > 1.5), 2e-3

    def loss(w, cuts):
        z = np.array([w[x].sum() for x in rows])
        tail = np.stack([np.ones(400), *(quality.sigmoid(z - c) for c in cuts), np.zeros(400)])
        at = np.arange(400)
        return -np.log(tail[grades, at] - tail[grades + 1, at]).mean() + l1 * np.abs(w).sum()

    model = quality.fit(rows, grades, 3, l1=l1)
    best, w, cuts, step = np.inf, np.zeros(12), np.array([-1.0, 1.0]), 0.5
    while step > 1e-4:  # coordinate search
        before = best
        for k in range(14):
            for d in (step, -step):
                w2, c2 = w.copy(), cuts.copy()
                (w2 if k < 12 else c2)[k if k < 12 else k - 12] += d
                if c2[0] < c2[1] and (got := loss(w2, c2)) < best:
                    best, w, cuts = got, w2, c2
        step = step if best < before - 1e-9 else step / 2
    assert loss(model.weights[:12].astype(float), model.cuts) < best + 2e-3


def test_repeated_ids_are_bounded(spark):
    docs = spark.range(30_000).selectExpr("cast(1 as bigint) as doc_id", "concat('idiot word', id) as text").union(spark.sql("select 2L, 'fine words stand here'"))
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fitted = quality.fit
    try:
        quality.fit = lambda rows, grades, n: seen.append(len(rows)) or fitted(rows, grades, n, rounds=2)
        assert quality.train(docs, quality.graded(labels), fit_rows=2) is not None
    finally:
        quality.fit = fitted
    assert seen == [2]


def test_query_against_plain_scoring(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    model = quality.train(read("documents"), quality.graded(read("labels")))
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    got = quality.op5_ordinal(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        total = sum(float(model.weights[b]) for b in quality.features(texts[r.doc_id].encode()))
        tails = [1 / (1 + np.exp(c - total)) for c in model.cuts]
        assert abs(r.expected_grade - sum(tails)) < 1e-4 and abs(r.tail_prob - tails[-1]) < 1e-4 and r.kept == (r.tail_prob >= 0.5)


def test_frames(spark, docs_of, prose):
    rows = graded_texts(prose, 150, 0)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, prose(50_000, 3)), (None, "x"), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, _, g in rows] + [(0, 1, 0), (None, 1, 1), (3, None, 0), (555, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.graded(labels))
    scored = quality.score(docs, model).collect()
    assert len(scored) == 155 and all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.tail_prob >= 0.5) for r in scored)
    again = quality.score(docs.repartition(7), quality.train(docs.repartition(3), quality.graded(labels))).collect()
    assert sorted(map(str, scored)) == sorted(map(str, again))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored if r.kept)
    assert quality.train(docs, quality.graded(labels), fit_rows=0) is None


def test_nothing_to_learn(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, None)])
    assert quality.train(docs, quality.graded(none)) is None
    assert all(r.kept and r.tail_prob is None for r in quality.score(docs, None).collect())
    assert quality.keep_good(docs, None).count() == 2
    assert quality.score(docs_of([]), None).count() == 0


def test_on_the_documents(spark):
    """Held-out labels of the test tables: fitted on even ids, judged on odd ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, quality.graded(labels.where("doc_id % 2 = 0")))
    found = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    clean, toxic = F.expr("quality = 1 and toxic = 0"), F.expr("toxic = 1")
    r = found.agg(F.avg(F.when(clean, F.col("kept").cast("int"))).alias("clean"), F.avg(F.when(toxic, F.col("kept").cast("int"))).alias("toxic")).first()
    assert r.clean > 0.97 and r.toxic < 0.5, r


def test_a_task_forgets_its_words():
    """Workers outlive their tasks: what one remembers is bounded, and goes with it."""
    ran = []
    texts = [" ".join(f"word{k}" for k in range(at, at + 2000)) for at in range(0, 200_000, 2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), columns=batch.schema.names, schema=None, mapInArrow=lambda run, _: ran.append(run))
    quality.keep_good(docs, quality.Ordinal(np.ones(quality.BUCKETS, dtype=np.float32), np.zeros(2)))
    tracemalloc.start()
    assert sum(b.num_rows for b in ran[0](iter([batch]))) == len(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 2_000_000 and peak < 25_000_000
