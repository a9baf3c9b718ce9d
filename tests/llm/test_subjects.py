import numpy as np

from wakeline.llm.subjects import _gradient, document_subjects, sentences_of
from wakeline.session import load


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = load(spark, d, "documents"), load(spark, d, "doc_subject_labels")
    held = labels.filter("doc_id % 5 = 0").distinct()
    ids = held.select("doc_id").distinct()
    # train without the held-out fifth; score only their documents
    known = docs.join(labels.filter("doc_id % 5 <> 0").select("doc_id").distinct().unionByName(ids), "doc_id")
    got = {(r["doc_id"], r["subject"]) for r in document_subjects(known, labels.filter("doc_id % 5 <> 0")).collect() if r["doc_id"] % 5 == 0}
    want = {tuple(r) for r in held.collect()}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9


def test_blank_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "The gale warning rose.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(4, "weather"), (4, "weather"), (9, "law"), (4, "other")], "doc_id bigint, subject string")
    assert {r["doc_id"] for r in document_subjects(docs, labels).collect()} <= {4}
    assert document_subjects(docs, labels.limit(0)).count() == 0
    assert sentences_of(None) == [] and len(sentences_of("One two. Three four!\nFive")) == 3


def test_subjects_are_those_of_the_labels(spark):
    docs = spark.createDataFrame([(i, "ship engine pump valve. " * 3 if i % 2 else "court judge appeal claim. " * 3) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "engines" if i % 2 else "courts") for i in range(12)], "doc_id bigint, subject string")
    got = {(r["doc_id"], r["subject"]) for r in document_subjects(docs, labels).collect()}
    assert got == {(i, "engines" if i % 2 else "courts") for i in range(20)}


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    counts, y = np.array([3, 0, 2]), np.array([[1, 0], [0, 1], [1, 1]], dtype=np.uint8)
    ids, emb, out, bias = np.array([1, 4, 1, 0, 4]), rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)

    def loss(e):
        rows = np.split(e[ids], np.cumsum(counts)[:-1])
        z = np.array([r.mean(0) if len(r) else np.zeros(3) for r in rows]) @ out + bias
        return (np.log1p(np.exp(z)) - y * z).sum()

    g = _gradient(ids, counts, y, emb, out, bias)[0]
    for i, j in ((1, 0), (4, 2), (0, 1), (5, 1)):
        step = np.zeros_like(emb)
        step[i, j] = 1e-5
        assert abs((loss(emb + step) - loss(emb - step)) / 2e-5 - g[i, j]) < 1e-3
