"""Subject areas of each document (problem 10): averaged word and subword embeddings with logistic outputs.

The classifier is trained on sentences of the hand-labelled documents (a bounded, documented sample of at most
``max_labelled`` documents); a sentence takes its document's labels. Its words are hashed to feature ids once, in
the training table. Every epoch the partitions of that table compute gradients in parallel, which are summed and
applied by Adam. A sentence deals with a subject if
its independent logistic output exceeds a half; a document gets each subject that at least ``share`` of its
sentences deal with. Every document is scored whole.

Defined results: null, empty and blank texts have no subject; labels of unknown documents are ignored; repeated
labels count once; without any label the result is empty; ties at the share count. The subjects are those of the
labels; more than ``max_subjects`` different ones are an error, as the classifier has an output for each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.session import spread_scan, write_table

BUCKETS, DIM = 1 << 13, 16


def sentences_of(text: str | None) -> list[str]:
    t = re.sub(r"</?[A-Za-z][^<>]{0,200}>", " ", text or "")
    parts = re.split(r"\n+|(?<=[.!?])\s+", t)
    return [p for p in parts if re.search(r"[^\W\d_]{2}", p)]


def features(word: str) -> list[int]:
    """Hash buckets of a word and of its four-letter pieces."""
    w = f"<{word}>"
    return [zlib.crc32(g.encode()) % BUCKETS for g in [w, *(w[i : i + 4] for i in range(len(w) - 3))]]


def words_of(sentence: str) -> list[str]:
    return re.findall(r"[^\W\d_]{2,}", sentence.casefold())


def _segment_sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of values, counts[k] of them from starts[k] on."""
    total = np.zeros((len(counts), values.shape[1]), dtype=values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        total[some] = np.add.reduceat(values, starts[some], axis=0)
    return total


def _gradient(ids: np.ndarray, counts: np.ndarray, y: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray):
    """Sums over sentences of the gradients of embeddings, output weights and bias."""
    starts = np.cumsum(counts) - counts
    weight = (1.0 / np.maximum(counts, 1)).astype(np.float32)
    h = _segment_sums(emb[ids], starts, counts) * weight[:, None]
    d = (1 / (1 + np.exp(-(h @ out + bias))) - y).astype(np.float32)
    back = (d @ out.T) * weight[:, None]
    order = np.argsort(ids, kind="stable")
    used, first, n = np.unique(ids[order], return_index=True, return_counts=True)
    g = np.zeros_like(emb)
    g[used] = _segment_sums(np.repeat(back, counts, axis=0)[order], first, n)
    return g, h.T @ d, d.sum(0)


def train(sentences: DataFrame, subjects: list[str], *, epochs: int = 30, rate: float = 0.15, partitions: int = 6):
    """(embeddings, output weights, bias) by synchronous data-parallel gradient descent; None without sentences."""
    rng = np.random.default_rng(7)
    params = [a.astype(np.float32) for a in (rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(subjects))), np.full(len(subjects), -1.0))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, list[int]] = {}
        for pdf in batches:
            ids = [np.array([i for w in words_of(s) for i in cache.setdefault(w, features(w))], dtype=np.int32) for s in pdf["sentence"]]
            y = np.array([[s in set(labels) for s in subjects] for labels in pdf["labels"]], dtype=np.uint8).reshape(-1, len(subjects))
            yield pd.DataFrame({"ids": [np.concatenate(ids).tobytes()] if ids else [], "counts": [np.array([len(x) for x in ids], dtype=np.int32).tobytes()] if ids else [], "y": [y.tobytes()] if ids else []})

    table = write_table(sentences.repartition(partitions, "doc_id").mapInPandas(hashed, "ids binary, counts binary, y binary"), "sentences")
    for epoch in range(1, epochs + 1):
        shared = table.sparkSession.sparkContext.broadcast(params)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = None, 0
            for pdf in batches:
                for ids, counts, y in zip(pdf["ids"], pdf["counts"], pdf["y"]):
                    counts = np.frombuffer(counts, dtype=np.int32)
                    g = _gradient(np.frombuffer(ids, dtype=np.int32), counts, np.frombuffer(y, dtype=np.uint8).reshape(len(counts), -1), *shared.value)
                    total, n = g if total is None else tuple(a + b for a, b in zip(total, g)), n + len(counts)
            if total is not None:
                yield pd.DataFrame({"g": [total[0].tobytes()], "o": [total[1].tobytes()], "b": [total[2].tobytes()], "n": [n]})

        rows = table.mapInPandas(run, "g binary, o binary, b binary, n bigint").collect()
        if not rows:
            return None
        n = sum(r["n"] for r in rows)
        grads = [sum(np.frombuffer(r[c], dtype=np.float32).astype(float) for r in rows).reshape(params[k].shape) / n for k, c in enumerate("gob")]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] = (params[k] - rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-6)).astype(np.float32)
        shared.unpersist()
    return params


def labelled_sentences(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    known = labels.filter(F.col("subject").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    known = known.orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(d, s, list(lab)) for d, t, lab in zip(pdf["doc_id"], pdf["text"], pdf["labels"]) for s in sentences_of(t)]
            yield pd.DataFrame(got, columns=["doc_id", "sentence", "labels"])

    return texts.mapInPandas(split, "doc_id bigint, sentence string, labels array<string>")


def score(docs: DataFrame, params, subjects: list[str], *, share: float = 0.2, level: float = 0.5) -> DataFrame:
    """(doc_id, subject, part) of every subject with at least share of a document's sentences."""
    table = docs.sparkSession.sparkContext.broadcast((params[0] @ params[1], params[2]))
    cut = float(np.log(level / (1 - level)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logits, bias = table.value
        width = len(subjects)
        known: dict[str, int] = {}
        vectors = np.zeros((1024, width + 1))  # logits of a word's features and their number
        for pdf in batches:
            if len(known) > 200_000:
                known.clear()
            words: list[int] = []
            in_sentence: list[int] = []
            doc_of: list[int] = []
            for k, t in enumerate(pdf["text"]):
                for s in sentences_of(t):
                    here = words_of(s)
                    for w in here:
                        at = known.get(w)
                        if at is None:
                            at = known[w] = len(known)
                            if at >= len(vectors):
                                vectors = np.concatenate([vectors, np.zeros_like(vectors)])
                            f = features(w)
                            vectors[at, :width], vectors[at, width] = logits[f].sum(0), len(f)
                        words.append(at)
                    in_sentence.append(len(here))
                    doc_of.append(k)
            if not doc_of:
                continue
            counts = np.array(in_sentence)
            sums = _segment_sums(vectors[np.array(words, dtype=np.int64)], np.cumsum(counts) - counts, counts)
            deals = sums[:, :width] / np.maximum(sums[:, width:], 1) + bias > cut
            docs_at, first, n = np.unique(doc_of, return_index=True, return_counts=True)
            part = np.add.reduceat(deals.astype(float), first, axis=0) / n[:, None]
            r, c = np.nonzero(part >= share - 1e-9)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[docs_at[r]], "subject": [subjects[j] for j in c], "part": part[r, c]})

    return spread_scan(docs.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, subject string, part double")


def document_subjects(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 3_000, max_subjects: int = 1_000, share: float = 0.2) -> DataFrame:
    subjects = sorted(r["subject"] for r in labels.select("subject").filter("subject IS NOT NULL").distinct().limit(max_subjects + 1).collect())
    if len(subjects) > max_subjects:
        raise ValueError(f"more than {max_subjects} subjects")
    params = train(labelled_sentences(docs, labels, max_labelled), subjects) if subjects else None
    if params is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, subject string, part double")
    return score(docs, params, subjects, share=share)
