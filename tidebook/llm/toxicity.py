"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability (logistic in its words and
their first letters), the document's is the noisy-or of them: 1 - prod(1 - p). Only documents
are labelled; the gradient through the noisy-or finds the sentences that explain the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import crc_fold, materialize

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SAMPLE_ROWS = 10_000  # most labelled documents that a model is fitted on
PREFIXES = (4, 5, 6, 7)  # lengths of word beginnings that are features next to the word
MIN_DOCS = 3  # features in fewer documents of the sample are not learned
PENALTY = 2e-5
ROUNDS = 200

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
MEMORY = 300_000


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, text) of each sentence that is more than blanks."""
    return [(m.start(), m[0]) for m in SENTENCE.finditer(text) if not m[0].isspace()]


def fit_bags(texts: list[str], labels: np.ndarray) -> tuple[float, dict[str, float]]:
    """(bias, feature weights) by proximal Adam on the noisy-or likelihood."""
    word_no: dict[str, int] = {}
    word_ids, counts, doc_of = [], [], []
    for d, text in enumerate(texts):
        for _, s in sentences(text):
            ids = {word_no.setdefault(w, len(word_no)) for w in WORD.findall(s.lower())}
            word_ids.append(np.fromiter(ids, np.int32, len(ids)))
            counts.append(len(ids))
            doc_of.append(d)
    n_docs, n_sentences = len(texts), len(doc_of)
    if not word_no or len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if n_docs else 0.5, 1e-3, 1 - 1e-3))
        return float(np.log(share / (1 - share))) if n_sentences == 0 else -6.0, {}
    w, s, d = np.concatenate(word_ids), np.repeat(np.arange(n_sentences, dtype=np.int32), counts), np.array(doc_of)
    del word_ids
    # Words and features as two aligned lists, and the documents of each feature.
    feature_no: dict[str, int] = {}
    own = [np.array([feature_no.setdefault(f, len(feature_no)) for f in features(word)], np.int32) for word in word_no]
    n_words, seen_in = len(word_no), np.zeros(len(feature_no), np.int64)
    bounds = np.searchsorted(d[s], np.arange(n_docs + 1))
    for i in range(n_docs):
        if bounds[i] < bounds[i + 1]:
            seen_in[np.unique(np.concatenate([own[x] for x in np.unique(w[bounds[i] : bounds[i + 1]])]))] += 1
    fw, ff = np.repeat(np.arange(n_words), [len(x) for x in own]), np.concatenate(own)
    del own, word_no
    use = (seen_in >= MIN_DOCS)[ff]
    fw, ff = fw[use], ff[use]
    known = np.zeros(n_words, bool)
    known[fw] = True
    w, s = w[known[w]], s[known[w]]

    theta, bias = np.zeros(len(feature_no)), -6.0
    m1, m2, b1, b2 = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    positive = labels[d] > 0
    for t in range(1, ROUNDS + 1):
        per_word = np.bincount(fw, theta[ff], minlength=n_words)
        z = bias + np.bincount(s, per_word[w], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(d, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs)
        none = np.exp(log_none)
        slope = np.where(positive, -p * (none / np.maximum(1 - none, 1e-9))[d], p) / n_docs
        g = np.bincount(ff, np.bincount(w, slope[s], minlength=n_words)[fw], minlength=len(feature_no))
        gb, rate = slope.sum(), 0.15
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        scale = np.sqrt(m2 / (1 - 0.99**t)) + 1e-7
        theta -= rate * m1 / (1 - 0.9**t) / scale
        theta = np.sign(theta) * np.maximum(np.abs(theta) - rate * PENALTY / scale, 0)
        bias -= rate * b1 / (1 - 0.9**t) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-7)
    names = list(feature_no)
    return float(bias), {names[i]: float(theta[i]) for i in np.flatnonzero(np.abs(theta) > 1e-3)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[float, dict[str, float]]:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold, picked by a hash of the id.

    The sample is fitted in one task; its weights (bounded by the sample's words) come back.
    Rows with a NULL id or label are not used; an id that repeats counts once, with one of its texts (by hash).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT))
    picked = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, y, t or "") for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns)))
        bias, weights = fit_bags([t for *_, t in found], np.array([y for _, y, _ in found]))
        yield pa.RecordBatch.from_arrays([pa.array([None, *weights], pa.string()), pa.array([bias, *weights.values()], pa.float64())], names=["feature", "weight"])

    model = materialize(materialize(rows, "toxic-sample").coalesce(1).mapInArrow(fit_all, "feature string, weight double"), "toxic-model")
    found = {r["feature"]: r["weight"] for r in model.collect()}
    return found.pop(None), found


def scores(docs: DataFrame, model: tuple[float, dict[str, float]], threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the offending sentences.

    ``n_offending`` counts sentences of probability 0.5 or more; ``worst_start`` and
    ``worst_length`` locate the worst sentence in code points (-1 and 0 without any).
    A text without sentences (NULL, empty, blank) has score 0.
    """
    bias, weights = model
    calm = 1 / (1 + np.exp(-bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def weigh(word: str) -> float:
            total = sum(weights.get(f, 0.0) for f in features(word))
            if len(known) < MEMORY:
                known[word] = total
            return total

        def total(s: str) -> float:
            return bias + sum(known[w] if w in known else weigh(w) for w in set(WORD.findall(s.lower())))

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                parts = sentences(text or "")
                if not parts:
                    out.append((0.0, 0, -1, 0))
                    continue
                words = set(WORD.findall(text.lower()))
                if not any(known[w] if w in known else weigh(w) for w in words):
                    p = np.full(len(parts), calm)
                else:
                    p = 1 / (1 + np.exp(-np.clip(np.array([total(s) for _, s in parts]), -30, 30)))
                worst = int(np.argmax(p))
                start, sentence = parts[worst]
                out.append((float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), int((p >= 0.5).sum()), start, len(sentence)))
            columns = list(zip(*out)) if out else [[]] * 4
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "n_offending", "worst_start", "worst_length"])

    schema = "doc_id long, score double, n_offending long, worst_start long, worst_length long"
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)
    return scored.select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_offending", "worst_start", "worst_length",
    )
