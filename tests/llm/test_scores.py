"""Scores of the two classifiers, recomputed in plain Python from the model and the whole text."""

import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidebook.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " \n\t ", "One. TWO two two! ½ | ñ", "a a a b\nb\n\nb", "x" * 3000, "Ünï 42 ٣ ...!?", "\x0b\x0c mixed\r\nends. ", "no end", "Bad bad BAD.\nFine line? Bad"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([*[(-i - 1, t, "en", "s", 0) for i, t in enumerate(ODD)], (None, None, None, None, None), (5, None, None, None, None)], SCHEMA)
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).cache()


def held_out(doc_id, folds, fold):
    return (zlib.crc32(str(doc_id).encode()) % folds if doc_id is not None else 0) == fold


def plain_statistics(text):
    text = text or ""
    kind = [unicodedata.category(c) for c in text]
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = text.split("\n")
    n, size = len(text), len(words)

    def share(a, b):
        return a / b if b else 0.0

    return {
        "chars": n, "words": size, "distinct_words": share(len(set(words)), size), "word_length": share(n, size),
        "upper": share(kind.count("Lu"), n), "digits": share(sum(k[0] == "N" for k in kind), n), "letters": share(sum(k[0] == "L" for k in kind), n),
        "symbols": share(sum(k[0] not in "LN" and c not in " \t\n\x0b\x0c\r" for k, c in zip(kind, text)), n),
        "bare_words": share(sum(len(w) == 1 for w in words), size), "repeats": share(sum(a == b for a, b in zip(words, words[1:])), size),
        "lines": len(lines), "distinct_lines": share(len(set(lines)), len(lines)), "line_length": share(n, len(lines)),
        "sentence_ends": share(sum(text.count(c) for c in ".!?"), size),
    }


def test_quality_scores_are_the_sums_of_their_rules(docs):
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    inf = math.inf
    rules = (
        (((at["words"], 20.0, inf),), 1.5), (((at["symbols"], -inf, 0.05), (at["repeats"], -inf, 0.01)), 0.7), (((at["upper"], 0.02, 0.08),), -0.9),
        (((at["distinct_words"], 0.4, inf), (at["line_length"], 30.0, 400.0), (at["letters"], 0.6, inf)), 1.1), (((at["digits"], 0.01, inf),), -0.4),
        (((at["bare_words"], 0.1, inf),), -1.3), (((at["sentence_ends"], 0.03, 0.3), (at["word_length"], 3.0, 9.0)), 0.8), (((at["distinct_lines"], -inf, 0.9), (at["lines"], 3.0, inf)), -2.0),
    )
    got = quality.scores(docs, quality.RuleModel(-1.0, rules)).collect()
    texts = docs.collect()
    assert len(got) == len(texts) > 150
    want = []
    for doc_id, text in texts:
        values = plain_statistics(text)
        total = -1.0 + sum(w for rule, w in rules if all(low < values[quality.STATISTICS[k]] <= high for k, low, high in rule))
        score = 1 / (1 + math.exp(-total))
        want.append((repr(doc_id), held_out(doc_id, quality.FOLDS, quality.HELD_OUT), round(score, 12), int(score >= quality.THRESHOLD)))
    assert sorted((repr(r.doc_id), r.held_out, round(r.score, 12), r.predicted) for r in got) == sorted(want)
    assert len({w[2] for w in want}) > 10


def test_toxicity_scores_are_noisy_or_over_sentences(docs):
    words = sorted({w for (t,) in docs.select("text").limit(40).collect() if t for w in re.findall(r"[^\W\d_]+", t.lower())})
    pick = np.random.default_rng(2)
    weights = {f"={w}": float(pick.normal(0, 2)) for w in words[::2]} | {w[:n]: float(pick.normal(0, 1)) for w in words[::3] for n in toxicity.PREFIXES if len(w) > n} | {"=bad": 4.0}
    got = toxicity.scores(docs, (-3.0, weights)).collect()
    want = []
    for doc_id, text in docs.collect():
        none, offending, worst = 1.0, 0, (-1.0, -1, 0)
        for m in re.finditer(r"[^.!?\n]+[.!?]*", text or ""):
            if not m[0].strip():
                continue
            z = -3.0
            for word in set(re.findall(r"[^\W\d_]+", m[0].lower())):
                z += weights.get("=" + word, 0.0) + sum(weights.get(word[:n], 0.0) for n in toxicity.PREFIXES if len(word) > n)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            none *= 1 - min(p, 1 - 1e-12)
            offending += p >= 0.5
            worst = max(worst, (p, m.start(), len(m[0])), key=lambda x: x[0])
        score = 1 - none if worst[0] >= 0 else 0.0
        want.append((repr(doc_id), held_out(doc_id, toxicity.FOLDS, toxicity.HELD_OUT), round(score, 9), offending, worst[1:]))
    assert sorted((repr(r.doc_id), r.held_out, round(r.score, 9), r.n_offending, (r.worst_start, r.worst_length)) for r in got) == sorted(want)
    assert all(r.predicted == int(r.score >= toxicity.THRESHOLD) for r in got) and len({w[2] for w in want}) > 50
