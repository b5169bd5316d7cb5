"""Collocations against counts in plain Python."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(11)
WORDS = ["the", "Of", "sea", "ñandú", "STRASSE", "über", "x1", "tide", "a b", "\u0000"]


def prose(n):
    return "".join(f"{w}{s}" for w, s in zip(rng.choice(WORDS, n, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02]), rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"], n, p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])))


ROWS = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " \t. !\n", "en", "s", 0), (2, "one", None, "s", 0), (3, "no such thing", "fr", "s", 0)]
ROWS += [(i, prose(60), ["en", "de\nx", None, "und"][i % 4], "s", 1) for i in range(40)] + [(9, "New York City hall. " * 30, "en", "s", 1)] * 3
ROWS += [(10, "ha " * 500, "de", "s", 1), (11, prose(9000), "en", "s", 1), (12, "z" * 5000, "en", "s", 1), (13, "a b,a b a b c. a b c\r" * 12, "zh", "s", 1)]


def brute(rows, longest, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        best, k = min(cuts)
        held = any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in found.items())
        if not held:
            out[lang].append((-best, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(x, i, p.decode(), -a, l, r, n[x], -s) for x, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1)}


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 4, 80, 50)])
def test_equals_plain_counts(spark, monkeypatch, longest, least, share, top):
    if longest == 4:
        monkeypatch.setattr(collocations, "STRETCH", 64)
        monkeypatch.setattr(collocations, "HOLD", 300)
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("w1", "c", "f", "all", "words", "phrase", "k", "l")}).repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, longest, least, share, top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS, longest, least, share, top) and len(got) > 20


def test_nothing_to_find(spark):
    for rows in ([], ROWS[:5]):
        frame = collocations.collocations(spark.createDataFrame(rows, SCHEMA))
        assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and frame.count() == 0


def test_score_passes_64_bits(spark):
    a, l, r = 999_999_999_999_989, 10**15 - 1, 10**15 - 7
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(l).alias("l"), F.lit(r).alias("r")).select(collocations.score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * a * a // (l * r)


def test_windows_meet_once(spark):
    counted = spark.createDataFrame([], "head string, ends string")
    plan = collocations.folded(counted, 3, 10)._jdf.queryExecution().executedPlan().toString()
    # One for the windows, one for what is left of them.
    assert plan.count("Exchange hashpartitioning(") == 2 and "REPARTITION_BY_COL" in plan
