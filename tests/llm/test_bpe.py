"""The backtracking encoder against the tokenizers library."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebook.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def table():
    return bpe.Vocabulary.get(bpe.VOCABULARY)


def ids(table, text):
    return np.frombuffer(b"".join(table.encode(text)), "<u4").tolist()


def want(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids
    return len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest()


AWKWARD = [
    None, "", " \n\t ", "<|endoftext|>", "a<|startoftext|>B<|ENDOFTEXT|>'s", "don't we'LL 12 3½ ²x", "ΑΣ Σ ΟΔΟΣ", "İstanbul ﬁ Å Å é ́x", "a\x1cb\x1fc\x85d e　f​g",
    "\u0000 nul", "日本語のテキスト", "नमस्ते", "ก็", "\U0001F600\U0001F468‍\U0001F469", "՘ᲉꟋ\U0002b73a\U000323b0", "x" * 9000, "ab" * 5000 + "aab" * 1000, "</w> <w/> a</w>",
]


def test_every_code_point(table, library):
    points = [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5), *range(0x2A000, 0x33500, 11)]
    for at in range(0, len(points), 400):
        text = " ".join(f"a{chr(c)}{chr(c)}b{chr(c)}1" for c in points[at : at + 400])
        assert ids(table, text) == library.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_words_of_token_parts(table, library):
    pick = random.Random(3)
    parts = sorted(library.get_vocab())
    for _ in range(300):
        words = ["".join(pick.choice(parts).replace("</w>", "") for _ in range(pick.randint(1, 6))) for _ in range(20)]
        words += ["".join(pick.choice("ab") for _ in range(pick.randint(1, 60))) for _ in range(10)]
        text = " ".join(words)
        assert ids(table, text) == library.encode(text, add_special_tokens=False).ids


def test_blocks_and_bounded_memories(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "STRETCH", 50)
    monkeypatch.setattr(bpe, "MEMORY", 40)
    monkeypatch.setattr(bpe, "RUN", 5)
    small = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY))
    for text in [*AWKWARD, "counterrevolutionaries " * 9 + "antidisestablishmentarianism" * 20]:
        assert bpe.digests(small, text or "") == want(library, text)
    assert len(small.chunks) <= 40 and len(small.words) <= 40 and len(small.compatible) <= 40


def test_neighbours_are_compatible_and_others_not(table):
    # Cutting a token in its halves leaves a pair that would merge.
    for token in range(600, 49000, 997):
        left, right = table.halves[token]
        assert not table._holds(left, right) and table._holds(left, right, table.rank[token])


def test_checksums_of_a_table(spark, library):
    texts = [*AWKWARD, "twice", "twice", "The quick brown fox. " * 50_000]
    rows = [(None if i == 3 else i // 2, t, "en", None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n_tokens", "ids", "decoded", "words")}).repartition(3)
    got = bpe.checksums(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((r[0], *want(library, r[1])) for r in rows)
    assert bpe.checksums(docs.limit(0)).count() == 0
    full = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encoded(docs).collect())
    assert full == collections.Counter(
        (r[0], tuple(e := library.encode(r[1] or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for r in rows)
    assert "Exchange" not in bpe.checksums(docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
