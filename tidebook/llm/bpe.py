"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The merges of a word-level vocabulary are never replayed on a text. An Aho-Corasick automaton of
all tokens gives, for a stretch of a word, the tokens that start at each place. The encoder takes
the longest one that is compatible with the token before it, a shorter one if it is not, and goes
back one token if none is left; a place that it has gone back from is never tried again, so a
word takes time in proportion to its length. Two tokens are compatible if no merge over their
border would have come before the merges that made them: this pair table is filled as pairs
are asked for. The one sequence whose neighbours are all compatible is what the merges give.

Words between white space are encoded once per worker and remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
# Words and token pairs that a worker remembers (some 200 bytes each).
MEMORY = 400_000
# Characters of a text, symbols of a word and ids of a decoded run that are handled at a time.
STRETCH, BLOCK, RUN = 1 << 20, 4096, 1 << 16
ROWS = 500
# The last symbol of a word is moved here, so that a symbol is always one character.
LAST = 0xE000
# Ids are below 2 ** SHIFT; a pair of them is one number.
SHIFT = 20
# White space of the vocabulary's pattern; str.split would also cut at U+001C to U+001F.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable character for each byte: itself if it is one in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens, merges, automaton and pair table of one tokenizer file."""

    _known: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: s for s, i in ids.items()}, **{i: s for s, i in self.special.items()}}
        size = max(names) + 1
        text: list[str] = [""] * size
        # Place of the merge that makes a token (-1: a symbol) and its halves.
        self.rank, self.halves, self.made = [-1] * size, [(0, 0)] * size, {}
        for b in symbols:
            text[ids[b]], text[ids[b + suffix]] = b, chr(LAST + ord(b))
        for n, pair in enumerate(model["merges"]):
            one, two = pair if isinstance(pair, list) else pair.split(" ")
            left, right, token = ids[one], ids[two], ids[one + two]
            self.rank[token], self.halves[token], self.made[left << SHIFT | right] = n, (left, right), token
            text[token] = text[left] + text[right]
        self.compatible: dict[int, bool] = {}
        self.length = [len(t) for t in text]
        # A token that its own merges would not give is never part of a result.
        reached = [bool(t) and self.rank[i] < 0 for i, t in enumerate(text)]
        for i in sorted(range(size), key=self.rank.__getitem__):
            left, right = self.halves[i]
            reached[i] = reached[i] or bool(text[i]) and reached[left] and reached[right] and self._holds(left, right, self.rank[i])
        at = {t: i for i, t in enumerate(text) if reached[i]}
        self.matches = ahocorasick.Automaton()
        for t, i in at.items():
            self.matches.add_word(t, (i, len(t) - 1))
        self.matches.make_automaton()
        self.longest = max(map(len, at))
        # The longest token that begins a token, -1 if none does.
        self.shorter = [next((at[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in at), -1) for t in text]
        self.symbol = dict(enumerate(symbols))
        self.file = Tokenizer.from_file(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # Every token with a blank behind it, one after the other.
        shown = [f"{names.get(i, '')} ".encode() for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    @classmethod
    def get(cls, name: str) -> Vocabulary:
        if name not in cls._known:
            import public_tokenizers

            cls._known[name] = cls(public_tokenizers.path(name))
        return cls._known[name]

    def _holds(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge over the border of ``a`` and ``b`` comes before theirs (and before rank ``before``).

        The later of the two is undone step by step. Merges of one rank go from left to right,
        so over the border the same rank comes before a merge on the right, not on the left.
        """
        rank, halves, made = self.rank, self.halves, self.made
        while True:
            over = made.get(a << SHIFT | b)
            if over is not None and rank[over] < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, halves[b][0]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        """``_holds``, entered in the pair table."""
        found = self._holds(a, b)
        if len(self.compatible) < MEMORY:
            self.compatible[a << SHIFT | b] = found
        return found

    def merge(self, word: str) -> list[int]:
        """Ids of one word of symbols (its last one moved by ``LAST``)."""
        n, at, begin = len(word), 0, -BLOCK
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        known, fits, length, shorter = self.compatible.get, self._fits, self.length, self.shorter
        token = -1  # the next one to try at this place, -1: the longest
        while at < n:
            if token < 0:
                if not begin <= at < begin + BLOCK:
                    begin = at // BLOCK * BLOCK
                    starts = {e - k: t for e, (t, k) in self.matches.iter(word if n <= BLOCK else word[begin : begin + BLOCK + self.longest])}
                token = starts[at - begin]
            while token >= 0:
                end = at + length[token]
                if open_[end]:
                    if not out:
                        break
                    fit = known(out[-1] << SHIFT | token)
                    if fits(out[-1], token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def _word(self, word: str) -> bytes:
        found = self.merge(word[:-1] + chr(LAST + ord(word[-1])))
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.words) < MEMORY and len(word) < 40:
            self.words[word] = ids
        return ids

    def _normal(self, part: str) -> list[str]:
        """The normalised words of a run of characters, in byte symbols.

        From U+0300 on (combining marks, other scripts) the file's own normaliser and splitter are
        asked, as their Unicode tables are not Python's.
        """
        if max(part, default="") >= "\u0300":
            return [w for w, _ in self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(part))]
        words = self.pattern.findall(part.lower())
        if part.isascii() and part.isprintable():
            return words
        return ["".join(map(self.symbol.__getitem__, w.encode())) for w in words]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of characters without white space."""
        known, out = self.words.get, []
        for i, part in enumerate(self.cut.split(chunk) if self.cut else [chunk]):
            if i % 2:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out += [known(w) or self._word(w) for w in self._normal(part)]
        ids = b"".join(out)
        if len(self.chunks) < MEMORY and len(chunk) < 40:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids, stretch by stretch; stretches end at white space."""
        known, at = self.chunks.get, 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH:
                blank = SPACE.search(text, at + STRETCH)
                end = blank.end() if blank else end
            stretch = text[at:end]
            odd = any(c in stretch for c in "\x1c\x1d\x1e\x1f")
            chunks = filter(None, SPACE.split(stretch)) if odd else stretch.split()
            yield b"".join([known(c) or self._chunk(c) for c in chunks])
            at = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts, each with a blank behind it, gathered by their offsets."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        return self.shown[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)].tobytes()


def digests(vocabulary: Vocabulary, text: str) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids and of the decoded text (tokens joined by blanks)."""
    count, of_ids, of_text, blank = 0, hashlib.sha256(), hashlib.sha256(), b""
    for data in vocabulary.encode(text):
        of_ids.update(data)
        ids = np.frombuffer(data, "<u4")
        count += len(ids)
        for at in range(0, len(ids), RUN):
            shown = vocabulary.decode(ids[at : at + RUN])
            of_text.update(blank)
            of_text.update(shown[:-1])
            blank = b" "
    return count, of_ids.hexdigest(), of_text.hexdigest()


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of long) and decoded text of every text; a NULL text counts as empty.

    Rows with equal or NULL ids stay separate; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary.get(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [np.frombuffer(b"".join(table.encode(t or "")), "<u4") for t in batch.column(1).to_pylist()]
                shown = [b"".join(table.decode(x[i : i + RUN]) for i in range(0, len(x), RUN))[:-1].decode() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(shown, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<long>, decoded string")


def checksums(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, of any length.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8. A NULL
    or empty text has no ids and the hash of nothing twice. Rows with equal or NULL ids stay separate;
    other columns are not read. One projection: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary.get(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, ids, texts = zip(*(digests(table, t or "") for t in batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
