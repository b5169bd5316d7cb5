"""Every operator against brute force, on small and awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import fingerprints, jaccard, lines, mixing, packing, quality, rollups, suffixes, toxicity, vectors
from tidebook.llm.common import shared_dir
from tidebook.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASH = ["k", "n", "row", "start", "slot", "order", "size", "key", "component", "score", "tokens", "bucket", "x", "id", "near", "copies"]
rng = np.random.default_rng(5)
WORDS = ["the", "Of", "sea", "ñandú", "straße", "x1", "42", "end.", "blue,", "wind", "über", "tide"]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = "\n".join(prose(20) for _ in range(1500))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g"), (6, "A b C d e f g"), (6, "A b C d e f g"), (7, LONG), (None, "a b c d e f g"), (None, None),
    (8, LONG + " tail"), (9, "<|endoftext|> x  y\n\nz "), (10, prose(30) + " " + PASSAGE + " " + prose(30)), (11, PASSAGE), (12, prose(3) + "\n" + PASSAGE + "\n" + PASSAGE),
    (13, "ha " * 400), (14, "z" * 1200), (15, "one two three four"), (16, "one two three four"), (-3, "\u0000 nul   ünï\U0001F600 " + prose(9)),
]


def frame(spark, texts, clash=True):
    rows = [(i, t, "en", None if i == 4 else f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# ---- packing


def test_packing_round_trip(awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(awkward).collect()
    want = collections.Counter()
    for i, text in TEXTS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[(i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_packing_in_order(spark, awkward, empty):
    assert packing.pack_in_order(empty).count() == 0
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(packing.pack_in_order(awkward, run_rows=4), *columns) == rows(packing.pack_documents(awkward), *columns)
    docs = spark.createDataFrame([(i, prose(int(rng.integers(1, 400))), "en", "s", 1) for i in range(600)], SCHEMA).repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    got = packing.pack_in_order(docs, run_rows=100).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, r.doc_id))
    assert sorted(by) == list(range(len(by)))
    first = [min(d for *_, d in by[s]) for s in sorted(by)]
    assert first == sorted(first) and all(len({d // 100 for *_, d in parts}) == 1 for parts in by.values())
    for parts in by.values():
        assert [o for o, *_ in sorted(parts)] == list(np.cumsum([0, *(n for _, n, _ in sorted(parts))])[:-1]) and sum(n for _, n, _ in parts) <= 2048


def test_encoder_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder.get("byte_bpe_50k")
    for text in [" lead", "trail ", "a  b", "a \n b", "a\tb c", "it's we'll\n\nx", "é1 ½ x y z", "tab\t two", "a\n b", " ", "\n", "x y  ", "in. The\r\nend of"]:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_plan_uses_every_piece_and_pads_little():
    lengths = np.minimum(np.ceil(np.exp(rng.normal(6, 1, 5000)) / 8), 256).astype(int)
    histogram = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    used, sequences = collections.Counter(), 0
    for parts, times in packing.plan(histogram, 256):
        assert sum(parts) <= 256
        sequences += times
        for b in parts:
            used[b] += times
    assert used == histogram and lengths.sum() / (sequences * 256) > 0.99
    a = rng.random((8, 20))
    x = packing.nnls(a, a @ np.maximum(rng.normal(size=20), 0))
    slope = a.T @ (a @ x) - a.T @ (a @ x)
    assert (x >= 0).all() and np.allclose(slope, 0)


# ---- suffixes


def brute_repeats(texts, length=400):
    seen = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in data:
        gone = np.zeros(len(b) + length, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot_texts", [20_000, 2])
def test_suffixes(spark, awkward, empty, monkeypatch, hot_texts):
    monkeypatch.setattr(suffixes, "HOT_TEXTS", hot_texts)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(suffixes.remove_repeats(awkward), *columns) == brute_repeats(TEXTS)
    assert suffixes.remove_repeats(empty).count() == 0
    # Overlapping windows of many lengths around the limit, and a hot passage.
    block = "".join(chr(97 + c) for c in rng.integers(0, 26, 1500))
    texts = [(i, prose(20) + block[a : a + n] + prose(20)) for i, (a, n) in enumerate([(0, 399), (0, 400), (5, 401), (300, 800), (700, 700), (1100, 400)] * 3)]
    texts += [(100 + i, prose(40) + PASSAGE[:420] + prose(int(rng.integers(1, 60)))) for i in range(60)]
    assert rows(suffixes.remove_repeats(frame(spark, texts)), *columns) == brute_repeats(texts)


# ---- fingerprints


def test_fingerprints(awkward, empty):
    found = collections.Counter()
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in TEXTS)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = (set(fingerprints.digests(x).tolist()) for x in (t, edited, following))

        def near(u, v):
            return round(len(u & v) / len(u | v), 9) if u | v else 1.0

        found[(None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), near(a, b), near(a, c))] += 1
    result = fingerprints.describe(awkward).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in result) == found
    prints = {r.doc_id: r.fingerprint for r in result}
    assert prints[15] == prints[16] and prints[10] != prints[11]
    assert fingerprints.describe(empty).count() == 0


def test_pieces_realign_after_an_insertion():
    words = prose(400).split()
    a = fingerprints.digests(" ".join(words))
    for at in (3, 150):
        b = fingerprints.digests(" ".join([*words[:at], "inserted", *words[at:]]))
        assert len(np.intersect1d(a, b)) > 0.9 * len(np.union1d(a, b))


def test_peeling_recovers_any_difference():
    for n in (0, 1, 5, 60, 3000):
        a, b = (np.unique(rng.integers(1, 2**62, n).astype(np.uint64)) for _ in range(2))
        both = np.unique(rng.integers(1, 2**62, 50).astype(np.uint64))
        plus, minus = fingerprints.differences([np.union1d(a, both)], [np.union1d(b, both)])
        assert (plus[0], minus[0]) == (len(a), len(b))


# ---- n-gram Jaccard join


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(texts):
    parent = {i: i for i, _ in texts if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, word_sets(t)) for i, t in texts]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b) and a:
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return collections.Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def test_jaccard(spark, awkward, empty):
    columns = ["doc_id", "n_shingles", "component_id"]
    assert rows(jaccard.similar_documents(awkward), *columns) == brute_components(TEXTS)
    assert jaccard.similar_documents(empty).count() == 0
    # Chains of edits, around the limit, and a passage that most documents share.
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(6, 60))))
        for _ in range(8):
            texts.append((len(texts), " ".join([*base, *PASSAGE.split()[: 10 * (g % 3)]])))
            base[int(rng.integers(len(base)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                base.insert(int(rng.integers(len(base))), "added")
    df = frame(spark, texts)
    want = brute_components(texts)
    assert rows(jaccard.similar_documents(df), *columns) == want
    kept = {r.doc_id for r in jaccard.first_of_groups(df).collect()}
    assert kept == {i for i, _, c in want if i == c} and jaccard.first_of_groups(df).columns == df.columns


def test_jaccard_pairs_need_more_than_one_shared_shingle(spark, monkeypatch):
    """Documents that share a passage with every other one are no candidates; an edited copy of one of them is."""
    texts = []
    for i in range(16):
        parts = [[f"own{i}_{j}_{k}" for k in range(60)] + [f"both{min(i, j)}_{max(i, j)}_{k}" for k in range(9)] for j in range(16) if j != i]
        texts.append((i, " ".join(w for p in parts for w in p)))
    made = {}
    real = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: made.setdefault(label, real(df, label)))
    columns = ["doc_id", "n_shingles", "component_id"]
    texts.append((99, texts[3][1].replace("own3_7_", "new")))
    assert rows(jaccard.similar_documents(frame(spark, texts)), *columns) == brute_components(texts)
    assert [i for i, _, c in brute_components(texts) if c == 3] == [3, 99]
    assert {r.id for r in made["texts"].collect()} == {3, 99}


def test_jaccard_links_around_the_limit(spark):
    """Sets of every size from 1 on, with subsets and replaced parts just above and below the limit, and frequent shingles."""
    draw = np.random.default_rng(11)
    texts, at = [], 0
    for n in [*range(1, 26), 40, 61, 97]:
        base = [f"g{n}_{k}" if draw.random() < 0.6 else f"often{k % 7}" for k in range(n + 4)]
        for keep in (1.0, 0.8, 0.78, 0.76, 0.75, 0.74, 0.72):
            texts.append((at, " ".join(base[: max(1, round((n + 4) * keep))])))
            edited = list(base)
            edited[:: max(1, round(5 / (1.001 - keep)))] = [f"e{at}"] * len(edited[:: max(1, round(5 / (1.001 - keep)))])
            texts.append((at + 1, " ".join(edited)))
            at += 2
    assert rows(jaccard.similar_documents(frame(spark, texts)), "doc_id", "n_shingles", "component_id") == brute_components(texts)


def test_jaccard_pairs_meet_once_per_run(spark):
    """Groups that share 60 elements in a row, and 20 after others, meet twice, not 80 times."""
    row = lambda g, e, before, left: (e, before, g, 150, left, g, g)
    runs = {1: [*range(60), 100, *range(60, 80)], 2: [*range(60), 200, *range(60, 80)]}
    data = [row(g, e, es[i - 1] if i else None, 100 - i) for g, es in runs.items() for i, e in enumerate(es)]
    rest = spark.createDataFrame(data, "element long, before long, g long, n long, left long, c0 long, c1 long")
    assert [tuple(r) for r in jaccard._meetings(rest).collect()] == [(1, 150, 2, 150)] * 2


def test_jaccard_few_texts_are_shuffled(spark, monkeypatch):
    """Few ids are sent to the texts; of more a bitmap is, and texts without an id among them stay where they are."""
    texts = spark.range(20_000).select("id", F.concat(F.lit("text"), "id").alias("text"))
    ids = spark.createDataFrame([(i, i % 3) for i in [*range(0, 20_000, 199), 5, 5, 30_000, -1]], "id long, a int")
    want = sorted((i, f"text{i}", a) for i, a in ids.collect() if 0 <= i < 20_000)
    monkeypatch.setattr(jaccard, "BITS", 1 << 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (1000, 10):
            monkeypatch.setattr(jaccard, "SENT", sent)
            got = jaccard._with_texts(ids, texts).select("id", "text", "a")
            assert sorted(map(tuple, got.collect())) == want
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and ("SortMergeJoin" in plan) == (sent == 10)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    columns = ["doc_id", "n_shingles", "component_id"]
    monkeypatch.setattr(jaccard, "SENT", 0)
    assert rows(jaccard.similar_documents(frame(spark, TEXTS)), *columns) == brute_components(TEXTS)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 140), (140, 120), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 120: 100, 140: 100}


# ---- vectors


def test_vectors(spark):
    base = rng.normal(size=(300, 16))
    noisy = base[:150] + 0.1 * rng.normal(size=(150, 16))
    hot = base[0] + 0.05 * rng.normal(size=(60, 16))
    x = np.concatenate([base, noisy, hot, base[:5], base[:5]]).astype(np.float32)
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    data = [(i, v.tolist(), 3) for i, v in enumerate(x)] + [(5000 + i, v, 1) for i, v in enumerate(bad)] + [(None, x[0].tolist(), 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rep int").repartition(3)
    got = {r.vec_id: r for r in vectors.near_copies(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    degree = near.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.9 * degree.sum()
    assert all(got[5000 + i].n_links == 0 and got[5000 + i].kept and got[5000 + i].component_id == 5000 + i for i in range(len(bad)))
    assert got[None].n_links == 0 and got[None].kept and len(got) == len(data)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x))) and got[510].component_id == 0
    assert vectors.near_copies(df.limit(0)).count() == 0


# ---- mixing


def test_mixing(spark, awkward, empty):
    got = mixing.mix(awkward, block_chars=50).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in TEXTS)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns
    assert rows(mixing.mixed(awkward, block_chars=50), *awkward.columns) == rows(awkward, *awkward.columns)


def test_less_than_one_block_off(spark):
    sizes = {"a": 900, "b": 300, "c": 40, None: 10}
    texts = [(i, "x" * 10, "en", s, 10) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(texts, SCHEMA), {"a": 5, "b": 3, "c": 1, None: 1.5}, block_chars=10, frame=97).collect()
    share, slots = {"a": 5 / 10.5, "b": 3 / 10.5, "c": 1 / 10.5, None: 1.5 / 10.5}, collections.defaultdict(list)
    for r in got:
        slots[r.source].append(r.slot)
    assert len({r.slot for r in got}) == len(got)
    for source, taken in slots.items():
        taken.sort()
        quota = sum(s < 97 * 3 for s in taken) / (97 * 3) if max(taken) >= 97 * 3 else None
        q = quota if quota else share[source]
        for t in range(1, max(taken) + 1):
            assert abs(np.searchsorted(taken, t) - t * q) < 1 + 1e-9 or quota is None
        if quota:
            assert abs(quota - share[source]) < 1.5 / 97


def off_by(taken, share):
    """The largest distance of a source's blocks from its share, after any number of slots."""
    taken, nth = np.sort(np.array(taken)), np.arange(len(taken))
    return max(np.abs(nth - taken * share).max(), np.abs(nth + 1 - (taken + 1) * share).max())


def test_target_weights_are_followed(spark):
    sizes = {"a": 10_000, "b": 6_000, "c": 4_000, "none": 5}
    texts = [(i, "x" * 10, "en", s, 10) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(texts, SCHEMA), {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0}, block_chars=10).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.source].append(r.slot)
    assert len({r.slot for r in got}) == len(got) == 20_005
    assert all(off_by(slots[s], share) < 1 + 1e-9 for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert min(slots["none"]) > max(max(slots[s]) for s in "abc")


def test_many_sources():
    n = 10_000
    weights, slots = [0.5, *[0.5 / (n - 1)] * (n - 1)], collections.defaultdict(list)
    for s, _, slot in mixing.schedule(weights, [n, *[1] * (n - 1)]):
        slots[s].append(slot)
    assert len(slots) == n and all(off_by(taken, weights[s]) < 1 + 1e-9 for s, taken in slots.items())
    assert len(list(mixing.schedule([0.0, 0.0], [2, 3]))) == 5 and list(mixing.schedule([], [])) == []


# ---- lines


def test_lines(spark, awkward, empty):
    report = lines.line_report(awkward).collect()
    assert collections.Counter(r.doc_id for r in report) == collections.Counter(i for i, _ in TEXTS) and lines.line_report(empty).count() == 0
    assert lines.drop_recurring(awkward).columns == awkward.columns
    docs = [(i, f"{prose(9)} first{i}\nServed by host{i} in {i} ms at {i}:{i}\n{prose(9)} last{i}") for i in range(30)]
    copies = [(100 + i, "Same start of it all\nA line that every copy has\nSame end of it all") for i in range(50)]
    kept = {r.doc_id: r.text for r in lines.drop_recurring(frame(spark, docs + copies)).collect()}
    for i, text in docs:
        before, _, after = text.split("\n")
        assert kept[i] == f"{before}\n{after}"
    assert all(kept[i] == text for i, text in copies)
    changed = lines.drop_recurring(frame(spark, docs)).where("n_chars <> length(text)")
    assert changed.count() == 0


def test_blocks_of_recurring_lines(spark):
    block, foot = "Some Licence of the coast\nGranted to all who sail by\nWithout any warranty at all", "Printed at the harbour office"
    docs = [(i, f"{block}\n{prose(12)} a{i}\n\n{foot}\n\n{prose(12)} b{i}") for i in range(40)]
    common = [f"{prose(10)} line{n}" for n in range(20)]
    copies = [(100 + i, "\n".join(f"{x} edit{i}" if n == i % 20 else x for n, x in enumerate(common))) for i in range(60)]
    works = ["\n".join(f"{prose(10)}" for _ in range(12)) for _ in range(2)]
    few = [(200 + i, f"A line of only two works\n{works[i // 5]}\nedit{i}") for i in range(10)]
    kept = {r.doc_id: r.text for r in lines.drop_recurring(frame(spark, docs + copies + few)).collect()}
    for i, text in docs:
        rows_ = text.split("\n")
        assert kept[i] == "\n".join([rows_[3], "", "", rows_[7]])
    assert [i for i, text in copies + few if kept[i] != text] == []


def test_short_lines(spark):
    docs = [(i, f"{prose(9)} first{i}\nAll rights reserved.\n{prose(9)} mid{i}\nPage {i}\n{prose(9)} last{i}") for i in range(30)]
    kept = {r.doc_id: r.text for r in lines.drop_recurring(frame(spark, docs)).collect()}
    for i, text in docs:
        assert kept[i] == text.replace("\nAll rights reserved.", "")


# ---- token counts


def test_rollup(spark, awkward, empty):
    rollup = rollups.TokenRollup(spark, shared_dir(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    counts = rollups.pattern_counts(F.col("text"))
    arrived = rollups.long_form(awkward, counts, "insert")
    assert rollup.commit("a", arrived) and not rollup.commit("a", arrived)
    want = collections.Counter()
    for i, t in TEXTS:
        key = (None if i == 4 else f"src{(i or 0) % 3}", "en")
        want[(*key, "words-1", "docs")] += 1
        want[(*key, "words-1", "tokens")] += len(re.findall(rollups.WORDS, t or ""))

    def totals(r):
        found = collections.Counter()
        for x in r.totals().where("tokenizer = 'words-1'").collect():
            found[(x.source, x.lang, "words-1", "docs")], found[(x.source, x.lang, "words-1", "tokens")] = x.docs, x.tokens
        return found

    assert totals(rollup) == want
    five = awkward.where("doc_id = 5")
    assert rollup.commit("b", rollups.long_form(five, {"words-1": F.lit(3)}, "revise", before={"words-1": F.lit(7)}))
    want[("src2", "en", "words-1", "tokens")] -= 4
    assert totals(rollup) == want
    smaller = rollup.compact(shared_dir(spark, "rollup-test"))
    assert totals(smaller) == want and not smaller.commit("b", arrived)
    smaller.commit("c", rollups.long_form(awkward.where("text IS NULL OR doc_id IS NOT NULL OR doc_id IS NULL"), counts, "delete"))
    assert totals(smaller)[("src2", "en", "words-1", "docs")] == 0
    rollup.commit("empty", rollups.long_form(empty, counts, "insert"))
    assert totals(rollup) == want
    with pytest.raises(Exception, match="unknown kind"):
        rollups.deltas(arrived.withColumn("kind", F.lit("other"))).collect()


# ---- classifiers


def test_rules_of_a_tree():
    text = "Tree\n  If (feature 3 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 3 > 0.5)\n   Predict: 1.0"
    inf = float("inf")
    assert quality.rules_of(text) == {((3, -inf, 0.5),), ((1, -inf, 2.0), (3, -inf, 0.5)), ((1, 2.0, inf), (3, -inf, 0.5)), ((3, 0.5, inf),)}


def test_classifiers_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for module in (quality, toxicity):
            found = module.scores(awkward, module.fit(awkward, labels)).collect()
            assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
            assert {r.held_out for r in found if r.doc_id is not None} == {True, False}
    assert quality.scores(empty, quality.RuleModel(0.0, ())).count() == 0
    assert quality.keep(awkward, quality.RuleModel(3.0, ())).columns == awkward.columns


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([("Ab ab ab\nx | 12!",), (None,)], "text string").select(quality.statistics(F.col("text")).alias("s")).select("s.*")
    a, b = df.collect()
    assert (a.chars, a.words, a.lines, a.repeats, a.distinct_words) == (16, 6, 2, 1 / 6, 5 / 6) and a.bare_words == 2 / 6
    assert a.upper == 1 / 16 and a.digits == 2 / 16 and a.symbols == 2 / 16 and b.chars == 0 and b.words == 0


def test_noisy_or_finds_the_sentence(spark):
    texts, labels = [], []
    for i in range(300):
        parts = [prose(6).replace(".", "") + "." for _ in range(6)]
        if i % 4 == 0:
            parts[i % 5] = f"you are a vilething{'s' if i % 8 else ''} {prose(3)}.".replace("..", ".")
        texts.append((i, " ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.scores(docs, toxicity.fit(docs, marks)).collect()}
    for i, text in texts:
        r = found[i]
        assert r.predicted == int(i % 4 == 0), (i, r)
        if i % 4 == 0:
            assert "vilething" in text[r.worst_start : r.worst_start + r.worst_length] and r.n_offending >= 1


def test_a_repeated_document_counts_once(spark):
    texts = [(i, f"A calm line here. {'Some vile thing' if i % 3 == 0 else 'More of the sea'}. {prose(5)}") for i in range(60)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    many = frame(spark, texts + [t for t in texts if t[0] < 5] * 30)
    assert toxicity.fit(many, marks) == toxicity.fit(frame(spark, texts), marks)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for module, label, least in ((quality, "quality", 0.95), (toxicity, "toxic", 0.9)):
        found = module.scores(docs, module.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert np.mean([r[0] == r[1] for r in found]) >= least
