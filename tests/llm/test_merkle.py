"""The Merkle manifest against a plain tree in Python."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidebook.llm import merkle
from tidebook.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, fanout):
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, a in enumerate(at):
            run = hashes[a // fanout * fanout :][:fanout]
            paths[i].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
        hashes = [sha("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
        at = [a // fanout for a in at]
    return paths, hashes[0]


def brute(rows, fanout=2):
    def leaf(r, n):
        return sha("".join(map(field, (r[0], r[3], r[2], n, r[1]))))

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for *_, leaf, _ in sorted(by[x], key=lambda t: t[:3])], fanout) for x in langs}
    upper, root = tree([trees[x][1] for x in langs], fanout)
    out = collections.Counter()
    for x, up in zip(langs, upper):
        for (*_, own, r), below in zip(sorted(by[x], key=lambda t: t[:3]), trees[x][0]):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, r[4] + 1) if tampered else own
            for a, b in below + up:
                h = sha(a + h + b)
            out[(r[0], own, trees[x][1], root, sha("".join(a + b for a, b in below + up)), h, h == root)] += 1
    return out


ROWS = [(None, None, None, None, None), (None, "a", None, "s", 1), (None, "a", None, "s", 1), (-7, "", "", "", 0), (10**12, "ñandú 😀\n\u0000", "de", "s", None)]
ROWS += [(i, f"text {i}", "en", None if i % 5 == 0 else "web", i) for i in range(90)]
ROWS += [(7, "again", "en", "web", 5)] * 9 + [(i, "x" * (i * 999), "zh", "s", 2**63 - 1) for i in range(5)] + [(1, "é", "É", "s", 1)]


@pytest.mark.parametrize("options", [{"levels": 3}, {"fanout": 3, "levels": 2}])
def test_equals_a_plain_tree(spark, options):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    for name in ("group", "pos", "h", "n", "block", "path", "top", "place", "copy", "leaf"):
        docs = docs.withColumn(name, F.lit(3))
    docs = materialize(docs, "merkle-test")
    got = collections.Counter(tuple(r) for r in merkle.manifest(docs, **options).collect())
    assert got == brute(ROWS, options.get("fanout", 2))


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[:3]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = merkle.manifest(docs)
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = collections.Counter(tuple(r) for r in frame.collect())
    assert got == (brute(rows) if rows else collections.Counter())


def test_any_change_is_found(spark):
    rows = ROWS[5:12]
    changed = [*rows[:-1], (*rows[-1][:1], "other", *rows[-1][2:])]
    assert merkle.manifest(spark.createDataFrame(rows[::-1], SCHEMA)).first().root != merkle.manifest(spark.createDataFrame(changed, SCHEMA)).first().root


def test_a_round_shuffles_once(spark):
    nodes = spark.range(5000).selectExpr("string(id % 2) AS group", "id div 2 AS pos", "string(id) AS h", "2500L AS n")
    plan = merkle.climb(nodes, 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("Sort [") == 1 and plan.count("Window [") == 11
