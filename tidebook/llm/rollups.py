"""Token totals by source, language and tokenizer version, maintained from signed changes.

A batch of changes becomes one small table of signed deltas (documents and tokens per key),
which only counts once its commit record is there. A batch id that is already committed is
not applied again; a batch that failed half-way left a delta without a record, which nobody
reads. Totals are the sum of the committed deltas, so batches may come in any order, and
``compact`` may fold them into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import materialize

KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
_COMMIT = "batch string, path string"

WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]"


def pattern_counts(text: Column) -> dict[str, Column]:
    """Counters of two tokenizer versions that are one pattern each: words, and words, digits and signs."""
    t = F.coalesce(text, F.lit(""))
    return {"words-1": F.regexp_count(t, F.lit(WORDS)).cast("long"), "pieces-1": F.regexp_count(t, F.lit(PIECES)).cast("long")}


def long_form(counted: DataFrame, counts: Mapping[str, Column], kind: str, before: Mapping[str, Column] | None = None) -> DataFrame:
    """Changes of one kind, a row per document and tokenizer: source, lang, tokenizer, kind, tokens, tokens_before.

    ``insert`` has new counts, ``delete`` the counts of what goes, ``revise`` both.
    """
    none = F.lit(None).cast("long")
    cells = [
        F.struct(
            F.lit(name).alias("tokenizer"), (none if kind == "delete" else value).cast("long").alias("tokens"),
            ((before or counts)[name] if kind != "insert" else none).cast("long").alias("tokens_before"),
        )
        for name, value in counts.items()
    ]
    return counted.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(kind).alias("kind"), F.inline(F.array(*cells)))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed documents and tokens per key. NULL counts are 0, NULL sources and languages are keys of their own.

    Every row counts, repeated ones again; other kinds of change are an error. Tasks add up
    their rows before the shuffle, so a source with a third of all rows is no hot spot.
    """
    kind, new, old = F.col("kind"), F.coalesce("tokens", F.lit(0)), F.coalesce("tokens_before", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("NULL")))).cast("long")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown)
    tokens = F.when(kind == "insert", new).when(kind == "delete", -old).otherwise(new - old)
    rows = changes.select(*KEYS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """Totals in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> dict[str, str]:
        """Batch ids and the folders of their deltas (one row per batch goes through the driver)."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        return {r["batch"]: r["path"] for r in self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes; False, without reading them, if the batch is already committed."""
        if batch in self.committed():
            return False
        folder = f"{self.path}/deltas/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(folder)
        self.spark.createDataFrame([(batch, folder)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys without documents are left out."""
        folders = sorted(set(self.committed().values()))
        rows = self.spark.read.schema(_DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self, path: str) -> TokenRollup:
        """A copy in another folder with one delta, in which all batches so far count as committed."""
        other, batches = TokenRollup(self.spark, path), self.committed()
        folder = f"{other.path}/deltas/{uuid.uuid4().hex}"
        self.totals().write.parquet(folder)
        self.spark.createDataFrame([(b, folder) for b in batches], _COMMIT).coalesce(1).write.mode("append").parquet(f"{other.path}/commits")
        return other


def history(docs: DataFrame, rollup: TokenRollup, remark: str) -> TokenRollup:
    """Commit the life of a table: all rows come, repeats of a text go, texts with ``remark`` are counted without it.

    Of rows with equal texts the one with the smallest id stays (all rows of that id; a NULL id
    is largest). The first batch is sent twice, as after a lost answer.
    """
    text = F.coalesce("text", F.lit(""))
    changed = text.contains(remark)
    first, second = pattern_counts(text), pattern_counts(F.replace(text, F.lit(remark), F.lit("")))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), "source", "lang", F.md5(text.cast("binary")).alias("k"), changed.alias("changed"),
        *[c.alias(f"a_{n}") for n, c in first.items()], *[F.when(changed, c).alias(f"b_{n}") for n, c in second.items()],
    )
    rows = materialize(rows, "counted")
    old, new = ({n: F.col(f"`{side}_{n}`") for n in first} for side in "ab")
    keep = rows.groupBy("k").agg(F.min("id").alias("keep"))
    marked = materialize(rows.join(keep, "k").withColumn("gone", F.col("id") > F.col("keep")), "marked")
    arrived = long_form(rows, old, "insert")
    for batch, changes in (
        ("1", arrived), ("2", long_form(marked.where("gone"), old, "delete")), ("1", arrived),
        ("3", long_form(marked.where("changed AND NOT gone"), new, "revise", before=old)),
    ):
        rollup.commit(batch, changes)
    return rollup
