"""Repeatable sampling: a seeded hash of the row key replaces a random generator.

The outcome does not depend on partitioning or on a task being run again. MD5 is used
because every SQL engine computes it alike, so a split can be reproduced anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: str) -> Column:
    """Hex digest of ``seed|key|..``: a fixed random order of the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_share(seed: int, *keys: str) -> Column:
    """A number in [0, 1) per key: the first 32 bits of the digest."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_below(share: float, digest: Column, word: int = 0) -> Column:
    """True for that share of the digests. Hex words compare like numbers, so nothing is converted.

    A digest holds four independent words (0..3).
    """
    if share >= 1:
        return F.lit(True)
    return F.substring(digest, 1 + 8 * word, 8) < F.lit(f"{math.ceil(share * (1 << 32)):08x}")


def shuffle_rows(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(hash_order(seed, *keys), *keys)


def sample_one_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """One row per group: an aggregate, so a hot group is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in group]
    pick = F.min_by(F.struct(*rest), F.struct(hash_order(seed, *group, *keys), *keys)).alias("__r")
    return df.groupBy(*group).agg(pick).select(*group, "__r.*").select(*df.columns)


def sample_k(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(hash_order(seed, *keys), *keys).limit(k)


def split(df: DataFrame, test_share: float, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    tested = hash_below(test_share, hash_order(seed, *keys))
    return df.where(~tested), df.where(tested)
