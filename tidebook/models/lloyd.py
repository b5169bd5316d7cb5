"""k-means by Lloyd rounds: each round is one group-by of sums over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.sampling import hash_order
from tidebook.session import materialize

# Distances are compared after rounding, so that equal ones tie whatever the order of the sums.
DIGITS = 9


@dataclass
class Clusters:
    """Fitted centres, in scaled units; column ``i`` is scaled by ``shift[i]`` and ``scale[i]``."""

    columns: list[str]
    shift: list[float]
    scale: list[float]
    centres: list[list[float]]
    rounds: int

    def assign(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        """Number of the nearest centre, the first of equally near ones; NULL for a row with a NULL."""
        z = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.shift, self.scale)]
        nearest = _nearest(z, self.centres)[0]
        known = F.lit(True)
        for c in self.columns:
            known = known & F.col(c).isNotNull()
        return df.withColumn(out, F.when(known, nearest))


def _gap(z: Sequence[Column], centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, v in zip(z, centre):
        total = total + (c - F.lit(float(v))) * (c - F.lit(float(v)))
    return F.round(total, DIGITS)


def _nearest(z: Sequence[Column], centres: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """(number, distance) of the nearest centre."""
    gaps = F.array(*[_gap(z, c) for c in centres])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"), F.array_min(gaps)


def fit(df: DataFrame, columns: Sequence[str], key: str, k: int = 4, rounds: int = 100, seed: int = 1) -> Clusters:
    """Clusters of the standardised columns (population deviation; a constant column stays 0).

    The start does not depend on the order of rows: the row whose key hashes lowest, then again and
    again the row farthest from all centres so far (ties: highest hash). Rounds go on until no
    centre moves. An empty cluster keeps its centre; fewer distinct rows than ``k`` give equal
    centres, of which the first gets the rows. Rows with a NULL are left out.
    """
    rows = df.dropna(subset=list(columns))
    stats = rows.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    if stats[0] is None:
        return Clusters(list(columns), [0.0] * len(columns), [1.0] * len(columns), [[0.0] * len(columns)] * k, 0)
    shift, scale = list(stats[::2]), [s or 1.0 for s in stats[1::2]]
    names = [f"z{i}" for i in range(len(columns))]
    scaled = [((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(n) for c, m, s, n in zip(columns, shift, scale, names)]
    rows = materialize(rows.select(hash_order(seed, key).alias("h"), *scaled), "lloyd")
    z, point = [F.col(n) for n in names], F.struct(*names)
    centres = [list(rows.agg(F.min_by(point, F.struct("h", *names))).first()[0])]
    while len(centres) < k:
        centres.append(list(rows.agg(F.max_by(point, F.struct(_nearest(z, centres)[1], "h", *names))).first()[0]))
    done = 0
    for done in range(1, rounds + 1):
        means = rows.groupBy(_nearest(z, centres)[0].alias("c")).agg(*[F.avg(n) for n in names]).collect()
        moved = {r[0]: list(r[1:]) for r in means}
        new = [moved.get(i, c) for i, c in enumerate(centres)]
        still = all(abs(a - b) <= 1e-12 for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if still:
            break
    return Clusters(list(columns), shift, scale, centres, done)


def summary(df: DataFrame, model: Clusters) -> DataFrame:
    """Rows and unscaled column means per cluster."""
    return model.assign(df).where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("cnt"), *[F.avg(c).alias(c) for c in model.columns])
