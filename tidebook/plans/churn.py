"""Company subscriptions: cleaned features and retention breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook import constants
from tidebook.operators import clean

TAX_CLASSES = ("osno", "envd", "usn_envd", "usn_rashod", "usn_dohod")


def tax_class(column: Column, labels: Mapping[str, str] = constants.TAX_LABELS) -> Column:
    """Five classes out of free-form tax systems. Written as ordered overwrites: the last one wins."""
    both = column.contains(labels["envd"]) & column.contains(labels["usn"])
    return clean.masked_assign(
        [
            (column == labels["osno"], F.lit("osno")),
            (column == labels["envd"], F.lit("envd")),
            (column.contains(labels["expense"]) & ~both, F.lit("usn_rashod")),
            (both, F.lit("usn_envd")),
        ],
        F.lit("usn_dohod"),
    )


def churn_features(companies: DataFrame, labels: Mapping[str, str] = constants.TAX_LABELS, floor: str = "2000-01-01", cap: int = 5000) -> DataFrame:
    """Cleaned company rows: tax class and flags, ages in days against the sample date, months."""
    rows = companies.dropna()
    rows = clean.sentinel_to_max(rows, "org_creation_date", F.lit(floor).cast("date"))
    sample_date = companies.dropna().agg(F.max("org_creation_date")).scalar()
    rows = rows.withColumns({
        "tax_class": tax_class(F.col("tax_system"), labels),
        "age_days": F.date_diff(sample_date, "org_creation_date"),
        "reg_age_days": clean.clip_upper(F.date_diff(sample_date, "regdt"), cap),
        "is_misdated": (F.col("org_creation_date") < F.col("regdt")).cast("int"),
    })
    rows = rows.withColumn("org_creation_date", F.greatest("org_creation_date", "regdt"))
    rows = rows.withColumns({"month": F.month("org_creation_date"), "reg_month": F.month("regdt"), "is_recent": (F.col("age_days") < 60).cast("int")})
    return clean.one_hot(rows, "tax_class", {c: c for c in TAX_CLASSES})


def churn_breakdown(features: DataFrame, dimensions: Sequence[str] = (
        "tax_class", "has_certificate", "documents_count", "worker_count", "month", "reg_month", "is_misdated")) -> DataFrame:
    """Companies by retention for every value of every dimension, over all and over the recent ones."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    scopes = F.when(F.col("is_recent") == 1, F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all")))
    long = features.select("is_prolong", F.explode(scopes).alias("scope"), "is_recent", cells.alias("cells")).select("scope", "is_prolong", F.inline("cells"))
    return long.groupBy("scope", "dimension", "value", "is_prolong").agg(F.count(F.lit(1)).alias("cnt"))
