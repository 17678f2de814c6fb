"""Deterministic orders and samples that depend on ids and a seed alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import stable_hash


def seeded_order(seed: str, id_col: str = "finding_id") -> Column:
    """What to sort by for an order that looks random and is the same in every run."""
    return stable_hash(seed, F.col(id_col))


def shuffled(rows: DataFrame, seed: str, id_col: str = "finding_id") -> DataFrame:
    return rows.orderBy(seeded_order(seed, id_col))


def with_position(rows: DataFrame, seed: str, id_col: str = "finding_id", name: str = "position") -> DataFrame:
    """The place of each row, from 0, in the seeded order.

    Ids are unique, so ranks are counted without one global window: rows are
    numbered within buckets of the hash's first digits, and the buckets'
    counts, at most 65,536 of them, give the offsets.
    """
    hashed = rows.withColumn("_h", seeded_order(seed, id_col)).withColumn("_b", F.left("_h", F.lit(4)))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h")))
    return ranked.join(F.broadcast(before), "_b").withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_h", "_b", "_r", "_before")


def bottom_share(rows: DataFrame, fraction: float, seed: str, id_col: str = "finding_id") -> DataFrame:
    """The first ``ceil(n * fraction)`` rows of the seeded order, one at least if there is any."""
    n = rows.count()
    k = min(n, max(1, math.ceil(n * fraction)))
    return with_position(rows, seed, id_col, "_p").filter(F.col("_p") < k).drop("_p")


def systematic(rows: DataFrame, size: int, seed: str, id_col: str = "finding_id") -> DataFrame:
    """``size`` rows at equal steps of the seeded order, each chosen with the same
    probability; ``sample_weight`` is how many rows each stands for."""
    n = rows.count()
    if size >= n:
        return rows.withColumn("sample_weight", F.lit(1.0))
    step = F.floor((F.col("_p") + 1) * size / F.lit(n)) > F.floor(F.col("_p") * size / F.lit(n))
    return with_position(rows, seed, id_col, "_p").filter(step).drop("_p").withColumn("sample_weight", F.lit(n / size))
