"""Kernel densities of groups of any size: values are spread over fine bins, bins over the places of the curve, and both steps are sums that combine before they are shuffled.

Between two bins a value is shared out linearly, which errs by the square of a bin's width; a bin is a ``FINE``-th of the kernel's width.  Kernels reach ``REACH`` widths, beyond which
they are under 1e-15 of their peak.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import attached, exact_quantiles, stored

FINE, REACH, POINTS = 512, 8.5, 512


def _keyed(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values with their group as text, so that a null group is one too."""
    return df.where(F.col(value).isNotNull()).select(F.to_json(F.struct(F.col(group).alias("g"))).alias("_k"), F.col(group).alias("_group"), F.col(value).cast("double").alias("_v"))


def _frames(d: DataFrame, points: int) -> DataFrame:
    """Per key: n, the kernel's width by the rule of thumb, where the curve begins and the step between its places."""
    quartiles = exact_quantiles(d, "_k", "_v", {"_q1": 0.25, "_q3": 0.75}).drop("n")
    own = d.groupBy("_k").agg(F.count("*").alias("_n"), F.stddev_samp("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.first("_group").alias("_group"))
    sd = F.coalesce("_sd", F.lit(0.0))
    spread = F.least(sd, (F.col("_q3") - F.col("_q1")) / 1.34)
    width = F.when(spread > 0, spread).when(sd > 0, sd).when(F.abs("_min") > 0, F.abs("_min")).otherwise(1.0)
    f = own.join(quartiles, "_k").withColumn("_h", 0.9 * width * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    return f.withColumn("_lo", F.col("_min") - 3 * F.col("_h")).withColumn("_step", (F.col("_max") + 3 * F.col("_h") - F.col("_lo")) / (points - 1))


def curves(df: DataFrame, group: str, value: str, points: int = POINTS) -> DataFrame:
    """group, place (from 0), x and density: the Gaussian kernel density of each group at evenly spaced places, three widths beyond its values on both sides; null values don't count."""
    d = _keyed(df, group, value)
    frames = stored(_frames(d, points))
    counts = d.groupBy("_k", "_v").agg(F.count("*").alias("_c"))
    total = frames.agg(F.sum("_n")).first()[0] or 0
    spread = attached(counts, frames.drop("_group"), ["_k"], "_n", total)
    at = (F.col("_v") - F.col("_lo")) / (F.col("_h") / FINE)
    low = F.floor(at)
    both = F.array(F.struct(low.alias("b"), (F.col("_c") * (1 - (at - low))).alias("w")), F.struct((low + 1).alias("b"), (F.col("_c") * (at - low)).alias("w")))
    bins = spread.select("_k", "_h", "_lo", "_step", F.explode(both).alias("x")).groupBy("_k", "_h", "_lo", "_step", F.col("x.b").alias("_b")).agg(F.sum("x.w").alias("_w"))
    x = F.col("_b") * F.col("_h") / FINE  # from the curve's beginning
    first, last = F.greatest(F.ceil((x - REACH * F.col("_h")) / F.col("_step")), F.lit(0)), F.least(F.floor((x + REACH * F.col("_h")) / F.col("_step")), F.lit(points - 1))
    parts = bins.where("_w > 0").select("_k", "_h", "_step", "_w", x.alias("_x"), F.explode(F.sequence(first, last)).alias("place"))
    off = (F.col("place") * F.col("_step") - F.col("_x")) / F.col("_h")
    sums = parts.groupBy("_k", "place").agg(F.sum(F.col("_w") * F.exp(-0.5 * off * off)).alias("_s"))
    grid = frames.select("_k", "_group", "_n", "_h", "_lo", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("place"))
    density = F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return grid.join(sums, ["_k", "place"], "left").select(F.col("_group").alias(group), F.col("place").cast("int").alias("place"), (F.col("_lo") + F.col("place") * F.col("_step")).alias("x"), density.alias("density"))


def modes(df: DataFrame, group: str, value: str, points: int = POINTS) -> DataFrame:
    """group and mode: where its density is highest, the first place of equals."""
    return curves(df, group, value, points).groupBy(group).agg(F.max_by("x", F.struct("density", -F.col("place"))).alias("mode"))
