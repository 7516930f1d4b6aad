"""Fisher's exact test and false-discovery-rate control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import attached, placed, running, stored


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table ((a, b), (c, d)): the mass of the tables with its margins that are no likelier.

    The log weight of a table follows from its neighbour's, so each of two passes over the tables is one aggregate: the first
    finds the greatest weight and that of the table itself, the second sums.  Nothing is kept per table.  Null counts give null.
    """
    long = lambda x: x.cast("long")
    margins = F.struct(long(a).alias("a"), long(a + b).alias("row"), long(a + c).alias("col"), long(a + b + c + d).alias("n"))

    def next_weight(m: Column, x: Column, w: Column) -> Column:
        ratio = ((m["row"] - x) * (m["col"] - x)).cast("double") / ((x + 1) * (m["n"] - m["row"] - m["col"] + x + 1)).cast("double")
        return w + F.log(ratio)

    def tables(m: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0).cast("long"), m["row"] + m["col"] - m["n"]), F.least(m["row"], m["col"]))

    def peak(m: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("top"), F.lit(0.0).alias("own"))

        def step(s: Column, x: Column) -> Column:
            return F.struct(F.coalesce(next_weight(m, x, s["w"]), F.lit(0.0)).alias("w"), F.greatest(s["top"], s["w"]).alias("top"), F.when(x == m["a"], s["w"]).otherwise(s["own"]).alias("own"))

        return F.aggregate(tables(m), start, step)

    def mass(m: Column, p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("all"), F.lit(0.0).alias("rare"))

        def step(s: Column, x: Column) -> Column:
            e = F.exp(s["w"] - p["top"])
            return F.struct(F.coalesce(next_weight(m, x, s["w"]), F.lit(0.0)).alias("w"), (s["all"] + e).alias("all"), (s["rare"] + F.when(s["w"] <= p["own"] + 1e-7, e).otherwise(0.0)).alias("rare"))

        return F.aggregate(tables(m), start, step, lambda s: F.least(F.lit(1.0), s["rare"] / s["all"]))

    # one-element arrays bind a value once for all steps of the lambdas
    whole = F.transform(F.array(margins), lambda m: F.transform(F.array(peak(m)), lambda p: mass(m, p))[0])[0]
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull(), whole)


def adjusted(df: DataFrame, p: str, out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg over one row per test; null p stays null and doesn't count.

    The distinct values are placed in order by range partitions; how many tests have at most each value, and the least scaled value from it on, are running
    values over those.  No task sees all tests, and a value that many tests share (1, most often) is joined back by broadcast."""
    tests = stored(df)
    values = placed(tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "_p", place="_place", part="_part")
    total = values.agg(F.sum("_n")).first()[0] or 0
    ranked = running(values, "_n", "_rank", place="_place", part="_part").withColumn("_q", F.col("_p") * total / F.col("_rank"))
    least = running(ranked, "_q", "_least", "min", backwards=True, place="_place", part="_part")
    table = least.select(F.col("_p").alias(p), F.col("_n"), F.least(F.lit(1.0), "_least").alias(out))
    return attached(tests, table, [p], "_n", total)
