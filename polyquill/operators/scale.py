"""Whole-table order, running values and joins to hot keys, without a task that sees all rows.

Order is by range partitions: each has its rows sorted, what the driver gets is one number a partition.  A join to a table with one row a key sends the few
keys that have many rows by broadcast, so that those rows stay where they are.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot: there are at most so many.
HOT_PARTS = 20_000
_BITS = 33  # monotonically_increasing_id: partition number above, place in the partition below


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="polyquill-"))
    return context.getCheckpointDir()


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores added until no column has it in any case of letters."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _per_part(df: DataFrame, aggregate: Column, part: str) -> dict[int, object]:
    return dict(df.groupBy(part).agg(aggregate).collect())  # one row a partition


def _with_carry(df: DataFrame, values: dict[int, object], part: str, out: str, kind: str) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(values.items()) or [(0, None)], f"{part} long, {out} {kind}")
    return df.join(F.broadcast(table), part, "left")


def placed(df: DataFrame, *order: str | Column, place: str = "place", part: str = "part") -> DataFrame:
    """The rows, stored, with their place (from 0) in the given order over the whole table, and the number of their range partition."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    d = stored(d.withColumn(part, F.shiftright(place, _BITS)).withColumn(place, F.col(place).bitwiseAND((1 << _BITS) - 1)))
    counts = _per_part(d, F.count("*"), part)
    before = dict(zip(sorted(counts), accumulate((counts[k] for k in sorted(counts)), initial=0)))
    return _with_carry(d, before, part, "_before", "long").withColumn(place, F.col(place) + F.col("_before")).drop("_before").select(*df.columns, place, part)


def running(df: DataFrame, value: str, out: str, how: str = "sum", backwards: bool = False, place: str = "place", part: str = "part") -> DataFrame:
    """A placed table with the sum (or min, max) of all values up to each row in order, or from it on; a window stays within its range partition."""
    f, plain = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, min), "max": (F.max, max)}[how]
    sign = -1 if backwards else 1
    own = _per_part(df, f(value), part)
    keys = [k for k in sorted(own, reverse=backwards) if own[k] is not None]
    carried = dict(zip(keys[1:], accumulate((own[k] for k in keys), plain)))
    # a partition without any value gets what came before it
    last = None
    for k in sorted(own, reverse=backwards):
        if k in keys:
            last = own[k] if last is None else plain(last, own[k])
        elif last is not None:
            carried[k] = last
    w = Window.partitionBy(part).orderBy(sign * F.col(place)).rowsBetween(Window.unboundedPreceding, 0)
    kind = df.select(f(value)).schema[0].dataType.simpleString()
    d = _with_carry(df.withColumn(out, f(value).over(w)), carried, part, "_carry", kind)
    both = {"sum": F.coalesce(F.col(out) + F.col("_carry"), out, "_carry"), "min": F.least(out, "_carry"), "max": F.greatest(out, "_carry")}[how]
    return d.withColumn(out, both).drop("_carry").select(*df.columns, out)


def attached(df: DataFrame, table: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Left join to a table with one row a key and, as ``n``, at least how many rows of df have it (in the measure of ``total``): hot keys by broadcast, others by shuffle.

    Rows with a null key find nothing.  df is read up to three times, so store it where it is dear."""
    extra = [c for c in table.columns if c not in keys and c != n]
    hot = F.col(n) * HOT_PARTS >= total
    whole = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    found = whole.join(F.broadcast(table.where(hot).drop(n).withColumn("_hot", F.lit(True))), list(keys), "left")
    cold = found.where("_hot is null").drop("_hot", *extra).join(table.where(~hot).drop(n), list(keys), "left")
    rest = df.where(" or ".join(f"`{k}` is null" for k in keys)).withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in extra})
    columns = [*df.columns, *extra]
    return found.where("_hot").select(*columns).unionByName(cold.select(*columns)).unionByName(rest.select(*columns))


def exact_quantiles(df: DataFrame, key: str, value: str, probabilities: dict[str, float]) -> DataFrame:
    """key, n and, under the names given, exact quantiles of a number by key (interpolated between the two nearest values).

    Counts of distinct values are placed in order over the whole table, so no key's values meet in one task.  Null values don't count; a null key has no row."""
    counts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = running(placed(counts, "_k", "_v", place="_place", part="_part"), "_c", "_upto", place="_place", part="_part")
    per_key = upto.groupBy("_k").agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"), F.count("*").alias("_rows"))
    d = attached(upto, per_key, ["_k"], "_rows", upto.count())
    after, before = F.col("_upto") - F.col("_base"), F.col("_upto") - F.col("_base") - F.col("_c")
    marks = []
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(at)
        for side, i in (("lo", low), ("hi", F.least(low + 1, F.col("_n") - 1))):
            marks.append(F.max(F.when((before <= i) & (i < after), F.col("_v"))).alias(f"_{side}_{name}"))
        marks.append(F.max(at - low).alias(f"_part_{name}"))
    found = d.groupBy("_k").agg(F.max("_n").alias("n"), *marks)
    return found.select(F.col("_k").alias(key), "n", *((F.col(f"_lo_{name}") + F.col(f"_part_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name) for name in probabilities))
