"""Relational operators on the read table and the residue table.  Column names are arguments; every result is lazy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(groups: str | Sequence[str] | None) -> list[str]:
    return [] if groups is None else [groups] if isinstance(groups, str) else list(groups)


def require(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def validated(df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = (), not_empty: bool = False, not_null: Sequence[str] = ()) -> DataFrame:
    """The table, if it has these columns of these kinds, a row (if it must), and no null where none may be; otherwise an error that names all that is wrong."""
    require(df, [*numbers, *texts, *not_null])
    kind = {f.name: f.dataType.typeName() for f in df.schema}
    wrong = [f"{c} must be a number, not {kind[c]}" for c in numbers if kind[c] not in _NUMBERS]
    wrong += [f"{c} must be text, not {kind[c]}" for c in texts if kind[c] not in ("string", "varchar", "char")]
    if not_empty and not df.take(1):
        wrong.append("the table is empty")
    if not_null:
        found = df.select(*(F.col(c).isNull().alias(c) for c in not_null)).agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in not_null)).first()
        wrong += [f"{c} has nulls" for c in not_null if found[c]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def two_levels(df: DataFrame, group: str) -> tuple:
    """The two values of a grouping column, in order; an error if it hasn't exactly two."""
    found = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(3).collect()]
    if len(found) != 2:
        raise ValueError(f"{group} must have two levels, not {'more' if len(found) > 2 else len(found)}")
    return tuple(sorted(found))


def count_by(df: DataFrame, column: str, groups: str | Sequence[str] | None = None) -> DataFrame:
    """Rows per class, comment, residue or quality tag, and group: n."""
    require(df, [*_by(groups), column])
    return df.groupBy(*_by(groups), column).agg(F.count("*").alias("n"))


def abundance(residues: DataFrame, group: str, read: str = "readname") -> DataFrame:
    """Residue rows by how many residues their read has: single, two, more."""
    n = residues.groupBy(group, read).agg(F.count("*").alias("k"))
    kind = F.when(F.col("k") == 1, "single").when(F.col("k") == 2, "two").otherwise("more")
    return n.groupBy(group, kind.alias("instances")).agg(F.sum("k").alias("count"))


def spread(residues: DataFrame, ids: Sequence[str], kind: str, position: str, values: Sequence[str]) -> DataFrame:
    """One row per read: prediction_<value> counts and the residues as value and position joined by colons."""
    counts = [F.sum(F.when(F.col(kind) == v, 1).otherwise(0)).alias(f"prediction_{v}") for v in values]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(kind).alias("k")))), lambda x: F.concat(x["k"], x["p"].cast("string"))), ":")
    return residues.groupBy(*ids).agg(*counts, text.alias("nonA_residues"))


def natural_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on all common columns, null equal to null."""
    common = [c for c in left.columns if c in right.columns]
    r = right.select(*(F.col(c).alias(f"_r_{c}") for c in right.columns))
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_r_{c}"]) for c in common])
    keys = [F.coalesce(left[c], r[f"_r_{c}"]).alias(c) for c in common]
    rest = [F.col(f"_r_{c}").alias(c) for c in right.columns if c not in common]
    return left.join(r, on, how).select(*keys, *(left[c] for c in left.columns if c not in common), *rest)


def passed(df: DataFrame, qc: str = "qc_tag", pass_only: bool = True) -> DataFrame:
    kind = df.schema[qc].dataType.simpleString()
    if kind == "string":
        return df.where(F.col(qc).isin(["PASS"] if pass_only else ["PASS", "SUFFCLIP"]))
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return df.where(F.col(qc) > 0)
    raise ValueError("qc_tag must be text or a number")


def summarize(merged: DataFrame, by: Sequence[str], length: str, values: Sequence[str]) -> DataFrame:
    counts = {v: F.col(f"prediction_{v}") for v in values}
    total = reduce(lambda a, b: a + b, counts.values())
    cols: list[Column] = [F.median(length).alias("polya_median"), F.avg(length).alias("polya_mean"), F.count("*").alias("counts_total"), F.count_if(total == 0).alias("counts_blank")]
    for name, c in {"nonA": total, **counts}.items():
        cols += [F.count_if(c != 0).alias(f"counts_{name}"), F.sum(c).alias(f"hits_{name}")]
    return merged.groupBy(*by).agg(*cols)


def shares(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows per value and their share of the group's."""
    n = df.groupBy(group, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def length_stats(df: DataFrame, group: str, length: str) -> DataFrame:
    sd = F.stddev_samp(length)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(length), 2).alias("mean"), F.round(F.median(length), 2).alias("median"), F.round(sd, 2).alias("sd"), F.round(sd / F.sqrt(F.count("*").cast("double")), 2).alias("sem"))


def at_least(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group and value, how many rows have that value or more: a histogram summed from the top, not a self-join."""
    w = Window.partitionBy(group).orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, 0)
    return df.groupBy(group, column).agg(F.count("*").alias("n")).withColumn("n_at_least", F.sum("n").over(w))


def only_value(df: DataFrame, read: str, kind: str, value: str) -> DataFrame:
    """Reads all of whose rows have one value."""
    return df.groupBy(read).agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where((F.col("lo") == value) & (F.col("hi") == value)).select(read)


def union_samples(samples: Sequence[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Samples under one another, each with its metadata as columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumns({k: F.lit(v) for k, v in meta.items()}) for df, meta in samples])


def tailfindr(df: DataFrame) -> DataFrame:
    require(df, ["read_id", "tail_start", "tail_end", "samples_per_nt", "tail_length"])
    return df.select(F.col("read_id").alias("readname"), F.lit("tailfindr_out").alias("contig"), F.col("tail_start").alias("polya_start"), "tail_end", (F.col("tail_end") + 1).alias("transcript_start"), F.col("tail_length").alias("polya_length"), F.when(F.col("tail_length") >= 10, "PASS").otherwise("NOREGION").alias("qc_tag"))


def dorado_passed(summary: DataFrame) -> DataFrame:
    return summary.where("alignment_direction <> '*' and alignment_mapq <> 0 and poly_tail_start <> 0 and poly_tail_length >= 10")


def annotated(df: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """Left join to a user's annotation table; Spark broadcasts that side only where its size allows."""
    return df.join(annotation.dropDuplicates([key]), key, "left")


def per_group(df: DataFrame, groups: str | Sequence[str], f, schema: str) -> DataFrame:
    """A user's function from a pandas table to one, for each group of the table that fits a task; groups of any size are for ``scale`` and the aggregates here."""
    return df.groupBy(*_by(groups)).applyInPandas(f, schema)
