"""Post-processing of the read table and the residue table: merging, correction, tests and the tables behind the plots.

A group (sample, condition) is a column whose name is an argument.  Nulls match nulls in all joins here.  Every result is lazy but
for ``spread_residues`` without given values, which reads the distinct residues (a handful of letters) first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import integer_mode, position_bin
from .density import modes
from .scale import HOT_PARTS, free_names, placed
from .stats import adjusted, fisher
from .tables import _by, natural_join, passed, require, two_levels, validated

# Codes of a test's outcome and their texts.
OUTCOMES = {"OK": "OK", "G_LC": "LOW COUNT FOR ONE GROUP", "B_LC": "LOW COUNTS FOR BOTH GROUPS", "G_NA": "DATA FOR ONE GROUP NOT AVAILABLE", "B_NA": "DATA FOR BOTH GROUPS NOT AVAILABLE", "ERR": "OTHER ERROR"}
# Species with a whitelist of transcripts.
SPECIES = ("mmusculus", "hsapiens", "scerevisiae", "celegans", "athaliana", "tbrucei")
_HELPERS = ("mode_pos", "pos_err_quart", "count_nonA", "seg_err_quart", "mode_len", "count", "qc_pos")


def classified(classes: DataFrame) -> DataFrame:
    return classes.where("class <> 'unclassified'")


def keep(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that there are."""
    return df.select(*(n for n in names if n in df.columns))


def plain_number(c: Column) -> Column:
    """A number as text, whole ones without decimals."""
    whole = c.cast("long")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def spread_residues(residues: DataFrame, group: str = "group", read: str = "readname", kind: str = "prediction", position: str = "est_nonA_pos", values: Sequence[str] | None = None) -> DataFrame:
    """One row per read: prediction_<value> counts and all its residues as text by position.  The list is gathered over a read's rows before
    they are counted, so both steps share one shuffle."""
    require(residues, [read, group, kind, position])
    if values is None:
        values = sorted(r[0] for r in residues.select(kind).distinct().collect())
    ids = [c for c in residues.columns if c not in (kind, position)]
    own = Window.partitionBy(group, read)
    listed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(kind).alias("k"))).over(own))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["k"], plain_number(x["p"]))), ":")
    counts = [F.count_if(F.col(kind) == v).alias(f"prediction_{v}") for v in values]
    # the text, one for each read, is a key: as a value it would have the rows sorted twice more
    found = residues.withColumn("nonA_residues", text).groupBy(*ids, "nonA_residues").agg(*counts)
    return found.select(*ids, *(f"prediction_{v}" for v in values), "nonA_residues")


def merge_tables(classes: DataFrame, residues: DataFrame, pass_only: bool = True, group: str = "group", values: Sequence[str] | None = None) -> DataFrame:
    """Classified reads of accepted quality with their residues; every number that is absent becomes 0."""
    joined = natural_join(passed(classified(classes), "qc_tag", pass_only), spread_residues(residues, group, values=values), "full")
    numbers = [f.name for f in joined.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    return joined.na.fill(0, numbers)


def whitelist(spark_table: DataFrame | None, species_or_list: str | Sequence[str]) -> DataFrame | list[str]:
    """The transcripts of a species as a table, from one of (species, transcript), or the list itself."""
    if isinstance(species_or_list, str):
        if species_or_list not in SPECIES or spark_table is None:
            raise ValueError(f"a whitelist is a list or one of {', '.join(SPECIES)} with a table")
        return spark_table.where(F.col("species") == species_or_list).select("transcript").distinct()
    return list(species_or_list)


def position_rule(position: Column, length: Column, listed: Column) -> Column:
    """Y unless a residue's position looks like an artefact of its transcript."""
    n, reads = F.col("count_nonA"), F.col("count")
    mode, quart, seg = F.col("mode_pos"), F.col("pos_err_quart"), F.col("seg_err_quart")
    many, few = n > 10, n < 10
    beyond = many & (position > mode)
    yes = [
        listed, beyond & (mode < quart), beyond & (mode > quart) & (position - quart > 4), many & (mode > seg), many & (position > quart) & (position > seg), few & (position > seg),
        many & (length < 50) & (F.try_divide(position, length) * 100 < F.col("mode_len")) & (position > quart) & (quart > 10), (reads < 10) & few, few,
    ]
    return F.when(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in yes]), "Y").otherwise("N")


def corrected_residues(classes: DataFrame, residues: DataFrame, transcript: str, length: str = "polya_length", position: str = "est_nonA_pos", kind: str = "prediction", groups: str | Sequence[str] | None = None, listed: Sequence | DataFrame = ()) -> DataFrame:
    """Distinct residues with the statistics of their (group and) transcript and qc_pos."""
    keys = [*_by(groups), transcript]
    classes, residues = classes.distinct(), residues.distinct()
    reads = classes.groupBy(*keys).agg(F.percentile(length, F.lit(0.05)).alias("seg_err_quart"), integer_mode(F.col(length)).alias("mode_len"), F.count("*").alias("count"))
    found = residues.groupBy(*keys, kind).agg(integer_mode(F.col(position)).alias("mode_pos"), F.percentile(position, F.lit(0.05)).alias("pos_err_quart"), F.count("*").alias("count_nonA"))
    edited = natural_join(natural_join(residues, found, "inner"), natural_join(classes, reads, "inner"), "left")
    if isinstance(listed, DataFrame):  # a table stays one: its size decides how Spark joins it
        known = listed.select(F.col(listed.columns[0]).alias(transcript)).where(F.col(transcript).isNotNull()).distinct().withColumn("_listed", F.lit(True))
        edited = edited.join(known, transcript, "left").select(*edited.columns, F.coalesce("_listed", F.lit(False)).alias("_listed"))
    else:
        edited = edited.withColumn("_listed", F.coalesce(F.col(transcript).isin(list(listed)), F.lit(False)) if listed else F.lit(False))
    return edited.withColumn("qc_pos", position_rule(F.col(position), F.col(length), F.col("_listed"))).drop("_listed")


def corrected_classes(classes: DataFrame, edited: DataFrame, read: str = "readname") -> DataFrame:
    """Reads with corr_class and corr_comments: blank where all residues of a read were doubtful, decorated where only some were."""
    n = edited.groupBy(read).agg(F.count("*").alias("n_resid"), F.count_if(F.col("qc_pos") == "N").alias("no_qc_pos_N"))
    d = classes.join(n, read, "left")
    new = F.when(F.col("n_resid") == F.col("no_qc_pos_N"), "blank").when(F.col("n_resid") > F.col("no_qc_pos_N"), "decorated").otherwise(F.col("class"))
    d = d.withColumn("corr_class", new)
    return d.withColumn("corr_comments", F.when(F.col("class") == F.col("corr_class"), F.col("comments")).otherwise("MPU"))


def reclassified(classes: DataFrame, residues: DataFrame, transcript: str, groups: str | Sequence[str] | None = None, listed: Sequence | DataFrame = ()) -> tuple[DataFrame, DataFrame]:
    """The read table with corrected classes, and the residues that aren't doubtful."""
    edited = corrected_residues(classes, residues, transcript, groups=groups, listed=listed)
    reads = corrected_classes(classes.distinct(), edited)
    columns = [F.col({"class": "corr_class", "comments": "corr_comments"}.get(c, c)).alias(c) for c in classes.columns]
    return reads.select(*columns), edited.where("qc_pos = 'Y'").drop(*_HELPERS)


def residue_tests(merged: DataFrame, transcript: str, group: str, levels: tuple[str, str] | None = None, base: str = "C", min_reads: int = 0, min_nonA_reads: int = 0, alpha: float = 0.05) -> DataFrame:
    """Per transcript Fisher's test of blank reads against reads with a base (``all``: any) in two groups, adjusted over transcripts.
    One aggregate gives all counts of a transcript, so no group of reads is gathered.  Without given levels the column must have two."""
    validated(merged, numbers=[c for c in merged.columns if c.startswith("prediction_")])
    require(merged, [transcript, group])
    levels = two_levels(merged, group) if levels is None else levels
    if len(set(levels)) != 2:
        raise ValueError("two different levels are compared")
    shown = [c for c in merged.columns if c.startswith("prediction_")]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in shown])
    if base != "all" and f"prediction_{base}" not in shown:
        raise ValueError(f"no residues {base}")
    hit = total != 0 if base == "all" else F.col(f"prediction_{base}") != 0
    each = [F.col(group) == level for level in levels]
    counts = [a for i, g in enumerate(each) for a in (F.count_if(g).alias(f"n{i}"), F.count_if(g & (total == 0)).alias(f"blank{i}"), F.count_if(g & hit).alias(f"base{i}"), F.count_if(g & (total != 0)).alias(f"any{i}"))]
    per = merged.where(F.col(group).isin(*levels)).groupBy(transcript).agg(*counts).where(F.greatest("any0", "any1") >= min_nonA_reads)
    low = [F.col(f"n{i}") < min_reads for i in (0, 1)]
    code = F.when((F.col("n0") == 0) & (F.col("n1") == 0), "B_NA").when((F.col("n0") == 0) | (F.col("n1") == 0), "G_NA").when(low[0] & low[1], "B_LC").when(low[0] | low[1], "G_LC").otherwise("OK")
    p = fisher(F.col("blank0"), F.col("base0"), F.col("blank1"), F.col("base1"))
    tested = adjusted(per.withColumn("stats_code", code).withColumn("p_value", F.when(F.col("stats_code") == "OK", p)), "p_value")
    texts = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))
    return tested.select(transcript, "p_value", texts[F.col("stats_code")].alias("stats_code"), "padj", F.when(F.col("padj") < alpha, f"FDR<{alpha}").otherwise("NotSig").alias("significance"))


def ordered_tests(tests: DataFrame) -> DataFrame:
    return tests.orderBy(F.asc_nulls_last("padj"))


def summarized(merged: DataFrame, factors: Sequence[str], transcript: str | None = None, length: str = "polya_length") -> DataFrame:
    """Medians, means, reads with residues and residues by transcript and factors, for whatever residues the table has."""
    shown = sorted(c for c in merged.columns if c.startswith("prediction_"))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in shown])
    cols = [F.median(length).alias("polya_median"), F.avg(length).alias("polya_mean"), F.count("*").alias("counts_total"), F.count_if(total == 0).alias("counts_blank")]
    for name, c in {"nonA": total, **{s.removeprefix("prediction_"): F.col(s) for s in shown}}.items():
        cols += [F.count_if(c != 0).alias(f"counts_{name}"), F.sum(c).alias(f"hits_{name}")]
    return merged.groupBy(*([transcript] if transcript else []), *factors).agg(*cols)


# tables behind the plots


def instance_shares(abundance: DataFrame, group: str) -> DataFrame:
    """Per group the shares of residue rows on reads with one, two and more residues; absent ones are 0."""
    kinds = ["single", "two", "more"]
    wide = abundance.groupBy(group).agg(*(F.coalesce(F.sum(F.when(F.col("instances") == k, F.col("count"))), F.lit(0)).alias(k) for k in kinds))
    total = F.col("single") + F.col("two") + F.col("more")
    shares = wide.select(group, *(F.try_divide(F.col(k), total).alias(k) for k in kinds))
    return shares.unpivot(group, kinds, "instances", "share")


def residue_shares(residues: DataFrame, group: str, kind: str, values: Sequence[str]) -> DataFrame:
    """Per group the share of each residue, in long form; absent ones are 0."""
    wide = residues.groupBy(group).agg(*(F.count_if(F.col(kind) == v).alias(v) for v in values))
    total = reduce(lambda a, b: a + b, [F.col(v) for v in values])
    return wide.select(group, *(F.try_divide(F.col(v), total).alias(v) for v in values)).unpivot(group, list(values), kind, "share")


def decorated_share(classes: DataFrame, group: str, value: str = "decorated", column: str = "class") -> DataFrame:
    return classes.groupBy(group).agg(F.count_if(F.col(column) == value).alias("n"), F.count("*").alias("total")).withColumn("share", F.try_divide("n", "total"))


def _pooled(residues: DataFrame, kind: str, position: str, length: str, width: int, from_5_prime: bool) -> tuple[DataFrame, DataFrame]:
    """(residues with their bins, per position bin the pooled counts of all residues)."""
    place = F.col(position) if from_5_prime else F.col(length) - F.col(position)
    rounded = lambda c: position_bin(F.bround(c.cast("double"), 0), width).cast("long")
    d = residues.select(F.col(kind).alias("_kind"), rounded(place).alias("bin"), rounded(F.col(length)).alias("length_bin"))
    both = d.select(F.col("bin").alias("b"), F.lit(1).alias("at"), F.lit(0).alias("of")).unionByName(d.select(F.col("length_bin").alias("b"), F.lit(0).alias("at"), F.lit(1).alias("of")))
    hist = both.where("b is not null").groupBy("b").agg(F.sum("at").alias("n_bin"), F.sum("of").alias("n_len"))
    from_top = Window.partitionBy(F.lit(1)).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin of a tail's length, some hundred
    lengths = F.count_if(F.col("n_len") > 0).over(Window.partitionBy(F.lit(1)))
    pooled = hist.select(F.col("b").alias("bin"), "n_bin", F.sum("n_len").over(from_top).alias("n_at_least"), lengths.alias("length_bins")).where("n_bin > 0")
    return d, pooled.withColumn("ratio", F.try_divide("n_bin", "n_at_least"))


def panel(residues: DataFrame, kind: str, position: str, length: str, width: int = 5, from_5_prime: bool = True) -> DataFrame:
    """Per residue and bin of positions: its residues there (n); and of all residues pooled how many there are (n_bin), how many have a tail at least as long as the bin
    (n_at_least), their ratio, and that over the number of bins that lengths fall into.  Positions count from the 5' end or from the 3' end."""
    d, pooled = _pooled(residues, kind, position, length, width, from_5_prime)
    own = d.where("bin is not null").groupBy("_kind", "bin").agg(F.count("*").alias("n"))
    return own.join(pooled, "bin").select(F.col("_kind").alias(kind), "bin", "n", "n_bin", "n_at_least", "ratio", F.try_divide("ratio", "length_bins").alias("normalised"))


def panel_columns(residues: DataFrame, kind: str, position: str, length: str, width: int = 5, from_5_prime: bool = True) -> DataFrame:
    """The panel's columns: per residue and bin of tail lengths the sum of its residues' normalised ratios, with the label ``(n=..)`` of the residue."""
    d, pooled = _pooled(residues, kind, position, length, width, from_5_prime)
    share = pooled.select("bin", F.try_divide("ratio", "length_bins").alias("_share"))
    heights = d.where("bin is not null and length_bin is not null").groupBy("_kind", "bin", "length_bin").agg(F.count("*").alias("_m")).join(share, "bin").groupBy("_kind", "length_bin").agg(F.sum(F.col("_m") * F.col("_share")).alias("height"))
    labels = d.groupBy("_kind").agg(F.concat(F.lit("(n="), F.count("*").cast("string"), F.lit(")")).alias("label"))
    return heights.join(labels, heights["_kind"].eqNullSafe(labels["_kind"])).select(heights["_kind"].alias(kind), "length_bin", "height", "label")


def tail_types(merged: DataFrame, keep_columns: Sequence[str] = ("sample", "group", "readname", "prediction", "est_nonA_pos", "polya_length", "class", "comments", "transcript", "ensembl_transcript_id_full", "ensembl_transcript_id_short", "prediction_C", "prediction_G", "prediction_U", "nonA_residues")) -> DataFrame:
    """Every read twice: as blank or nonA, by whether it has residues, and as total; for the distributions of lengths."""
    own = F.when(F.col("nonA_residues").isNull(), "blank").otherwise("nonA")
    return keep(merged, keep_columns).withColumn("type", F.explode(F.array(own, F.lit("total"))))


def metrics(summary: DataFrame, factors: Sequence[str]) -> DataFrame:
    """The counts of a summary in long form, with their category."""
    sources = [c for c in summary.columns if c.startswith("counts_")]
    long = summary.select(*factors, *(F.round(F.col(c).cast("double"), 3).alias(c) for c in sources)).unpivot(list(factors), sources, "source", "counts")
    return long.withColumn("cat", F.when(F.col("source").isin("counts_total", "counts_blank", "counts_nonA"), "main").otherwise("mods"))


def value_boxes(classes: DataFrame, sample: str, transcript: str) -> DataFrame:
    return classes.agg(F.countDistinct(sample).alias("samples"), F.countDistinct(transcript).alias("transcripts"), F.count("*").alias("reads"), F.count_if(F.col("class") == "blank").alias("blank"), F.count_if(F.col("class") == "decorated").alias("decorated"))


def with_count(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """The rows with how many of them have the same value; nulls are alike.  The most frequent values' counts are broadcast, so that no value's rows meet in
    one task; any other value has less than that share of all rows.  df is read three times, so store it where it is dear."""
    _value, _rows = free_names([*df.columns, out], "_value", "_rows")
    counts = df.groupBy(F.col(column).alias(_value)).agg(F.count("*").alias(_rows))
    often = counts.orderBy(F.desc(_rows), _value).limit(HOT_PARTS)
    same, columns = F.col(column).eqNullSafe(F.col(_value)), [c for c in df.columns if c != out]
    found = df.join(F.broadcast(often), same, "left")
    rare = found.where(F.col(_rows).isNull()).drop(_value, _rows).join(counts, same)
    both = found.where(F.col(_rows).isNotNull()).unionByName(rare)
    return both.select(*columns, F.col(_rows).alias(out))


def central_tendency(df: DataFrame, group: str, length: str = "polya_length") -> DataFrame:
    """Median, mean and mode of lengths by group; the mode is where the density of the group's lengths is highest."""
    rest = df.groupBy(group).agg(F.median(length).alias("median"), F.avg(length).alias("mean"))
    top = modes(df, group, length)
    return rest.join(top, rest[group].eqNullSafe(top[group]), "left").select(rest[group], "median", "mean", "mode")


def type_shares(df: DataFrame, column: str = "tail_type") -> DataFrame:
    """Rows and percentages of each type; the total is a sum over the few types."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def level_order(df: DataFrame, column: str, last: Sequence[str]) -> DataFrame:
    """Rows by a class's display order: the last ones last, as listed."""
    place = reduce(lambda w, iv: w.when(F.col(column) == iv[1], iv[0] + 1), enumerate(last), F.when(F.lit(False), 0)).otherwise(0)
    return df.orderBy(place, column)


def pick_list(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def seeded_sample(df: DataFrame, groups: str | Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, the same at each run and in any system with MD5: those whose digest of key, colon and seed is least.

    Each task first keeps its own n rows of a group, so no more than those are shuffled; Spark does that up to a limit, which is raised where n is over it."""
    spark, limit = df.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(limit, "1000")) < n:
        spark.conf.set(limit, str(n))
    w = Window.partitionBy(*_by(groups)).orderBy(F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary")), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def first_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """Each read's previous and next one in the order of the key over the whole table: places come from range partitions, and neighbours are joined by place."""
    d = placed(df, key, place="_place", part="_part").drop("_part")
    other = lambda step, name: d.select((F.col("_place") + step).alias("_place"), F.col(key).alias(name))
    return d.join(other(1, "previous"), "_place", "left").join(other(-1, "next"), "_place", "left").drop("_place")


def chosen(df: DataFrame, equal: Mapping[str, object] | None = None, among: Mapping[str, Sequence] | None = None, between: Mapping[str, tuple] | None = None, residues: DataFrame | None = None, residue: str | None = None, read: str = "readname") -> DataFrame:
    """A dashboard's filters, each optional, all of which must hold; with a residue, reads that have it."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    for c, vs in (among or {}).items():
        df = df.where(F.col(c).isin(*vs))
    for c, (lo, hi) in (between or {}).items():
        df = df.where(F.col(c).between(lo, hi))
    if residue is not None and residues is not None:
        df = df.join(residues.where(F.col("prediction") == residue).select(read).distinct(), read, "left_semi")
    return df


def one_read(residues: DataFrame, read_id: str) -> DataFrame:
    named = residues.withColumnRenamed("readname", "read_id") if "read_id" not in residues.columns else residues
    require(named, ["read_id", "prediction", "est_nonA_pos", "polya_length"])
    return named.where(F.col("read_id") == read_id)


def with_orientation(summary: DataFrame, calls: DataFrame) -> DataFrame:
    """Reads with their tail_type; unidentified where there is no call."""
    return summary.join(calls.select("read_id", "tail_type"), "read_id", "left").withColumn("tail_type", F.coalesce("tail_type", F.lit("unidentified")))


def with_class(signals: DataFrame, classes: DataFrame) -> DataFrame:
    """Signals with the class and comments of their read, one row of the read table each."""
    one = classes.groupBy(F.col("readname").alias("read_id")).agg(F.min(F.struct("class", "comments")).alias("c")).select("read_id", "c.class", "c.comments")
    return signals.join(one, "read_id", "left")
