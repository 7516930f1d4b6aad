"""Delimited tables, SAM text and Parquet intermediates in; delimited tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import corrected_label
from ..operators.tables import require, tailfindr, union_samples
from .stages import publish


# Types of the columns that the callers' and this library's tables have; any other column is text.
TYPES = {
    **dict.fromkeys(["channel", "mux", "batch_id", "num_events", "num_events_template", "sequence_length_template", "flag", "position", "alignment_genome_start", "alignment_genome_end", "alignment_strand_start", "alignment_strand_end", "alignment_length", "alignment_num_aligned", "alignment_num_correct", "alignment_num_insertions", "alignment_num_deletions", "alignment_num_substitutions", "alignment_mapq", "alignment_bed_hits", "poly_tail_length", "poly_tail_start", "poly_tail_end", "poly_tail2_start", "poly_tail2_end", "tail_start", "tail_end", "prediction_C", "prediction_G", "prediction_U"], "int"),
    **dict.fromkeys(["start_time", "duration", "template_start", "template_duration", "mean_qscore_template", "strand_score_template", "median_template", "mad_template", "scaling_median_template", "scaling_mad_template", "alignment_strand_coverage", "alignment_identity", "alignment_accuracy", "leader_start", "adapter_start", "polya_start", "transcript_start", "read_rate", "polya_length", "est_nonA_pos", "samples_per_nt", "tail_length"], "double"),
    **dict.fromkeys(["passes_filtering", "tail_is_valid"], "boolean"),
}


def table(spark: SparkSession, source: str | DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """A path (.csv: commas, otherwise tabs; Parquet by suffix) or a DataFrame.

    A delimited table's columns get their types by name (``TYPES``, and what ``types`` adds), so only its first two lines are read before the scan that is asked for: the names, and whether qc_tag is a number
    (a mapping quality) or a text.  NA is null; a value that isn't of its column's type raises."""
    if isinstance(source, DataFrame):
        return source
    if source.endswith(".parquet"):
        return spark.read.parquet(source)
    sep = "," if source.endswith(".csv") else "\t"
    reader = spark.read.option("sep", sep).option("nullValue", "NA")
    probe = reader.option("header", True).csv(source)
    known = {**TYPES, **(types or {})}
    if "qc_tag" in probe.columns and "qc_tag" not in known:
        first = probe.select("qc_tag").where("qc_tag is not null").first()
        known["qc_tag"] = "int" if first is not None and first[0].lstrip("-").isdigit() else "string"
    schema = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in probe.columns)
    return spark.read.option("sep", sep).option("nullValue", "NA").option("header", True).option("mode", "FAILFAST").schema(schema).csv(source)


def _with_transcript(df: DataFrame, sample: str | None) -> DataFrame:
    df = df.withColumns({
        "transcript": F.regexp_replace("contig", r"^(?:[^|]*\|){5}([^|]*)\|.*$", "$1"), "ensembl_transcript_id_full": F.regexp_replace("contig", r"^([^|]*)\|.*$", "$1"),
    })
    df = df.withColumn("ensembl_transcript_id_short", F.regexp_replace("ensembl_transcript_id_full", r"\.[0-9]*$", ""))
    return df if sample is None else df.withColumn("sample_name", F.lit(sample))


def read_classes(spark: SparkSession, source: str | DataFrame, sample: str | None = None) -> DataFrame:
    df = table(spark, source)
    require(df, ["readname", "contig", "class", "comments"])
    return _with_transcript(df.withColumn("class", corrected_label(F.col("class"))), sample)


def read_residues(spark: SparkSession, source: str | DataFrame, sample: str | None = None) -> DataFrame:
    df = table(spark, source)
    require(df, ["readname", "contig", "prediction"])
    return _with_transcript(df, sample)


def read_samples(spark: SparkSession, samples: list[dict], reader=read_classes, path: str = "class_path") -> DataFrame:
    return union_samples([(reader(spark, s[path]), {k: v for k, v in s.items() if not k.endswith("_path")}) for s in samples])


def polya(nanopolish: DataFrame, summary: DataFrame, pass_only: bool = True) -> DataFrame:
    """Passed reads of at least 10 nucleotides with their files."""
    tags = ["PASS"] if pass_only else ["PASS", "SUFFCLIP"]
    reads = nanopolish.select("readname", "polya_start", "transcript_start", "polya_length", "qc_tag").where(F.col("qc_tag").isin(tags) & (F.col("polya_length") >= 10))
    files = summary.select(F.col("read_id").alias("readname"), "filename")
    return reads.join(files, "readname", "left").distinct()


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped primary records of SAM text with the tags pt and pa; the first of each read."""
    f = F.split("value", "\t")
    tag = lambda name: F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]*)", 1)
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(
        f[0].alias("read_id"), f[1].cast("int").alias("flag"), f[2].alias("reference"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("sequence"),
        F.nullif(tag("pt"), F.lit("")).try_cast("int").alias("pt"), F.nullif(tag("pa"), F.lit("")).alias("pa"),
    )
    good = rows.where("pt is not null and (flag & 4) = 0 and (flag & 2304) = 0 and reference <> '*'")
    return good.groupBy("read_id").agg(F.min_by(F.struct(*[c for c in good.columns if c != "read_id"]), F.struct("pos", "flag")).alias("r")).select("read_id", "r.*")


def tail_lengths(spark: SparkSession, source: str | DataFrame) -> tuple[DataFrame, str]:
    """The table and its kind by its columns: nanopolish, or tailfindr's direct-RNA output, which is converted."""
    df = table(spark, source)
    names = set(df.columns)
    if "qc_tag" in names:
        return df, "nanopolish"
    if {"read_id", "tail_start", "tail_end", "samples_per_nt", "tail_length"} <= names:
        return tailfindr(df), "tailfindr_drs"
    if "tail_is_valid" in names:
        raise ValueError("cDNA output of tailfindr doesn't fit; direct-RNA output is needed")
    raise ValueError("the table is neither nanopolish nor direct-RNA tailfindr output")


def read_config(text: str) -> list[dict]:
    """Samples of a YAML or JSON configuration, each with a group (ungrouped by default)."""
    import json

    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    return [{"group": "ungrouped", "sample_name": name, **(given or {})} for name, given in (found or {}).get("samples", {}).items()]


def read_configured(spark: SparkSession, samples: list[dict], reader=read_classes, path: str = "class_path") -> tuple[DataFrame | None, list[str]]:
    """The union of the samples that can be read, and messages for the others."""
    good, problems = [], []
    for s in samples:
        try:
            good.append((reader(spark, s[path]), {k: s[k] for k in ("sample_name", "group") if k in s}))
        except Exception as e:  # one bad sample doesn't end the others
            problems.append(f"{s.get('sample_name')}: {str(e).splitlines()[0][:200]}")
    return (union_samples(good) if good else None), problems


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def save_outputs(outputs: dict[str, DataFrame], folder: str, prefix: str = "", now: str | None = None) -> dict[str, str]:
    """Each table under its name in a folder with time and prefix, all of them or none (``stages.publish``); nothing there is overwritten.  Returns the paths."""
    from datetime import datetime

    now = now or datetime.now().strftime("%Y-%m-%d_%H-%M-%S")
    return publish(next(iter(outputs.values())).sparkSession, outputs, folder, f"{now}{'_' + prefix if prefix else ''}")


def save_cdna(outputs: dict[str, DataFrame | None], empty: DataFrame) -> dict[str, DataFrame]:
    """The tables, empty ones for those that are missing."""
    return {name: empty.limit(0) if df is None else df for name, df in outputs.items()}


def write_parts(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Files of at most so many rows, written where the rows are."""
    df.write.option("maxRecordsPerFile", rows).option("sep", "\t").option("header", True).csv(path)


def classified_path(path: str) -> str:
    """Where the orientation results of a table go: beside it."""
    return f"{path.rsplit('.', 1)[0]}_classified.tsv"


def ready_folder(spark: SparkSession, path: str) -> None:
    """Raises if a folder has anything in it; makes it where it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) and len(system.listStatus(target)):
        raise ValueError(f"{path} isn't empty")
    system.mkdirs(target)
