"""From signals to the two output tables: chunks are classified by the user's model and joined back to their reads.

A run is one lazy plan: kernels in Arrow batches, chunks as rows, then joins by read.  ``classify`` maps stacked angular fields (n, 100, 100, 2)
to class numbers 0 to 3; it is loaded where it runs.  The fields never leave the batch that makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as K
from ..functions.matching import type_statistics, with_tail_type
from ..functions.scalar import at_end, cdna_code, class_of, comment_code, guppy_code
from ..sources.bam import tailed_reads
from ..sources.readers import polya
from ..sources.stages import Run, made_of
from .post import first_of_each
from .scale import stored
from .tables import dorado_passed, require

# The classifier's numbers and their residues.
BASES = {0: "A", 1: "C", 2: "G", 3: "U"}
SUMMARY = ["filename", "read_id", "poly_tail_length", "poly_tail_start", "poly_tail_end", "alignment_genome", "alignment_direction", "alignment_mapq"]


def read_of(chunkname: Column) -> Column:
    return F.regexp_replace(chunkname, "_[0-9]+$", "")


def base_of(prediction: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in BASES.items() for x in pair))[prediction.cast("int")]


def dorado_summary(summary: DataFrame, qc: bool = True) -> DataFrame:
    """The summary with its file column's name set right, all needed columns checked, and only usable reads if qc."""
    if "filename" not in summary.columns and "input_filename" in summary.columns:
        summary = summary.withColumnRenamed("input_filename", "filename")
    require(summary, SUMMARY)
    return dorado_passed(summary) if qc else summary


def tail_signals(summary: DataFrame, signals: DataFrame) -> DataFrame:
    """read_id and tail_signal: the tail cut from each raw signal, winsorised and resampled to a fifth; empty where the bounds don't fit."""
    # the summary's side is made the table in memory: signals from a store then stay in their buckets, unsorted and unmoved
    wanted = summary.where(_TAILED).select("read_id", "poly_tail_start", "poly_tail_end").hint("shuffle_hash")
    d = signals.select("read_id", "signal").join(wanted, "read_id")
    a, b = F.col("poly_tail_start"), F.col("poly_tail_end")
    fits = (a > 0) & (a < b) & (b <= F.size("signal"))
    cut = F.when(fits, F.slice("signal", a + 1, F.when(fits, b - a).otherwise(0))).otherwise(F.array().cast(d.schema["signal"].dataType))
    return d.select("read_id", K.resampled(K.winsorized(cut)).alias("tail_signal"))


def chunk_rows(tails: DataFrame, moves: Callable = K.pseudomoves, chunks: Callable = K.chunks, read: str = "read_id", signal: str = "tail_signal") -> DataFrame:
    """read, chunk_idx, chunkname, chunk_sequence, chunk_start_pos, chunk_end_pos of every chunk of every tail; empty and null tails have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, x in zip(b[read], b[signal]):
                if x is None or not len(x):
                    continue
                for i, (start, values) in enumerate(chunks(np.asarray(x), moves(np.asarray(x))), 1):
                    rows.append((name, i, f"{name}_{i}", values, start, start + len(values) - 1))
            yield pd.DataFrame(rows, columns=[read, "chunk_idx", "chunkname", "chunk_sequence", "chunk_start_pos", "chunk_end_pos"])

    return tails.select(read, signal).mapInPandas(run, f"{read} string, chunk_idx int, chunkname string, chunk_sequence array<double>, chunk_start_pos int, chunk_end_pos int")


#: What becomes of a tail: chunks, none as no move stands out, none as moves don't last, or an error.
STATES = ("chunked", "zeromoved", "nonpseudomoved", "failed")
CLASSIFIED = "chunk_idx int, chunkname string, chunk_start_pos int, chunk_end_pos int, prediction int, state string, problem string"


def classified_chunks(tails: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], chunks: Callable = K.chunks, read: str = "read_id", signal: str = "tail_signal", most: int = 256) -> DataFrame:
    """Everything that is computed from tails, in one pass: a row per chunk with its class, and for a read without chunks one row that says why.

    A batch's moves are found together and its chunks are classified together, at most so many at once.  If a batch fails its reads are tried one by one, so that a bad signal, or
    one that the model can't take, costs its own read only: state ``failed``, and the error as ``problem``.  An error of loading the model ends the job."""
    columns = [read, *(c.split()[0] for c in CLASSIFIED.split(", "))]
    moves_of, fields_of, longest = K.pseudomoves_of, K.gaf_of, K.longest_run

    def cut(names: list, signals: list) -> list[tuple]:
        out = []
        for name, x, moves in zip(names, signals, moves_of(signals)):
            found = chunks(x, moves) if len(x) else []
            if not found:
                state = "zeromoved" if not np.any(moves) else "nonpseudomoved" if longest(moves) < 5 else "chunked"
                out.append((name, 0, None, None, None, None, state, None))
            out += [(name, i, f"{name}_{i}", start, start + len(v) - 1, v, "chunked", None) for i, (start, v) in enumerate(found, 1)]
        return out

    def classed(rows: list[tuple], classify: Callable) -> list[tuple]:
        held, called = [i for i, r in enumerate(rows) if r[5] is not None], {}
        for at in range(0, len(held), most):
            part = held[at : at + most]
            found = np.asarray(classify(fields_of(np.stack([rows[i][5] for i in part])))).astype(int)
            if len(found) != len(part):
                raise ValueError("the model gave another number of classes than it got chunks")
            called.update(zip(part, found.tolist()))
        return [(*r[:5], called.get(i), *r[6:]) for i, r in enumerate(rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = load()
        for b in batches:
            names = b[read].tolist()
            try:
                rows = classed(cut(names, [np.zeros(0) if v is None else np.asarray(v, float) for v in b[signal]]), classify)
            except Exception:
                rows = []
                for name, v in zip(names, b[signal]):
                    try:
                        rows += classed(cut([name], [np.zeros(0) if v is None else np.asarray(v, float)]), classify)
                    except Exception as e:
                        rows.append((name, 0, None, None, None, None, "failed", f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=columns).astype({"chunk_start_pos": "Int32", "chunk_end_pos": "Int32", "prediction": "Int32"})

    return tails.select(read, signal).mapInPandas(run, f"{read} string, {CLASSIFIED}")


def _good(classified: DataFrame) -> DataFrame:
    return classified.where("chunkname is not null")


def predictions(chunks: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], most: int = 256) -> DataFrame:
    """chunkname and prediction: angular fields of at most so many chunks at once go through the loaded model."""
    field = K.stacked_gaf  # the function alone goes to executors, not its module

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = load()
        for b in batches:
            for at in range(0, len(b), most):
                part = b.iloc[at : at + most]
                fields = np.stack([field(np.asarray(x)) for x in part["chunk_sequence"]])
                yield pd.DataFrame({"chunkname": part["chunkname"].to_numpy(), "prediction": np.asarray(classify(fields)).astype(np.int32)})

    return chunks.select("chunkname", "chunk_sequence").mapInPandas(run, "chunkname string, prediction int")


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Loads an ONNX classifier on an executor; the path must be one that executors see."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x.astype(np.float32)})[0].argmax(axis=1)

    return load


def _decoded(predicted: DataFrame, read: str) -> tuple[DataFrame, DataFrame]:
    """Residues other than A with their read, and reads all of whose chunks are A."""
    p = predicted.select(read_of(F.col("chunkname")).alias(read), "chunkname", base_of(F.col("prediction")).alias("base"))
    all_a = p.groupBy(read).agg(F.min("base").alias("lo"), F.max("base").alias("hi")).where("lo = 'A' and hi = 'A'").select(read)
    return p.where("base <> 'A'"), all_a


def dorado_outputs(predicted: DataFrame, chunks: DataFrame, checked: DataFrame, original: DataFrame, qc: bool = True, digits: int = 0, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(read table, residue table).  ``checked`` are the summary's usable reads, ``original`` all; ``extra`` columns of both summaries go to both tables."""
    extra = extra or []
    found, all_a = _decoded(predicted, "read_id")
    center = (F.col("chunk_start_pos") + F.col("chunk_end_pos")) / 2
    length, samples = F.col("poly_tail_length"), 0.2 * (F.col("poly_tail_end") - F.col("poly_tail_start"))
    placed = found.join(chunks.select("read_id", "chunkname", center.alias("center")), ["read_id", "chunkname"], "left")
    placed = placed.join(checked.select("read_id", "poly_tail_length", "poly_tail_start", "poly_tail_end", "alignment_genome", "alignment_mapq", *extra), "read_id", "left")
    placed = placed.withColumn("est_nonA_pos", F.bround(length - F.try_divide(length * F.col("center"), samples), digits)).where("est_nonA_pos is not null")
    edge = at_end(F.col("est_nonA_pos"), length) if qc else F.lit(False)
    good = placed.where(~edge)
    blank = all_a.union(placed.where(edge).select("read_id")).distinct().withColumn("is_blank", F.lit(True))
    decorated = good.select("read_id").distinct()
    rest = original.join(decorated, "read_id", "left_anti").join(blank, "read_id", "left")
    code = comment_code(F.col("alignment_direction"), F.col("alignment_mapq"), length, F.col("poly_tail_start"), F.coalesce("is_blank", F.lit(False)))
    shape = lambda d: d.select(F.col("read_id").alias("readname"), F.col("alignment_genome").alias("contig"), F.col("poly_tail_length").alias("polya_length"), F.col("alignment_mapq").alias("qc_tag"), "class", "comments", *extra)
    plain = shape(rest.withColumn("comments", code).withColumn("class", class_of(F.col("comments"))))
    marked = shape(checked.join(decorated, "read_id", "left_semi").withColumns({"class": F.lit("decorated"), "comments": F.lit("YAY")}))
    residues = good.select(F.col("read_id").alias("readname"), F.col("alignment_genome").alias("contig"), F.col("base").alias("prediction"), "est_nonA_pos", F.col("poly_tail_length").alias("polya_length"), F.col("alignment_mapq").alias("qc_tag"), *extra)
    return plain.unionByName(marked), residues


def cdna_outputs(predicted: DataFrame, chunks: DataFrame, checked: DataFrame, known: DataFrame, qc: bool = True) -> tuple[DataFrame, DataFrame]:
    """(read table, residue table) of cDNA reads with their tail_type.

    Every known read is blank, but decorated if it has a residue that stays, blank again (MPU) if qc takes a residue at an end from it, whatever else it has, and unclassified if its tail is short; each
    read counts once.  Positions have two decimals."""
    found, _ = _decoded(predicted, "read_id")
    center, length = (F.col("chunk_start_pos") + F.col("chunk_end_pos")) / 2, F.col("poly_tail_length")
    samples = 0.2 * (F.col("poly_tail_end") - F.col("poly_tail_start"))
    own = checked.select("read_id", "poly_tail_length", "poly_tail_start", "poly_tail_end", "alignment_genome", "alignment_mapq", "tail_type")
    placed = found.join(chunks.select("read_id", "chunkname", center.alias("center")), ["read_id", "chunkname"]).join(own, "read_id")
    placed = placed.withColumn("est_nonA_pos", F.bround(length - F.try_divide(length * F.col("center"), samples), 2)).where("est_nonA_pos is not null")
    edge = at_end(F.col("est_nonA_pos"), length) if qc else F.lit(False)
    marks = placed.groupBy("read_id").agg(F.max(edge).alias("doubtful"), F.max(~edge).alias("good"))
    no = F.lit(False)
    once = first_of_each(known, "read_id", ["filename", "poly_tail_start"])
    code = cdna_code(F.coalesce("good", no), F.coalesce("doubtful", no), length)
    reads = once.join(marks, "read_id", "left").withColumn("comments", code).withColumn("class", class_of(F.col("comments")))
    names = [F.col("read_id").alias("readname"), F.col("alignment_genome").alias("contig")]
    rest = [F.col("poly_tail_length").alias("polya_length"), F.col("alignment_mapq").alias("qc_tag")]
    residues = placed.where(~edge).select(*names, F.col("base").alias("prediction"), "est_nonA_pos", *rest, "tail_type")
    return reads.select(*names, *rest, "class", "comments", "tail_type"), residues


def guppy_outputs(predicted: DataFrame, chunks: DataFrame, tails: DataFrame, nanopolish: DataFrame, pass_only: bool = True, qc: bool = True) -> tuple[DataFrame, DataFrame]:
    """(read table, residue table) of the older pipeline: tails (readname, signal_length); terminal residues stay, marked -WARN if qc."""
    found, all_a = _decoded(predicted, "readname")
    reads = nanopolish.select("readname", "contig", "polya_length", "qc_tag")
    placed = found.join(chunks.select("readname", "chunkname", (F.col("chunk_start_pos") + 50).alias("center")), ["readname", "chunkname"], "left")
    placed = placed.join(tails.select("readname", "signal_length"), "readname", "left").join(reads, "readname", "left")
    length = F.col("polya_length")
    placed = placed.withColumn("est_nonA_pos", F.bround(length - F.try_divide(length * F.col("center"), F.col("signal_length")), 2))
    edge = F.coalesce(at_end(F.col("est_nonA_pos"), length), F.lit(False))
    warned = lambda c, test: F.when(test, F.concat(c, F.lit("-WARN"))).otherwise(c) if qc else c
    residues = placed.select("readname", "contig", warned(F.col("base"), edge).alias("prediction"), "est_nonA_pos", "polya_length", "qc_tag").distinct()
    decorated = placed.groupBy("readname").agg(F.min(edge).alias("all_at_end"))
    blank = all_a.withColumn("is_blank", F.lit(True))
    code = guppy_code(length, F.col("qc_tag"), F.coalesce("is_blank", F.lit(False)), pass_only)
    plain = reads.join(decorated, "readname", "left_anti").join(blank, "readname", "left").withColumn("comments", code).withColumn("class", class_of(F.col("comments"))).drop("is_blank")
    marked = reads.join(decorated, "readname").withColumn("comments", F.lit("YAY")).withColumn("class", warned(F.lit("decorated"), F.col("all_at_end"))).drop("all_at_end")
    return plain.unionByName(marked).select("readname", "contig", "polya_length", "qc_tag", "class", "comments").distinct(), residues


def run_dorado(summary: DataFrame, signals: DataFrame, load: Callable, qc: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole direct-RNA run: (read table, residue table).  Signals are worked on once; what comes of them is stored, as both tables need it."""
    original = dorado_summary(summary, qc=False)
    checked = dorado_summary(summary, qc)
    marked = _good(stored(classified_chunks(tail_signals(checked, signals), load)))
    return dorado_outputs(marked, marked, checked, original, qc)


def _chunk_stages(run: Run, made: dict, parts: int, reads: DataFrame, read: str, tails: Callable[[DataFrame], DataFrame], load: Callable, chunks: Callable = K.chunks) -> DataFrame:
    """The classified chunks of all reads, a stage for each part of the reads' ids; how many reads came to nothing goes to the log."""
    tables = []
    for k in range(parts):
        own = reads.where(F.pmod(F.xxhash64(read), F.lit(parts)) == k) if parts > 1 else reads
        tables.append(run.stage(f"chunks_{k}", {**made, "part": k}, lambda own=own: classified_chunks(tails(own), load, chunks=chunks, read=read)))
    marked = reduce(lambda a, b: a.unionByName(b), tables)
    counts = dict(marked.groupBy("state").agg(F.countDistinct(read)).collect())
    for state in STATES[1:]:
        if counts.get(state):
            run.log(f"{counts[state]} reads {state}", "WARNING")
    return marked


def _lost(marked: DataFrame, wanted: DataFrame, read: str) -> DataFrame:
    """Reads that should have a result and have none: read, stage, problem."""
    missing = wanted.select(read).join(marked.select(read), read, "left_anti").select(read, F.lit("signal").alias("stage"), F.lit("no signal of this read").alias("problem"))
    return marked.where("state = 'failed'").select(read, F.lit("chunks").alias("stage"), "problem").unionByName(missing)


_TAILED = "poly_tail_length > 10 and poly_tail_start > 0"


def checked_tails(run: Run, summary: DataFrame, signals: DataFrame, load: Callable, qc: bool = True, parts: int = 1, key: object = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read table, residue table, reads without a result) of a direct-RNA run that can be ended and taken up again.

    Reads are dealt to ``parts`` by their id; each part is a stage of its own, and the filtered summary another.  What a stage was made of is known by the files of summary and signals, by qc
    and parts, and by ``key``, which should name the model.  Reads whose signal is missing, or whose signal failed, are listed with their stage and problem, and don't end the run."""
    made = {"summary": made_of(summary), "signals": made_of(signals), "qc": qc, "parts": parts, "key": key}
    original = dorado_summary(summary, qc=False)
    checked = run.stage("summary", {k: made[k] for k in ("summary", "qc")}, lambda: dorado_summary(summary, qc))
    marked = _chunk_stages(run, made, parts, checked, "read_id", lambda own: tail_signals(own, signals), load)
    classes, residues = dorado_outputs(_good(marked), _good(marked), checked, original, qc)
    return classes, residues, _lost(marked, checked.where(_TAILED), "read_id")


def check_tails_dorado(run: Run, summary: DataFrame, signals: DataFrame, load: Callable, qc: bool = True, parts: int = 1, key: object = None, clean: bool = False) -> dict[str, DataFrame]:
    """The whole direct-RNA run with its outputs: read_classes, nonadenosine_residues and lost_reads, published together in the run's folder, with its log."""
    classes, residues, lost = checked_tails(run, summary, signals, load, qc, parts, key)
    return run.finish({"read_classes": classes, "nonadenosine_residues": residues, "lost_reads": lost}, clean)


def check_tails_guppy(run: Run, nanopolish: DataFrame, sequencing: DataFrame, signals: DataFrame, load: Callable, pass_only: bool = True, qc: bool = True, parts: int = 1, key: object = None, clean: bool = False) -> dict[str, DataFrame]:
    """The whole older run with its outputs, as ``check_tails_dorado``: nanopolish's calls (or converted ones) and a sequencing summary tell the reads."""
    made = {"nanopolish": made_of(nanopolish), "sequencing": made_of(sequencing), "signals": made_of(signals), "pass_only": pass_only, "qc": qc, "parts": parts, "key": key}
    reads = polya(nanopolish, sequencing, pass_only)
    tails = run.stage("tails", {k: v for k, v in made.items() if k not in ("qc", "parts", "key")}, lambda: guppy_tails(reads, signals).select("readname", "tail_signal", "signal_length", "reject_reason"))
    for r in tails.where("reject_reason is not null").groupBy("reject_reason").count().collect():
        run.log(f"{r['count']} reads {r.reject_reason}", "WARNING")
    good = tails.where("reject_reason is null")
    marked = _chunk_stages(run, made, parts, good, "readname", lambda own: own, load, K.guppy_chunks)
    classes, residues = guppy_outputs(_good(marked), _good(marked), good, nanopolish, pass_only, qc)
    lost = _lost(marked, reads.join(tails.where("reject_reason is not null"), "readname", "left_anti"), "readname")
    return run.finish({"read_classes": classes, "nonadenosine_residues": residues, "lost_reads": lost}, clean)


def check_tails_cdna(run: Run, aligned: DataFrame, summary: DataFrame, signals: DataFrame, load: Callable, qc: bool = True, parts: int = 1, key: object = None, clean: bool = False) -> dict[str, DataFrame]:
    """The whole cDNA run with its outputs: the two tables with tail_type, reads without an orientation, lost reads, and statistics by type.  The orientation of the alignment records' sequences is a stage of its own."""
    made = {"aligned": made_of(aligned), "summary": made_of(summary), "signals": made_of(signals), "qc": qc, "parts": parts, "key": key}
    calls = run.stage("calls", {k: made[k] for k in ("aligned", "summary", "key")}, lambda: with_tail_type(tailed_reads(aligned, summary).select("read_id", "sequence")).select("read_id", "tail_type"))
    typed = dorado_summary(summary, qc=False).join(calls, "read_id", "left").withColumn("tail_type", F.coalesce("tail_type", F.lit("unidentified")))
    known, rest = typed.where("tail_type in ('polyA', 'polyT')"), typed.where("tail_type = 'unidentified'")
    marked = _chunk_stages(run, made, parts, known, "read_id", lambda own: tail_signals(own, signals), load)
    classes, residues = cdna_outputs(_good(marked), _good(marked), known, known, qc)
    kind = lambda k: classes.where(F.col("tail_type") == k)
    statistics = merged_statistics(kind("polyA"), kind("polyT"), rest, residues)
    return run.finish({"read_classes": classes, "nonadenosine_residues": residues, "unidentified_reads": rest.select("read_id", "tail_type"), "lost_reads": _lost(marked, known.where(_TAILED), "read_id"), "statistics": statistics}, clean)


def run_cdna(summary: DataFrame, signals: DataFrame, calls: DataFrame, load: Callable, qc: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(read table, residue table, reads without a call) of cDNA reads: tail_type polyA or polyT by read_id comes from ``calls``."""
    typed = dorado_summary(summary, qc=False).join(calls.select("read_id", "tail_type").distinct(), "read_id", "left").withColumn("tail_type", F.coalesce("tail_type", F.lit("unidentified")))
    known = typed.where("tail_type in ('polyA', 'polyT')")
    marked = _good(stored(classified_chunks(tail_signals(known, signals), load)))
    classes, residues = cdna_outputs(marked, marked, known, known, qc)
    return classes, residues, typed.where("tail_type = 'unidentified'")


def run_cdna_from_bam(aligned: DataFrame, summary: DataFrame, signals: DataFrame, load: Callable, qc: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(read table, residue table, reads without a call, statistics of the calls) from alignment records (``sources.bam.read_bam``), a summary and signals.

    Sequences are those of mapped primary records with a tail call; their orientation is found once and stored."""
    reads = tailed_reads(aligned, summary).select("read_id", "sequence")
    calls = stored(with_tail_type(reads).select("read_id", "tail_type"))
    classes, residues, rest = run_cdna(summary, signals, calls, load, qc)
    return classes, residues, rest, type_statistics(calls)


def merged_statistics(polya: DataFrame | None, polyt: DataFrame | None, unidentified: DataFrame | None, residues: DataFrame | None = None) -> DataFrame:
    """tail_type, reads, percent of all reads (two decimals) and residues for polyA, polyT and unidentified reads, and a row for the total; a missing table has no reads."""
    some = next((d for d in (polya, polyt, unidentified, residues) if d is not None), None)
    if some is None:
        raise ValueError("no table is given")
    kinds = {"polyA": polya, "polyT": polyt, "unidentified": unidentified}
    spark = some.sparkSession
    every = spark.createDataFrame([(k, 0, 0) for k in kinds], "tail_type string, reads long, residues long")
    each = [d.select(F.lit(k).alias("tail_type"), F.lit(1).cast("long").alias("reads"), F.lit(0).cast("long").alias("residues")) for k, d in kinds.items() if d is not None]
    if residues is not None:
        each.append(residues.select("tail_type", F.lit(0).cast("long").alias("reads"), F.lit(1).cast("long").alias("residues")))
    counts = reduce(lambda a, b: a.unionByName(b), each, every).rollup("tail_type").agg(F.sum("reads").alias("reads"), F.sum("residues").alias("residues"), F.grouping("tail_type").alias("_all"))
    counts = counts.withColumn("tail_type", F.when(F.col("_all") == 1, "total").otherwise(F.col("tail_type"))).drop("_all")
    total = F.max("reads").over(Window.partitionBy(F.lit(1)))  # of four rows
    return counts.select("tail_type", "reads", F.coalesce(F.round(F.try_divide(F.col("reads"), total) * 100, 2), F.lit(0.0)).alias("percent"), "residues")


def merge_cdna(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of polyA and polyT reads under one another; a missing tail_type is the part's name."""
    named = [d if "tail_type" in d.columns else d.withColumn("tail_type", F.lit(kind)) for kind, d in parts.items()]
    out = named[0]
    for d in named[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def guppy_tails(reads: DataFrame, signals: DataFrame) -> DataFrame:
    """readname, tail_signal, tail_moves and signal_length from signals (readname, signal, moves, stride): the tail from polya_start to before transcript_start
    (places from 1), moves spread over their stride; reads without any move, or without five equal moves in a row, have a reject_reason."""
    d = reads.join(signals, "readname")
    spread = F.flatten(F.transform("moves", lambda m: F.array_repeat(m, F.col("stride"))))
    count = F.greatest(F.col("transcript_start") - F.col("polya_start"), F.lit(0)).cast("int")
    cut = lambda c: F.slice(c, F.col("polya_start").cast("int"), count)
    d = d.withColumns({"tail_signal": K.resampled(K.winsorized(cut(F.col("signal")))), "tail_moves": K.resampled(cut(spread))}).withColumn("pseudomoves", K.moves("tail_signal"))
    still = F.aggregate("tail_moves", F.lit(0).cast("long"), lambda a, x: a + x) == 0
    return d.withColumn("signal_length", F.size("tail_signal")).withColumn("reject_reason", F.when(still, "zeromoved").when(~K.has_run("pseudomoves"), "nonpseudomoved"))


def run_guppy(nanopolish: DataFrame, reads: DataFrame, signals: DataFrame, load: Callable, pass_only: bool = True, qc: bool = True) -> tuple[DataFrame, DataFrame]:
    """The older run; reads: what ``sources.readers.polya`` gives."""
    tails = stored(guppy_tails(reads, signals).where("reject_reason is null"))
    marked = _good(stored(classified_chunks(tails, load, chunks=K.guppy_chunks, read="readname")))
    return guppy_outputs(marked, marked, tails, nanopolish, pass_only, qc)


def training_chunks(tails: DataFrame, nucleotide: str, read: str = "read_id") -> DataFrame:
    """Chunks to train a classifier with: A from tails without four moves in a row, cut with overlaps; C and U from negative runs, G from positive ones."""
    if nucleotide == "A":
        return chunk_rows(tails, moves=K.training_moves, chunks=K.pure_chunks, read=read)
    return chunk_rows(tails, moves=K.training_moves, chunks=K.signed_chunks(1 if nucleotide == "G" else -1), read=read)
