"""Runs from signals to tables, sources and sinks on small fixtures."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyquill.functions import signal as K
from polyquill.operators import post as P
from polyquill.operators import runs as R
from polyquill.sources import bam, readers, signals

SUMMARY = "input_filename string, read_id string, poly_tail_length int, poly_tail_start int, poly_tail_end int, alignment_genome string, alignment_direction string, alignment_mapq int"


def test_outputs_of_the_known_reads(spark):
    """Six reads, one for each reason; the residue of chunk 50..149 on a tail of 100 lies at 50."""
    rows = [("f", "yay", 100, 10, 1010, "g", "+", 60), ("f", "mpu", 100, 10, 1010, "g", "+", 60), ("f", "unm", 100, 10, 1010, "*", "*", 0), ("f", "irl", 5, 10, 60, "g", "+", 60), ("f", "bac", 100, 0, 1010, "g", "+", 60), ("f", "mau", 100, 10, 1010, "g", "+", 60)]
    summary = spark.createDataFrame(rows, SUMMARY)
    predicted = spark.createDataFrame([("yay_1", 1), ("mpu_1", 0)], "chunkname string, prediction int")
    chunks = spark.createDataFrame([("yay", "yay_1", 50, 149), ("mpu", "mpu_1", 50, 149)], "read_id string, chunkname string, chunk_start_pos int, chunk_end_pos int")
    classes, residues = R.dorado_outputs(predicted, chunks, R.dorado_summary(summary), R.dorado_summary(summary, False))
    assert {r.readname: (r["class"], r.comments) for r in classes.collect()} == {
        "yay": ("decorated", "YAY"), "mpu": ("blank", "MPU"), "unm": ("unclassified", "UNM"), "irl": ("unclassified", "IRL"), "bac": ("unclassified", "BAC"), "mau": ("blank", "MAU"),
    }
    assert [tuple(r) for r in residues.collect()] == [("yay", "g", "C", 50.0, 100, 60)]
    with pytest.raises(ValueError, match="poly_tail_start"):
        R.dorado_summary(summary.drop("poly_tail_start"))


def _raw(seed):
    r = np.random.default_rng(seed)
    x = np.rint(r.normal(650, 6, 3000))
    x[1200:1500] += 250
    return [int(v) for v in x]


def test_a_whole_run(spark):
    """Signals to tables by a model that calls every chunk C."""
    rows = [("f", f"r{i}", 100, 100, 2600, "g", "+", 60) for i in range(4)] + [("f", "short", 9, 5, 20, "g", "+", 60)]
    summary = spark.createDataFrame(rows, SUMMARY)
    raw = spark.createDataFrame([(f"r{i}", _raw(i)) for i in range(4)], "read_id string, signal array<int>")
    classes, residues = R.run_dorado(summary, raw, lambda: lambda x: np.ones(len(x), int))
    got = residues.groupBy("readname").agg(F.collect_list("est_nonA_pos").alias("p")).collect()
    assert {r.readname for r in got} == {f"r{i}" for i in range(4)}
    # the raised stretch is centred on sample 1350 of the signal: (1350 - 100) of 2500 samples from the tail's start
    assert all(any(abs(p - 50) <= 6 for p in r.p) for r in got)
    assert {r.readname: r.comments for r in classes.collect()} == {**{f"r{i}": "YAY" for i in range(4)}, "short": "IRL"}
    calls = spark.createDataFrame([("r0", "polyA"), ("r1", "polyT")], "read_id string, tail_type string")
    classes, residues, rest = R.run_cdna(summary, raw, calls, lambda: lambda x: np.full(len(x), 3))
    assert {(r.readname, r.tail_type) for r in classes.collect()} == {("r0", "polyA"), ("r1", "polyT")}
    assert {r.prediction for r in residues.collect()} == {"U"} and rest.count() == 3
    merged = R.merge_cdna({"polyA": classes.drop("tail_type").where("readname = 'r0'"), "polyT": classes.where("readname = 'r1'")})
    assert {(r.readname, r.tail_type) for r in merged.collect()} == {("r0", "polyA"), ("r1", "polyT")}


def test_tails_out_of_bounds_are_empty_and_make_no_chunks(spark):
    summary = spark.createDataFrame([("f", "a", 50, 100, 9000, "g", "+", 60), ("f", "b", 10, 100, 200, "g", "+", 60)], SUMMARY.replace("input_", ""))
    raw = spark.createDataFrame([("a", _raw(1)), ("b", _raw(2))], "read_id string, signal array<int>")
    tails = R.tail_signals(summary, raw)
    assert [(r.read_id, r.tail_signal) for r in tails.collect()] == [("a", [])]
    assert R.chunk_rows(tails).count() == 0


def test_guppy_run_and_training_chunks(spark):
    reads = spark.createDataFrame([("x_1", 101, 2601, 100.0, "PASS", "f"), ("still", 101, 2601, 100.0, "PASS", "f")], "readname string, polya_start int, transcript_start int, polya_length double, qc_tag string, filename string")
    raw = spark.createDataFrame([("x_1", _raw(0), [1, 0, 1] * 200, 5), ("still", _raw(1), [0] * 600, 5)], "readname string, signal array<int>, moves array<int>, stride int")
    tails = R.guppy_tails(reads, raw)
    assert {r.readname: (r.signal_length, r.reject_reason) for r in tails.collect()} == {"x_1": (500, None), "still": (500, "zeromoved")}
    nano = reads.select("readname", F.lit("c").alias("contig"), "polya_length", "qc_tag")
    classes, residues = R.run_guppy(nano, reads, raw, lambda: lambda x: np.full(len(x), 2))
    assert {r.readname: r.comments for r in classes.collect()} == {"x_1": "YAY", "still": "MAU"}
    assert residues.where("prediction = 'G'").count() >= 1
    x = np.rint(np.random.default_rng(3).normal(650, 12, 400)).astype(int)
    x[200:208] += 300
    up, down = K.signed_chunks(1)(x, K.training_moves(x)), K.signed_chunks(-1)(x, K.training_moves(x))
    assert len(up) >= 1 and all(len(v) == 100 and s >= 0 for s, v in up + down)
    flat = np.tile([640, 650, 660], 100)
    assert len(K.pure_chunks(flat, K.training_moves(flat))) == 6 and K.pure_chunks(flat, np.ones(300)) == []
    moves = K.training_moves(x)
    assert not moves[:5].any() and not moves[-6:].any()
    assert R.training_chunks(spark.createDataFrame([("f", [int(v) for v in flat])], "read_id string, tail_signal array<int>"), "A").count() == 6


def test_kernels(spark):
    with pytest.raises(ValueError):
        K.stacked_gaf(np.arange(50))
    assert K.stacked_gaf(np.arange(100)).shape == (100, 100, 2)
    assert K.longest_run(np.array([0, 1, 1, 1, 0, -1, -1]), 1) == 3 and K.longest_run(np.array([0, 0])) == 0
    grid, values = K.density(np.random.default_rng(0).normal(5, 1, 400))
    assert abs(grid[np.argmax(values)] - 5) < 0.5 and abs(np.trapezoid(values, grid) - 1) < 0.02
    d = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "s array<int>")
    assert d.select(K.tail_crop(F.col("s"), F.lit(3), F.lit(4), 1)).first()[0] == [2, 3, 4, 5]
    assert d.select(K.tail_crop(F.col("s"), F.lit(1), F.lit(6), 150)).first()[0] == [1, 2, 3, 4, 5, 6]


def _bam(records):
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    for name, flag, ref, pos, seq, tags in records:
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4)
        s = [code[c] for c in seq] + [0] * (len(seq) % 2)
        body += bytes(a << 4 | b for a, b in zip(s[::2], s[1::2])) + b"\xff" * len(seq) + tags
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2
    return gzip.compress(out[:half]) + gzip.compress(out[half:])  # blocks are members of their own


def test_bam(spark, tmp_path):
    pa = b"paBi" + struct.pack("<i5i", 5, 10, 20, 30, -1, -1)
    pt = b"pti" + struct.pack("<i", 42)
    rows = [("r1", 0, 0, 7, "ACGTN", pt + pa), ("r1", 0, 0, 90, "ACG", pt + pa), ("r2", 256, 0, 8, "AC", pt + pa), ("r3", 4, -1, 0, "A", pt + pa), ("r4", 16, 0, 9, "TTT", b"xsZhello\0" + pa), ("r5", 16, 0, 9, "TTT", b"ptC\x07")]
    (tmp_path / "a.bam").write_bytes(_bam(rows))
    df = bam.read_bam(spark, str(tmp_path / "a.bam"))
    got = {(r.read_id, r.pos): r for r in df.collect()}
    assert len(got) == 6 and got["r1", 7].sequence == "ACGTN" and got["r1", 7].cigar == "5M" and got["r1", 7].pa == [10, 20, 30, -1, -1] and got["r5", 9].pt == 7 and got["r4", 9].pt is None and got["r1", 7].reference == "chr1"
    summary = spark.createDataFrame([("r1", "f1"), ("r5", "f5")], "read_id string, filename string")
    assert sorted((r.read_id, r.pos, r.filename) for r in bam.tailed_reads(df, summary).collect()) == [("r1", 7, "f1"), ("r5", 9, "f5")]
    with pytest.raises(ValueError, match="pa"):
        bam.tailed_reads(df.where("read_id = 'r5'"), summary)
    assert bam.split_by_reads(df, summary).count() == 3


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(RuntimeError, match="pod5"):
        signals.read_pod5(spark, str(tmp_path))
    assert signals.fast5_problem(["read_1"], "Basecall_1D_000", "rna") is None and "RNA" in signals.fast5_problem(["read_1"], "g", "dna")
    nano = spark.createDataFrame([("a", "PASS")], "readname string, qc_tag string")
    assert readers.tail_lengths(spark, nano)[1] == "nanopolish"
    with pytest.raises(ValueError, match="cDNA"):
        readers.tail_lengths(spark, spark.createDataFrame([(True,)], "tail_is_valid boolean"))
    with pytest.raises(ValueError, match="neither"):
        readers.tail_lengths(spark, spark.createDataFrame([(True,)], "x boolean"))
    paths = readers.save_outputs({"read_classes": nano}, str(tmp_path), "run", now="now")
    assert readers.table(spark, paths["read_classes"]).collect()[0].qc_tag == "PASS"
    with pytest.raises(ValueError, match="empty"):
        readers.ready_folder(spark, str(tmp_path))
    readers.ready_folder(spark, str(tmp_path / "new"))
    samples = readers.read_config("samples:\n  s1:\n    class_path: /nowhere.tsv\n  s2:\n    group: ko\n    class_path: PATH\n".replace("PATH", str(tmp_path / "c.tsv")))
    (tmp_path / "c.tsv").write_text("readname\tcontig\tclass\tcomments\nr\tENST1.2|a|b|c|d|NAME|x\tmodified\tYAY\n")
    df, problems = readers.read_configured(spark, samples)
    row = df.first()
    assert len(problems) == 1 and "s1" in problems[0] and (row["class"], row.transcript, row.ensembl_transcript_id_short, row.group) == ("decorated", "NAME", "ENST1", "ko")
    assert readers.classified_path("/x/y.fasta") == "/x/y_classified.tsv" and readers.save_cdna({"a": None}, nano)["a"].count() == 0
    files = spark.createDataFrame([("b_xyz.pod5",), ("a.pod5",)], "filename string")
    assert signals.file_of(files, "xyz").first()[0] == "b_xyz.pod5" and signals.file_of(files, "none").first()[0] == "a.pod5"


def test_merge_drops_and_fills(spark):
    classes = spark.createDataFrame([("a", "PASS", "decorated"), ("b", "PASS", "unclassified"), ("c", "ADAPTER", "blank"), ("d", "PASS", "blank"), (None, "PASS", "blank")], "readname string, qc_tag string, class string").withColumn("group", F.lit("g"))
    residues = spark.createDataFrame([("a", "PASS", "C", 41.0), ("a", "PASS", "G", 7.5), (None, "PASS", "C", 3.0)], "readname string, qc_tag string, prediction string, est_nonA_pos double").withColumn("group", F.lit("g"))
    got = {r.readname: r for r in P.merge_tables(classes, residues).collect()}
    assert set(got) == {"a", "d", None} and got["a"].nonA_residues == "G7.5:C41" and (got["a"].prediction_C, got["d"].prediction_C, got["d"].nonA_residues) == (1, 0, None)
    assert got[None].prediction_C == 1 and got[None]["class"] == "blank"  # null matches null
    numeric = classes.withColumn("qc_tag", F.lit(0))
    assert P.merge_tables(numeric, residues.withColumn("qc_tag", F.lit(0))).where("class is not null").count() == 0


def test_reclassified_reads(spark):
    """A decorated read all of whose residues are doubtful becomes blank."""
    n = 40
    classes = spark.createDataFrame([(f"r{i}", "t", 100.0, "decorated", "YAY") for i in range(n)], "readname string, transcript string, polya_length double, class string, comments string")
    residues = spark.createDataFrame([(f"r{i}", "t", 100.0, "C", 2.0 if i < 30 else 100.0 + i) for i in range(n)], "readname string, transcript string, polya_length double, prediction string, est_nonA_pos double")
    reads, left = P.reclassified(classes, residues, "transcript")
    by = {r.readname: (r["class"], r.comments) for r in reads.collect()}
    assert by["r0"] == ("blank", "MPU") and by["r39"] == ("decorated", "YAY") and {r.readname for r in left.collect()} == {f"r{i}" for i in range(30, 40)}
    of_species = P.whitelist(spark.createDataFrame([("hsapiens", "t"), ("hsapiens", "t"), ("mmusculus", "x")], "species string, transcript string"), "hsapiens")
    assert [r.transcript for r in of_species.collect()] == ["t"]
    for known in (["t"], of_species):
        listed = P.reclassified(classes, residues, "transcript", listed=known)[0]
        assert {r["class"] for r in listed.collect()} == {"decorated"} and listed.count() == n
    assert P.reclassified(classes, residues, "transcript", listed=of_species.where("false"))[0].where("class = 'blank'").count() > 0
    with pytest.raises(ValueError, match="hsapiens"):
        P.whitelist(None, "hsapiens")


def test_other_tables(spark):
    d = spark.createDataFrame([(i % 3, i, "YAY" if i % 4 else "MAU") for i in range(30)], "g int, id int, c string")
    a, b = (sorted(map(tuple, P.seeded_sample(x, "g", "id", 4).collect())) for x in (d, d.repartition(5)))
    assert a == b and len(a) == 12
    assert [r.c for r in P.level_order(d.select("c").distinct(), "c", ["YAY"]).collect()] == ["MAU", "YAY"] and [r.g for r in P.pick_list(d, "g").collect()] == [0, 1, 2]
    assert [(r.previous, r.next) for r in P.neighbours(d.where("id < 3"), "id").orderBy("id").collect()] == [(None, 1), (0, 2), (1, None)]
    signal = spark.createDataFrame([("a",), ("b",)], "read_id string")
    classes = spark.createDataFrame([("a", "blank", "MAU"), ("a", "blank", "MAU")], "readname string, class string, comments string")
    assert sorted((r.read_id, r["class"] or "") for r in P.with_class(signal, classes).collect()) == [("a", "blank"), ("b", "")]
    from polyquill.functions import scalar as S

    best = spark.range(1).select(S.best_match(F.lit("TTTACGTTT"), "ACG", 1, 9).alias("m")).first().m
    assert (best.position, best.distance, best.matched) == (4, 0, "ACG")
