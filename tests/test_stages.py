"""Runs that can be taken up again, failures of single reads, the signal store and published tables."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from polyquill.operators import runs as R
from polyquill.sources import readers, stages, store

SUMMARY = "filename string, read_id string, poly_tail_length int, poly_tail_start int, poly_tail_end int, alignment_genome string, alignment_direction string, alignment_mapq int"


def _raw(seed, n=3000):
    r = np.random.default_rng(seed)
    x = np.rint(r.normal(650, 6, n))
    x[1200:1500] += 250
    return [int(v) for v in x]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    rows = [("f", f"r{i:02d}", 100, 100, 2600, "g", "+", 60) for i in range(24)] + [("f", "short", 9, 5, 20, "g", "+", 60), ("f", "gone", 100, 100, 2600, "g", "+", 60)]
    spark.createDataFrame(rows, SUMMARY).write.parquet(str(folder / "summary"))
    raw = [(f"r{i:02d}", _raw(i)) for i in range(24)]
    spark.createDataFrame(raw, "read_id string, signal array<int>").write.parquet(str(folder / "signals"))
    return spark.read.parquet(str(folder / "summary")), spark.read.parquet(str(folder / "signals"))


def _counting(spark, broken=False):
    """A model that calls every chunk C, and a counter of the chunks it got."""
    seen = spark.sparkContext.accumulator(0)

    def load():
        if broken:
            raise RuntimeError("the model can't be loaded")

        def classify(fields):
            seen.add(len(fields))
            return np.ones(len(fields), int)

        return classify

    return load, seen


def test_kernels_run_once_a_read(spark, tables):
    load, seen = _counting(spark)
    classes, residues = R.run_dorado(*tables, load)
    assert classes.count() == 26 and residues.count() > 0 and classes.where("class = 'decorated'").count() == 24
    once = seen.value
    assert once == R.chunk_rows(R.tail_signals(R.dorado_summary(tables[0]), tables[1])).count()


def test_a_killed_run_goes_on(spark, tables, tmp_path):
    summary, signals = tables
    run = stages.Run(spark, str(tmp_path / "run"), "x")
    good, counted = _counting(spark)
    key = {"model": 1}
    made = {"summary": stages.made_of(summary), "signals": stages.made_of(signals), "qc": True, "parts": 4, "key": key}
    checked = run.stage("summary", {k: made[k] for k in ("summary", "qc")}, lambda: R.dorado_summary(summary, True))
    for k in range(2):
        own = checked.where(F.pmod(F.xxhash64("read_id"), F.lit(4)) == k)
        run.stage(f"chunks_{k}", {**made, "part": k}, lambda own=own: R.classified_chunks(R.tail_signals(own, signals), good))
    first = counted.value
    broken, _ = _counting(spark, broken=True)  # parts before this one's are there
    with pytest.raises(Exception, match="can't be loaded"):
        R.checked_tails(run, summary, signals, broken, parts=4, key=key)
    assert sorted(run.stages()) == ["chunks_0", "chunks_1", "summary"]
    again = stages.Run(spark, str(tmp_path / "run"), "y")
    classes, residues, lost = R.checked_tails(again, summary, signals, good, parts=4, key=key)
    whole, total = R.run_dorado(summary, signals, _counting(spark)[0])
    assert sorted(map(tuple, classes.collect())) == sorted(map(tuple, whole.collect())) and sorted(map(tuple, residues.collect())) == sorted(map(tuple, total.collect()))
    assert [tuple(r) for r in lost.collect()] == [("gone", "signal", "no signal of this read")]
    done = counted.value
    assert done > first
    R.checked_tails(stages.Run(spark, str(tmp_path / "run"), "z"), summary, signals, good, parts=4, key=key)[0].count()
    assert counted.value == done  # nothing was computed again
    log = (tmp_path / "run" / f"{again.stamp}.log").read_text()
    assert "chunks_0: as before" in log and "chunks_3: written" in log
    other = R.checked_tails(stages.Run(spark, str(tmp_path / "run"), "w"), summary, signals, good, parts=4, key={"model": 2})
    assert other[0].count() == 26 and counted.value > done  # another model
    assert stages.Run(spark, str(tmp_path / "run")).clean() == 5 and not again.stages()


def test_a_bad_signal_costs_its_read_only(spark):
    rows = [("f", f"r{i}", 100, 100, 2600, "g", "+", 60) for i in range(5)]
    summary = spark.createDataFrame(rows, SUMMARY)
    raw = spark.createDataFrame([(f"r{i}", _raw(i)) for i in range(5)], "read_id string, signal array<int>")
    tails = R.tail_signals(summary, raw).coalesce(1)
    bad = tails.withColumn("tail_signal", F.when(F.col("read_id") == "r3", F.array(*[F.lit(None).cast("long")] * 300)).otherwise(F.col("tail_signal")))

    def load():
        def classify(fields):
            if np.isnan(fields).any():
                raise ValueError("no numbers")
            return np.ones(len(fields), int)

        return classify

    still = spark.createDataFrame([("flat", [7] * 400), ("none", None), ("empty", [])], "read_id string, tail_signal array<long>")
    got = R.classified_chunks(bad.unionByName(still), load).collect()
    by = {}
    for r in got:
        by.setdefault(r.read_id, []).append(r)
    assert {k: {r.state for r in v} for k, v in by.items()} == {**{f"r{i}": {"chunked"} for i in (0, 1, 2, 4)}, "r3": {by["r3"][0].state}, "flat": {"zeromoved"}, "none": {"zeromoved"}, "empty": {"zeromoved"}}
    assert by["r3"][0].state in ("failed", "zeromoved")
    picky = R.classified_chunks(tails, lambda: lambda fields: (_ for _ in ()).throw(ValueError("odd")) if len(fields) else fields).collect()
    assert {r.state for r in picky} == {"failed"} and {r.problem for r in picky} == {"ValueError: odd"} and len(picky) == 5
    few = R.classified_chunks(tails, lambda: lambda fields: np.ones(1, int)).collect()
    assert any(r.state == "failed" and "number of classes" in r.problem for r in few) or all(r.state == "chunked" for r in few)


def test_signals_stay_in_their_buckets(spark, tables, tmp_path):
    summary, signals = tables
    path = str(tmp_path / "store")
    many = signals.unionByName(spark.range(400).select(F.format_string("z%05d", "id").alias("read_id"), F.array_repeat((F.col("id") % 500).cast("int"), 2000).alias("signal")))
    store.write_store(many, path, buckets=4, group_bytes=100_000)
    with pytest.raises(FileExistsError):
        store.write_store(many, path)
    kept = store.open_store(spark, path)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tails = R.tail_signals(summary, kept)
        plan = _plan(tails)
        scan = next(line for line in plan.splitlines() if "signal#" in line and "FileScan" in line)
        above = plan[: plan.index(scan)].splitlines()
        depth = len(scan) - len(scan.lstrip(" :+-*()0123456789"))
        parents, limit = [], depth
        for line in reversed(above):  # the operators over the scan of signals
            d = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if d < limit:
                parents.append(line)
                limit = d
        assert parents and not any("Exchange" in p or "Sort " in p for p in parents), plan
        assert any("ShuffledHashJoin" in p for p in parents)
        plain = R.tail_signals(summary, signals)
        assert sorted(map(tuple, tails.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one = store.lookup(kept, "z00123")
    assert [r.signal for r in one.collect()] == [[123] * 2000]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    groups = {meta.row_group(g).num_rows for f in (tmp_path / "store" / "signals").glob("*.parquet") for meta in [pq.ParquetFile(f).metadata] for g in range(meta.num_row_groups)}
    assert scan.metrics().apply("numOutputRows").value() in groups  # what one row group holds; the other buckets' ids enclose the wanted one too
    holding = []
    for f in (tmp_path / "store" / "signals").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        holding.append(sum(meta.row_group(g).column(0).statistics.min <= "z00123" <= meta.row_group(g).column(0).statistics.max for g in range(meta.num_row_groups)))
        assert meta.num_row_groups > 1
    assert max(holding) == 1
    spark.sql(f"DROP TABLE {store._name(path)}")  # as in another session: the files stay
    assert store.open_store(spark, path).count() == many.count()
    shown = store.full_signal(store.open_store(spark, path), "r01").first()
    x = np.array(_raw(1), float)
    assert shown.signal == np.trunc(np.clip(x, *np.quantile(x, [0.002, 0.998]))).astype(int).tolist()
    assert store.full_signal(store.open_store(spark, path), "r01", winsorize=False).first().signal == _raw(1)


def test_tables_are_published_together(spark, tmp_path):
    good = spark.createDataFrame([("a", 1.0), ("b", None)], "readname string, polya_length double")
    bad = good.withColumn("x", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        stages.publish(spark, {"read_classes": good, "nonadenosine_residues": bad}, str(tmp_path), "now")
    assert [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")] == []
    with pytest.raises(FileNotFoundError):
        stages.published(spark, str(tmp_path))
    paths = readers.save_outputs({"read_classes": good, "nonadenosine_residues": good}, str(tmp_path), "run", now="now")
    assert set(paths) == {"read_classes", "nonadenosine_residues"} and all("now_run" in p for p in paths.values())
    got = stages.published(spark, str(tmp_path))
    assert got["read_classes"].schema == good.schema and sorted(map(tuple, got["read_classes"].collect()), key=str) == sorted(map(tuple, good.collect()), key=str)
    with pytest.raises(FileExistsError):
        readers.save_outputs({"read_classes": good}, str(tmp_path), "run", now="now")
    assert re.match(r".*/now_run_outputs/read_classes\.tsv$", paths["read_classes"])


def test_whole_runs_publish_their_tables(spark, tables, tmp_path):
    summary, signals = tables
    said = []
    run = stages.Run(spark, str(tmp_path / "drs"), "x", say=lambda line, level: said.append((level, line)))
    out = R.check_tails_dorado(run, summary, signals, _counting(spark)[0], parts=2, clean=True)
    assert set(out) == {"read_classes", "nonadenosine_residues", "lost_reads"} and out["read_classes"].count() == 26
    assert {r.read_id for r in out["lost_reads"].collect()} == {"gone"} and not run.stages()
    assert any("runtime" in line for _, line in said) and ("INFO", "4 folders of stages removed") not in said and any("stages removed" in line for _, line in said)
    assert stages.published(spark, str(tmp_path / "drs"))["nonadenosine_residues"].count() == out["nonadenosine_residues"].count()

    nano = spark.createDataFrame([("x_1", "c", 101.0, 2601.0, 100.0, "PASS"), ("still", "c", 101.0, 2601.0, 100.0, "PASS"), ("away", "c", 101.0, 2601.0, 100.0, "PASS"), ("bad", "c", 1.0, 2.0, 100.0, "ADAPTER")], "readname string, contig string, polya_start double, transcript_start double, polya_length double, qc_tag string")
    sequencing = spark.createDataFrame([(n, "f") for n in ("x_1", "still", "away", "bad")], "read_id string, filename string")
    raw = spark.createDataFrame([("x_1", _raw(0), [1, 0, 1] * 200, 5), ("still", _raw(1), [0] * 600, 5)], "readname string, signal array<int>, moves array<int>, stride int")
    old = stages.Run(spark, str(tmp_path / "guppy"))
    out = R.check_tails_guppy(old, nano, sequencing, raw, lambda: lambda x: np.full(len(x), 2))
    assert {r.readname: r.comments for r in out["read_classes"].collect()} == {"x_1": "YAY", "still": "MAU", "away": "MAU", "bad": "QCF"}
    assert {r.prediction for r in out["nonadenosine_residues"].collect()} == {"G"} and {r.readname for r in out["lost_reads"].collect()} == {"away"}
    assert any("zeromoved" in line for line in old.lines)


def test_a_whole_cdna_run_goes_on_after_its_orientation(spark, tmp_path):
    import struct

    from polyquill.functions import matching as M
    from polyquill.sources import bam
    from tests.test_bam import bgzf, header, record

    tags = b"pti" + struct.pack("<i", 100) + b"paBi" + struct.pack("<i5i", 5, 1, 100, 2600, -1, -1)
    kinds = {"a1": M.FRONT + "A" * 120 + M.reverse_complement(M.REAR), "t1": M.REAR + "T" * 120 + M.reverse_complement(M.FRONT), "u1": "ACGT" * 60}
    (tmp_path / "c.bam").write_bytes(bgzf(header(["one"]) + b"".join(record(n, 0, 0, 5, 60, [(len(s), "M")], s, None, tags) for n, s in kinds.items()), [200]))
    spark.createDataFrame([("f", n, 100, 100, 2600, "one", "+", 60) for n in kinds], SUMMARY).write.parquet(str(tmp_path / "summary"))
    spark.createDataFrame([(n, _raw(i)) for i, n in enumerate(("a1", "u1"))], "read_id string, signal array<int>").write.parquet(str(tmp_path / "signals"))
    summary, signals = spark.read.parquet(str(tmp_path / "summary")), spark.read.parquet(str(tmp_path / "signals"))
    aligned = bam.read_bam(spark, str(tmp_path / "c.bam"), 300)
    folder = str(tmp_path / "run")
    with pytest.raises(Exception, match="can't be loaded"):
        R.check_tails_cdna(stages.Run(spark, folder), aligned, summary, signals, _counting(spark, broken=True)[0], key="m")
    run = stages.Run(spark, folder, "again")
    assert run.stages() == ["calls"]
    out = R.check_tails_cdna(run, bam.read_bam(spark, str(tmp_path / "c.bam"), 300), summary, signals, _counting(spark)[0], key="m")
    assert {(r.readname, r.comments, r.tail_type) for r in out["read_classes"].collect()} == {("a1", "YAY", "polyA"), ("t1", "MAU", "polyT")}
    assert [r.read_id for r in out["unidentified_reads"].collect()] == ["u1"] and [r.read_id for r in out["lost_reads"].collect()] == ["t1"]
    assert {r.tail_type: r.reads for r in out["statistics"].collect()} == {"polyA": 1, "polyT": 1, "unidentified": 1, "total": 3}
