"""Edit distances and orientation against plain dynamic programming, and cDNA runs from alignment records."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyquill.functions import matching as M
from polyquill.functions import scalar as S
from polyquill.operators import runs as R
from polyquill.sources import bam
from tests.test_bam import bgzf, header, record


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_distances_equal_dynamic_programming():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    for m in (1, 2, 7, 25, 46, 63, 64):
        query = word(m)
        texts = ["", query, *(word(r.randrange(0, 160)) for _ in range(12)), word(20) + query[: m - 1] + word(20), query + "A", word(m)]
        rows, size = M.as_rows([t.encode() for t in texts], 160)
        want = [edits(query, t) for t in texts]
        assert M.Query(query).whole(rows, size).tolist() == want
        near = [min([w, *(edits(query, t[i : i + m]) for i in range(len(t) - m + 1))]) if t else m for t, w in zip(texts, want)]
        assert M.Query(query).within(rows, size).tolist() == near
    with pytest.raises(ValueError):
        M.Query("A" * 65)


def reads(n=200):
    r = random.Random(9)
    word = lambda k, of="ACGT": "".join(r.choice(of) for _ in range(k))
    rc = M.reverse_complement
    out = [M.FRONT + "A" * 200 + rc(M.REAR), M.REAR + "T" * 200 + rc(M.FRONT), None, "", "ACGT" * 12, word(49), word(50)]
    for i in range(n):
        front, rear = list(M.FRONT), list(M.REAR)
        for x in (front, rear):
            for _ in range(r.randrange(0, 14)):
                x[r.randrange(len(x))] = word(r.randrange(3), "acgtN")
        front, rear = "".join(front).upper(), "".join(rear).upper()
        body = word(r.randrange(20, 300))
        out.append([word(8) + front + body + rc(rear), rear + body + rc(front) + word(9), word(300), front + body + front, body][i % 5])
    return out


def test_orientation_equals_the_column_form(spark):
    found = M.orientations(reads())
    assert found[:7] == ["A", "T", "unknown", "unknown", "unknown", "unknown", "unknown"] and {"A", "T", "unknown"} == set(found)
    df = spark.createDataFrame(list(enumerate(reads())), "id int, sequence string")
    plain = {r.id: r.o for r in df.select("id", S.orientation(F.col("sequence"), M.FRONT, M.REAR).alias("o")).collect()}
    assert plain == dict(enumerate(found))
    names = {"A": "polyA", "T": "polyT", "unknown": "unidentified"}
    typed = M.with_tail_type(df.withColumn("tail_type", F.lit("old")), most=7)
    assert {r.id: r.tail_type for r in typed.collect()} == {i: names[o] for i, o in enumerate(found)}
    with pytest.raises(ValueError, match="sequence"):
        M.with_tail_type(df.drop("sequence"))
    s = M.type_statistics(typed).first()
    n = len(found)
    assert (s.total_reads, s.polya_reads, s.polyt_reads, s.unidentified_reads) == (n, found.count("A"), found.count("T"), found.count("unknown"))
    assert s.polya_percentage == pytest.approx(round(100 * found.count("A") / n, 2))
    assert tuple(M.type_statistics(typed.where("false")).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_primers_of_both_layouts(spark):
    df = spark.createDataFrame([(M.FRONT + "A" * 200 + M.reverse_complement(M.REAR), "A"), (M.REAR + "T" * 200 + M.reverse_complement(M.FRONT), "T")], "s string, call string")
    got = df.select("call", S.oriented_primers(F.col("s"), F.col("call"), M.FRONT, M.REAR).alias("p")).collect()
    for r in got:
        assert r.p.top.distance == 0 and r.p.bottom.distance == 0 and r.p.top.position == 1
        assert r.p.top.matched == (M.FRONT if r.call == "A" else M.REAR)


def test_cdna_tables_from_alignment_records(spark, tmp_path):
    rc = M.reverse_complement
    tags = b"pti" + struct.pack("<i", 100) + b"paBi" + struct.pack("<i5i", 5, 1, 100, 2600, -1, -1)
    kinds = {"a1": M.FRONT + "A" * 120 + rc(M.REAR), "t1": M.REAR + "T" * 120 + rc(M.FRONT), "u1": "ACGT" * 60, "a2": M.FRONT + "A" * 90 + rc(M.REAR), "short": M.FRONT + "A" * 90 + rc(M.REAR)}
    made = [record(name, 0, 0, 5, 60, [(len(s), "M")], s, None, tags) for name, s in kinds.items()]
    made += [record("a1", 0, 0, 9, 60, [(60, "M")], "ACGT" * 15, None, tags), record("second", 256, 0, 9, 60, [(60, "M")], "ACGT" * 15, None, tags)]
    (tmp_path / "c.bam").write_bytes(bgzf(header(["one"]) + b"".join(made), [200]))
    summary = spark.createDataFrame([("f", name, 5 if name == "short" else 100, 100, 2600, "one", "+", 60) for name in (*kinds, "never")], "filename string, read_id string, poly_tail_length int, poly_tail_start int, poly_tail_end int, alignment_genome string, alignment_direction string, alignment_mapq int")
    r = np.random.default_rng(0)

    def raw(at):
        x = np.rint(r.normal(650, 6, 3000)).astype(int)
        x[at : at + 200] += 250
        return x.tolist()

    signals = spark.createDataFrame([("a1", raw(1200)), ("t1", raw(1300)), ("a2", raw(2450)), ("u1", raw(1000))], "read_id string, signal array<int>")
    classes, residues, rest, statistics = R.run_cdna_from_bam(bam.read_bam(spark, str(tmp_path), 400), summary, signals, lambda: lambda x: np.full(len(x), 2))
    got = {x.readname: (x["class"], x.comments, x.tail_type) for x in classes.collect()}
    assert got["a1"] == ("decorated", "YAY", "polyA") and got["t1"] == ("decorated", "YAY", "polyT") and got["short"] == ("unclassified", "IRL", "polyA")
    assert got["a2"][:2] in (("blank", "MPU"), ("decorated", "YAY"), ("blank", "MAU")) and set(got) == {"a1", "t1", "a2", "short"}
    assert {x.readname for x in residues.collect()} >= {"a1", "t1"} and {x.prediction for x in residues.collect()} == {"G"}
    assert {x.read_id for x in rest.collect()} == {"u1", "never"}
    s = statistics.first()
    assert (s.total_reads, s.polya_reads, s.polyt_reads, s.unidentified_reads) == (5, 3, 1, 1)
    merged = R.merged_statistics(classes.where("tail_type = 'polyA'"), classes.where("tail_type = 'polyT'"), rest, residues)
    table = {x.tail_type: (x.reads, x.percent) for x in merged.collect()}
    assert table == {"polyA": (3, 50.0), "polyT": (1, 16.67), "unidentified": (2, 33.33), "total": (6, 100.0)}
    assert {x.tail_type: x.reads for x in R.merged_statistics(None, None, rest).collect()} == {"polyA": 0, "polyT": 0, "unidentified": 2, "total": 2}


def test_a_doubtful_residue_makes_a_cdna_read_blank(spark):
    """Of a good residue and one at the end, the end counts; the good one stays in the residue table.  Without qc all count."""
    known = spark.createDataFrame([("f", x, n, 0, 1000, "c", "+", 60, "polyA") for x, n in (("both", 100), ("good", 100), ("end", 100), ("none", 100), ("short", 9), ("good", 100))], "filename string, read_id string, poly_tail_length int, poly_tail_start int, poly_tail_end int, alignment_genome string, alignment_direction string, alignment_mapq int, tail_type string")
    chunks = [("both_1", 50), ("both_2", 148), ("good_1", 50), ("end_1", 149), ("none_1", 50), ("short_1", 50)]
    spots = spark.createDataFrame([(c.split("_")[0], c, at, at + 99, 0 if c == "none_1" else 1) for c, at in chunks], "read_id string, chunkname string, chunk_start_pos int, chunk_end_pos int, prediction int")
    once = known.dropDuplicates(["read_id"])
    classes, residues = R.cdna_outputs(spots, spots, once, known)
    assert {r.readname: r.comments for r in classes.collect()} == {"both": "MPU", "good": "YAY", "end": "MPU", "none": "MAU", "short": "IRL"} and classes.count() == 5
    assert sorted((r.readname, r.est_nonA_pos) for r in residues.collect()) == [("both", 50.25), ("good", 50.25), ("short", 4.52)]
    free = R.cdna_outputs(spots, spots, once, known, qc=False)
    assert {r.readname: r.comments for r in free[0].collect()} == {"both": "YAY", "good": "YAY", "end": "YAY", "none": "MAU", "short": "IRL"}


def test_sequences_get_a_classified_sibling(spark, tmp_path):
    from polyquill.sources.readers import classified_path

    (tmp_path / "seq.tsv").write_text("read_id\tsequence\na\t" + M.FRONT + "A" * 100 + M.reverse_complement(M.REAR) + "\nb\tACGT\n")
    path = str(tmp_path / "seq.tsv")
    got = M.write_classified(spark, path, classified_path(path))
    assert {(r.read_id, r.tail_type) for r in got.collect()} == {("a", "polyA"), ("b", "unidentified")} and (tmp_path / "seq_classified.tsv").is_dir()


def test_a_users_function_per_group(spark):
    from polyquill.operators.tables import per_group

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "g string, n long")
    got = per_group(df, "g", lambda d: d.assign(n=d.n.sum()).head(1), "g string, n long")
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 5)}


def test_windows_of_texts_of_mixed_sizes():
    r = np.random.default_rng(11)
    texts = [bytes(r.choice(list(b"ACGTN"), n).tolist()) for n in [*r.integers(0, 151, 150), 0, 1, 24, 25, 26, 150]]
    for query in (M.FRONT, "A" * 64, "ACGT", M.REAR):
        least = [min([edits(query, t.decode()), *(edits(query, t[i : i + len(query)].decode()) for i in range(len(t) - len(query) + 1))]) if t else len(query) for t in texts[-14:]]
        assert M.Query(query).within(*M.as_rows(texts[-14:], 150)).tolist() == least
        assert M.Query(query).within(*M.as_rows(texts)).tolist()[-14:] == least


def test_reads_of_one_file_are_matched_by_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, "ACGT" * 30) for i in range(400)], "id int, sequence string").coalesce(1).write.parquet(str(tmp_path / "reads"))
    one = spark.read.parquet(str(tmp_path / "reads"))
    assert one.rdd.getNumPartitions() == 1
    busy = M.with_tail_type(one).groupBy(F.spark_partition_id()).count().count()
    assert busy >= spark.sparkContext.defaultParallelism
    assert M.with_tail_type(one).count() == 400
