"""Delimited tables with their types, validators, parts and training sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyquill.operators import post as P
from polyquill.operators import runs as R
from polyquill.operators import tables as T
from polyquill.sources import readers

CLASSES = "readname\tcontig\tpolya_length\tqc_tag\tclass\tcomments\nr1\tENST1.2|a|b|c|d|NAME|x\t63\t60\tmodified\tYAY\nr2\tplain\tNA\tNA\tblank\tMAU\n"
RESIDUES = "readname\tcontig\tprediction\test_nonA_pos\tpolya_length\tqc_tag\nr1\tENST1.2|a|b|c|d|NAME|x\tC\t30.5\t63\tPASS\nr1\tplain\tG\t12\t63\tSUFFCLIP\n"


@pytest.fixture
def paths(tmp_path):
    out = {}
    for name, text in (("classes", CLASSES), ("residues", RESIDUES), ("wrong", RESIDUES.replace("30.5", "thirty")), ("commas", "a,est_nonA_pos\nx,1\n")):
        out[name] = str(tmp_path / f"{name}.{'csv' if name == 'commas' else 'tsv'}")
        (tmp_path / out[name].rsplit("/", 1)[1]).write_text(text)
    return out


def test_types_go_by_name(spark, paths):
    d = readers.table(spark, paths["classes"])
    assert dict(d.dtypes) == {"readname": "string", "contig": "string", "polya_length": "double", "qc_tag": "int", "class": "string", "comments": "string"}
    assert [(r.polya_length, r.qc_tag) for r in d.orderBy("readname").collect()] == [(63.0, 60), (None, None)]
    r = readers.table(spark, paths["residues"])
    assert dict(r.dtypes)["qc_tag"] == "string" and dict(r.dtypes)["est_nonA_pos"] == "double"
    assert dict(readers.table(spark, paths["commas"], {"a": "string", "est_nonA_pos": "int"}).dtypes) == {"a": "string", "est_nonA_pos": "int"}
    with pytest.raises(Exception, match="(?i)malformed|thirty"):
        readers.table(spark, paths["wrong"]).collect()


def test_residues_of_one_and_of_more_samples(spark, paths):
    one = readers.read_residues(spark, paths["residues"], "s1")
    assert [(r.prediction, r.transcript, r.ensembl_transcript_id_short, r.sample_name) for r in one.orderBy("est_nonA_pos").collect()] == [("G", "plain", "plain", "s1"), ("C", "NAME", "ENST1", "s1")]
    both = readers.read_samples(spark, [{"sample_name": "a", "group": "x", "residue_path": paths["residues"]}, {"sample_name": "b", "group": "y", "residue_path": paths["residues"]}], readers.read_residues, "residue_path")
    assert {(r.sample_name, r.group, r.n) for r in both.groupBy("sample_name", "group").agg(F.count("*").alias("n")).collect()} == {("a", "x", 2), ("b", "y", 2)}
    with pytest.raises(ValueError, match="prediction"):
        readers.read_residues(spark, paths["classes"])
    assert P.one_read(both, "r1").count() == 4
    with pytest.raises(ValueError, match="prediction"):
        P.one_read(both.drop("prediction"), "r1")


def test_validators(spark):
    d = spark.createDataFrame([("a", 1, None), ("b", 2, 3.0), ("c", 3, 1.0)], "g string, n int, x double")
    assert T.validated(d, numbers=["n", "x"], texts=["g"], not_empty=True, not_null=["n"]) is d
    with pytest.raises(ValueError, match="g must be a number, not string; n must be text, not integer; x has nulls"):
        T.validated(d, numbers=["g"], texts=["n"], not_null=["x"])
    with pytest.raises(ValueError, match="empty"):
        T.validated(d.where("false"), not_empty=True)
    with pytest.raises(ValueError, match="missing columns: y"):
        T.validated(d, numbers=["y"])
    with pytest.raises(ValueError, match="two levels, not more"):
        T.two_levels(d, "g")
    with pytest.raises(ValueError, match="two levels, not 1"):
        T.two_levels(d.where("n = 1"), "g")
    assert T.two_levels(d.where("n > 1"), "g") == ("b", "c")
    merged = spark.createDataFrame([(f"t{i % 4}", "WT" if i // 4 % 2 else "KO", i % 3, i % 5 % 2) for i in range(200)], "transcript string, group string, prediction_C int, prediction_G int")
    found, named = P.residue_tests(merged, "transcript", "group"), P.residue_tests(merged, "transcript", "group", ("KO", "WT"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, named.collect()))
    ordered = [r.padj for r in P.ordered_tests(found).collect()]
    assert ordered == sorted(ordered)
    with pytest.raises(ValueError, match="different"):
        P.residue_tests(merged, "transcript", "group", ("WT", "WT"))
    with pytest.raises(ValueError, match="number"):
        P.residue_tests(merged.withColumn("prediction_C", F.lit("x")), "transcript", "group")


def test_parts_have_at_most_so_many_rows(spark, tmp_path):
    readers.write_parts(spark.range(95).select(F.col("id").cast("string").alias("readname")).repartition(2), str(tmp_path / "parts"), 20)
    sizes = [len(f.read_text().splitlines()) - 1 for f in (tmp_path / "parts").glob("*.csv")]
    assert sum(sizes) == 95 and max(sizes) == 20


def test_training_sets_of_each_base(spark):
    """Raised stretches give G, lowered ones C and U, and flat tails A."""
    r = np.random.default_rng(3)
    tails = []
    for i in range(12):
        x = np.rint(r.normal(650, 6, 400)).astype(int)
        if i % 3:
            x[200:212] += 300 if i % 3 == 1 else -300
        else:
            x = np.tile([640, 650, 660], 134)[:400]
        tails.append((f"r{i}", x.tolist()))
    df = spark.createDataFrame(tails, "read_id string, tail_signal array<long>")
    got = {b: {x.read_id for x in R.training_chunks(df, b).collect()} for b in "ACGU"}
    assert got["G"] == {f"r{i}" for i in range(12) if i % 3 == 1} and got["C"] == got["U"] == {f"r{i}" for i in range(12) if i % 3 == 2}
    assert {f"r{i}" for i in range(0, 12, 3)} <= got["A"] and not got["A"] & (got["G"] | got["C"])
    assert all(len(x.chunk_sequence) == 100 for b in "ACGU" for x in R.training_chunks(df, b).collect())
