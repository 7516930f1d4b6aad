"""Ranges of BAM files against a serial reading."""

import random
import struct
import zlib

import pytest

from polyquill.sources import bam

CODE = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


def record(name, flag, ref, pos, mapq, ops, seq, quality, tags):
    cigar = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
    s = [CODE[c] for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + cigar
    body += bytes(a << 4 | b for a, b in zip(s[::2], s[1::2])) + (bytes(ord(c) - 33 for c in quality) if quality else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def bgzf(data, sizes):
    """Blocks of the given sizes in turn, and an empty one at the end."""
    out, at, i = b"", 0, 0
    while at < len(data) or i == 0 or sizes is None:
        n = sizes[i % len(sizes)]
        out += block(data[at : at + n])
        at, i = at + n, i + 1
    return out + block(b"")


def block(part):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(part) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def header(refs):
    text = b"@HD\tVN:1.6\n"
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 10**6) for r in refs)


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 30, 200, 3000 if i % 50 == 0 else 90])))
        quality = "".join(chr(r.randrange(33, 90)) for _ in seq) if i % 3 and seq else None
        ops = [(len(seq), "M")] if i % 2 else [(5, "S"), (max(len(seq) - 5, 1), "M"), (7, "D"), (3, "I")]
        tags = b"xsZ" + bytes(r.randrange(33, 90) for _ in range(r.randrange(40))) + b"\0" if i % 4 == 0 else b""
        pt = r.randrange(200) if i % 5 else None
        pa = [1, r.randrange(1000), r.randrange(1000, 2000), -1, -1] if i % 3 == 0 else None
        tags += (b"pti" + struct.pack("<i", pt) if pt is not None else b"") + (b"paBi" + struct.pack("<i5i", 5, *pa) if pa else b"")
        ref = r.choice([0, 1, -1])
        out.append(((f"read-{i % 300}", r.choice([0, 4, 16, 256, 2048]), ref, r.randrange(1, 10**5) if ref >= 0 else 0, r.randrange(61), ops, seq, quality), tags, pt, pa))
    return out


def expected(made):
    out = []
    for (name, flag, ref, pos, mapq, ops, seq, quality), _, pt, pa in made:
        end = pos - 1 + sum(n for n, o in ops if o in "MDN=X") if pos >= 1 else None
        out.append((name, flag, ["one", "two"][ref] if ref >= 0 else "*", pos, mapq, "".join(f"{n}{o}" for n, o in ops), seq or "*", pt, pa, end, quality))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:11] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    first, second = rows(900, 1), rows(40, 2)
    (folder / "a.bam").write_bytes(bgzf(header(["one", "two"]) + b"".join(record(*m, tags) for m, tags, _, _ in first), [1000, 37, 4096, 65000, 512]))
    (folder / "b.bam").write_bytes(bgzf(header(["one", "two"]) + b"".join(record(*m, tags) for m, tags, _, _ in second), [60000]))
    (folder / "notes.txt").write_text("no records here")
    return folder, first, second


@pytest.mark.parametrize("split", [300, 1777, 20_000, 10**9])
def test_every_split_size_gives_the_serial_rows(spark, files, split):
    folder, first, second = files
    df = bam.read_bam(spark, str(folder), split)
    assert df.rdd.getNumPartitions() == sum(-(-(folder / f).stat().st_size // split) for f in ("a.bam", "b.bam"))
    assert got(df) == expected(first + second)
    assert bam.border_mismatches(spark, str(folder), split).count() == 0


def test_blocks_smaller_than_records_and_empty_files(spark, tmp_path):
    made = rows(30, 5)
    data = header(["one", "two"]) + b"".join(record(*m, tags) for m, tags, _, _ in made)
    (tmp_path / "s.bam").write_bytes(bgzf(data, [64]))
    (tmp_path / "e.bam").write_bytes(bgzf(header(["one", "two"]), [64]))
    for split in (100, 5000):
        assert got(bam.read_bam(spark, str(tmp_path), split)) == expected(made)
    (tmp_path / "cut.bam").write_bytes(bgzf(data, [64])[:-2000])
    with pytest.raises(Exception, match="ends within"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()
    (tmp_path / "no.bam").write_bytes(bgzf(b"something else entirely", [64]))
    with pytest.raises(Exception, match="not a BAM"):
        bam.read_bam(spark, str(tmp_path / "no.bam")).collect()


def test_filters_and_columns_reach_the_source(spark, files):
    folder, first, second = files
    df = bam.read_bam(spark, str(folder / "a.bam"), 5000, columns=["read_id", "mapq", "flag"]).where("mapq >= 30 and flag in (0, 16) and read_id <> 'read-1'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if line.lstrip(" *(0123456789)+-").startswith("Filter")]
    assert left and not any("mapq" in line or "flag" in line for line in left)
    want = sorted((m[0], m[4], m[1]) for m, *_ in first if m[4] >= 30 and m[1] in (0, 16) and m[0] != "read-1")
    assert sorted(map(tuple, df.collect())) == want
    primary = bam.read_bam(spark, str(folder), 5000, columns=["flag"], exclude_flags=4 | 256 | 2048)
    assert {r.flag for r in primary.collect()} == {0, 16}
    needed = bam.read_bam(spark, str(folder), 5000, columns=["flag"], require_flags=16)
    assert {r.flag for r in needed.collect()} == {16}


def test_first_of_each_read_and_tail_columns(spark, files):
    folder, first, _ = files
    summary = spark.createDataFrame([(f"read-{i}", f"f{i % 3}.pod5") for i in range(200)], "read_id string, filename string")
    reads = bam.tailed_reads(bam.read_bam(spark, str(folder / "a.bam"), 3000), summary)
    want = {}
    for (name, flag, ref, pos, mapq, ops, seq, _), _, pt, pa in first:
        if pt is not None and not flag & (4 | 256 | 2048) and ref >= 0 and int(name[5:]) < 200 and name not in want:
            want[name] = (["one", "two"][ref], pos, mapq, pt, *(pa[1:] if pa else [-1] * 4), seq or "*")
    table = bam.with_tail_columns(reads)
    assert len(table.columns) == 12
    assert {r.read_id: (r.reference, r.ref_start, r.mapq, r.poly_tail_length, r.poly_tail_start, r.polya_end, r.poly_tail2_start, r.poly_tail2_end, r.sequence) for r in table.collect()} == want
    older = {r.read_id: r.ref_end - r.ref_start for r in bam.with_tail_columns(reads, end_by_cigar_text=True).collect()}
    assert older == {r.read_id: len(r.cigar) for r in reads.collect()}
