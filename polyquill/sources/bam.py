"""Alignment records of BAM files as a data source that splits files.

A BAM file is a row of compressed blocks (BGZF), and records run across them.  A partition is a range of a file's bytes: its records are those that
begin in a block which begins in the range.  A range finds its first block by its header, which must lead to another, and the first record by a chain of
``CHAIN`` records each of which must fit (or the file's end); it then reads on over the range's end until a record belongs to the next.  So ranges need to know
nothing of one another and files of any size are read by as many tasks as there are ranges.  ``border_mismatches`` compares where each range ends with where the
next begins.

Only the columns asked for are decoded (by a schema given to the reader, a subset of ``SCHEMA``); conditions on flag, mapq and pos, and the options
``require_flags`` and ``exclude_flags``, are tested before anything else of a record is.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import listed, opened

#: place: where a record begins (its block's place in the file, times 65536, and the place in the block), so places of a file ascend; pos and ref_end count from 1, ref_end is the last aligned base.
SCHEMA = "read_id string, flag int, reference string, pos int, mapq int, cigar string, sequence string, pt int, pa array<int>, ref_end int, quality string, file string, place long"
SPLIT_BYTES, CHAIN, ROWS = 64_000_000, 10, 5_000
# Fixed values of the format: bases by code, operations by code and those that move along the reference, sizes and codes of tag values.
_BASES, _OPS, _ON_REFERENCE = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", (0, 2, 3, 7, 8)
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "A": "c"}
_PAIRS = np.array([[ord(_BASES[b >> 4]), ord(_BASES[b & 15])] for b in range(256)], np.uint8)
_HEAD = b"\x1f\x8b\x08\x04"
_MOST_BLOCK, _AHEAD = 65536, 1 << 20


def _block_size(head: bytes) -> int | None:
    """Bytes of the block whose header this is; None if it is none."""
    if len(head) < 18 or head[:4] != _HEAD:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    end = at + extra
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class _Stream:
    """Inflated bytes from a block on, with the blocks that they come from.  A gzip file without block sizes is one stream from its beginning."""

    def __init__(self, file, at: int, size: int) -> None:
        self.file, self.next, self.size = file, at, size
        self.buf, self.base = bytearray(), 0
        self.starts, self.blocks = [], []
        self.plain = None
        self.read, self.read_from = b"", 0  # what was read ahead

    def _ahead(self, at: int, n: int) -> bytes:
        """n bytes of the file, or as many as there are; some blocks are read at once."""
        if not self.read_from <= at <= at + n <= self.read_from + len(self.read):
            self.read, self.read_from = self.file.read_at(min(self.size - at, max(n, _AHEAD)), at), at
        return self.read[at - self.read_from : at - self.read_from + n]

    def more(self) -> bool:
        if self.next >= self.size:
            return False
        head = self._ahead(self.next, min(self.size - self.next, 512))
        block = _block_size(head) if self.plain is None else None
        if block is None:
            return self._more_plain()
        raw = self._ahead(self.next, block)
        if len(raw) < block:
            raise ValueError("the file ends within a block")
        body = 12 + struct.unpack_from("<H", raw, 10)[0]
        self.starts.append(self.base + len(self.buf))
        self.blocks.append(self.next)
        self.buf += zlib.decompress(raw[body:-8], -15)
        self.next += block
        return True

    def _more_plain(self) -> bool:
        if self.plain is None:
            if self.next:
                raise ValueError("not a block of a BAM file")
            self.starts, self.blocks, self.plain = [0], [0], zlib.decompressobj(31)
        raw = self.file.read_at(min(1 << 20, self.size - self.next), self.next)
        self.next += len(raw)
        while raw:
            self.buf += self.plain.decompress(raw)
            raw = self.plain.unused_data
            if self.plain.eof:
                self.plain = zlib.decompressobj(31)
            else:
                break
        return True

    def upto(self, end: int) -> bool:
        """Whether there are bytes up to a place of the stream."""
        while self.base + len(self.buf) < end:
            if not self.more():
                return False
        return True

    def place(self, at: int) -> tuple[int, int]:
        """The block that a byte lies in, and where."""
        i = bisect_right(self.starts, at) - 1
        return self.blocks[i], at - self.starts[i]

    def take(self, at: int, n: int) -> bytes:
        if not self.upto(at + n):
            raise ValueError("the file ends within a record")
        return bytes(self.buf[at - self.base : at - self.base + n])

    def forget(self, before: int) -> None:
        """Bytes before a place are needed no more."""
        del self.buf[: before - self.base]
        self.base = before
        keep = max(bisect_right(self.starts, before) - 1, 0)
        del self.starts[:keep], self.blocks[:keep]


def _header(s: _Stream) -> tuple[list[str], int]:
    """Names of the references, and where the first record begins."""
    if s.take(0, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack("<i", s.take(4, 4))[0]
    n = struct.unpack("<i", s.take(at, 4))[0]
    at += 4
    names = []
    for _ in range(n):
        size = struct.unpack("<i", s.take(at, 4))[0]
        names.append(s.take(at + 4, size)[:-1].decode())
        at += 8 + size
    return names, at


def _first_block(file, start: int, size: int) -> int:
    """The first block from a place on: a header that leads to another header or the end."""
    at, window = start, b""
    while at < size:
        window = file.read_at(min(2 * _MOST_BLOCK + 1024, size - at), at)
        found = window.find(_HEAD)
        while 0 <= found < _MOST_BLOCK + 1:
            block = _block_size(window[found : found + 512])
            if block:
                after = at + found + block
                if after == size or (after < size and _block_size(file.read_at(min(512, size - after), after))):
                    return at + found
            found = window.find(_HEAD, found + 1)
        at += _MOST_BLOCK
    return size


def _fits(s: _Stream, at: int, references: int) -> int:
    """Where the record that would begin here ends; -1 if none can."""
    raw = bytes(s.buf[at - s.base : at - s.base + 36]) if s.upto(at + 36) else b""
    if len(raw) < 36:
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack("<iiiBBHHHiiii", raw)
    needed = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0 and needed <= size < 1 << 29):
        return -1
    if not s.upto(at + 36 + l_name):
        return -1
    name = s.take(at + 36, l_name)
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return -1
    return at + 4 + size


def _first_record(s: _Stream, end: int, references: int) -> int | None:
    """The first place of the stream from which a chain of records runs, in blocks before ``end`` (bytes of the file)."""
    at = s.base
    while s.upto(at + 1) and s.place(at)[0] < end:
        window = np.frombuffer(bytes(s.buf[at - s.base :]), np.uint8)
        n = len(window) - 36
        if n <= 0:
            if not s.more():
                return at if _chained(s, at, references) else None
            continue
        number = lambda o: np.lib.stride_tricks.as_strided(window[o : o + 4].view("<i4"), (n,), (1,))
        ref, pos, size = number(4), number(8), number(0)
        maybe = np.flatnonzero((ref >= -1) & (ref < references) & (pos >= -1) & (size >= 33) & (size < 1 << 29) & (number(24) >= -1) & (number(24) < references) & (window[12 : 12 + n] > 0))
        for i in maybe.tolist():
            if s.place(at + i)[0] >= end:
                return None
            if _chained(s, at + i, references):
                return at + i
        at += n
        s.forget(at)
    return None


def _chained(s: _Stream, at: int, references: int) -> bool:
    for _ in range(CHAIN):
        if not s.upto(at + 1):
            return True  # exactly at the end
        at = _fits(s, at, references)
        if at < 0:
            return False
    return s.upto(at)


class _Range:
    """The records of one range of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end
        self.first = self.next = None  # places (block, byte) of the first record of this range, and of the first after it

    def records(self) -> Iterator[tuple[_Stream, list[int]]]:
        """The stream and where up to ``ROWS`` records begin in it, again and again."""
        file = opened(self.path)
        size = file.size()
        head = _Stream(file, 0, size)
        self.references, at = _header(head)
        if not head.upto(at + 1):  # no records
            return
        began = head.place(at)[0]  # the block that has the first record's first byte
        if head.plain is not None:
            if self.start:
                return
            s, end = head, 1 << 62
        elif began >= self.start:
            if began >= self.end:
                return
            s, end = head, self.end
        else:
            block = _first_block(file, self.start, size)
            if block >= self.end:
                return
            s, end = _Stream(file, block, size), self.end
            at = _first_record(s, end, len(self.references))
            if at is None:
                return
        self.first = s.place(at)
        found = []
        while s.upto(at + 4) and s.place(at)[0] < end:
            length = struct.unpack("<i", s.take(at, 4))[0]
            if not s.upto(at + 4 + length):
                raise ValueError(f"{self.path} ends within a record")
            found.append(at)
            at += 4 + length
            if len(found) == ROWS or at - s.base > 32_000_000:
                yield s, found
                s.forget(at)
                found = []
        if found:
            yield s, found
        self.next = s.place(at) if s.upto(at + 1) else (size, 0)


def _tags(raw: bytes, wanted: set[str]) -> dict:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            if name in wanted:
                out[name] = list(struct.unpack_from(f"<{n}{_CODES[sub]}", raw, at + 5))
            at += 5 + n * _SIZES[sub]
        else:
            if name in wanted:
                out[name] = struct.unpack_from(f"<{_CODES[kind]}", raw, at)[0]
            at += _SIZES[kind]
    return out


def _as_int(value) -> int | None:
    return value if isinstance(value, int) else None


def _decoded(s: _Stream, at: int, wanted: list[str], references: list[str], path: str) -> list:
    """The wanted values of one record."""
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", s.buf, at - s.base)
    raw = bytes(s.buf[at - s.base + 36 : at - s.base + 4 + size])
    ops = struct.unpack_from(f"<{n_cigar}I", raw, l_name)
    seq_at = l_name + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    tags = _tags(raw[qual_at + l_seq :], {"pt", "pa"}) if "pt" in wanted or "pa" in wanted else {}
    out = []
    for c in wanted:
        match c:
            case "read_id":
                out.append(raw[: l_name - 1].decode())
            case "flag":
                out.append(flag)
            case "reference":
                out.append(references[ref] if ref >= 0 else "*")
            case "pos":
                out.append(pos + 1)
            case "mapq":
                out.append(mapq)
            case "cigar":
                out.append("".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*")
            case "ref_end":
                out.append(pos + sum(o >> 4 for o in ops if o & 15 in _ON_REFERENCE) if pos >= 0 and ops else None)
            case "sequence":
                out.append(_PAIRS[np.frombuffer(raw, np.uint8, qual_at - seq_at, seq_at)].ravel()[:l_seq].tobytes().decode() or "*")
            case "quality":
                q = np.frombuffer(raw, np.uint8, l_seq, qual_at)
                out.append((q + 33).tobytes().decode() if l_seq and q[0] != 255 else None)
            case "pt":
                out.append(_as_int(tags.get("pt")))
            case "pa":
                out.append(tags["pa"] if isinstance(tags.get("pa"), list) else None)
            case "file":
                out.append(path)
            case "place":
                block, within = s.place(at)
                out.append(block * 65536 + within)
    return out


class _Part(D.InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class BamReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.require, self.exclude = (int(options.get(k, 0)) for k in ("require_flags", "exclude_flags"))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        kinds = {D.EqualTo: "==", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.In: "in"}
        for f in filters:
            known = getattr(f, "attribute", [None])[0] in ("flag", "mapq", "pos")
            if known and type(f) in kinds:
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            elif not (known and isinstance(f, D.IsNotNull)):  # these columns never are null
                yield f

    def partitions(self):
        return [_Part(path, at, min(at + self.split, size)) for path, size in listed(self.path, [".bam"]) for at in range(0, size, self.split)]

    def _kept(self, s: _Stream, found: list[int]) -> list[int]:
        raw = np.frombuffer(bytes(s.buf), np.uint8)
        at = np.array(found) - s.base
        short = lambda o: raw[at + o].astype(np.int64) | raw[at + o + 1].astype(np.int64) << 8
        value = {"flag": short(18), "mapq": raw[at + 13].astype(np.int64), "pos": ((short(8) | short(10) << 16) + 2**31) % 2**32 - 2**31 + 1}
        good = ((value["flag"] & self.require) == self.require) & ((value["flag"] & self.exclude) == 0)
        for name, how, to in self.tests:
            v = value[name]
            good &= np.isin(v, list(to)) if how == "in" else {"==": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[how](v, to)
        return [found[i] for i in np.flatnonzero(good)]

    def read(self, partition: _Part):
        own, arrow = _Range(partition.path, partition.start, partition.end), to_arrow_schema(self.schema)
        for s, found in own.records():
            rows = [_decoded(s, at, self.schema.names, own.references, partition.path) for at in self._kept(s, found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


class BamSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(schema, self.options)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, columns: list[str] | None = None, require_flags: int = 0, exclude_flags: int = 0) -> DataFrame:
    """Records of a file, or of all .bam files of a folder, by ranges of so many bytes; with columns only those are decoded.  Filters on flag, mapq and pos reach the source."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("bam").option("split_bytes", split_bytes).option("require_flags", require_flags).option("exclude_flags", exclude_flags)
    if columns is not None:
        kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def border_mismatches(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, range, next_range): ranges whose last record doesn't end where the next range's first begins; none, if all borders were found."""
    parts = [(p, i, at, min(at + split_bytes, size)) for p, size in listed(path, [".bam"]) for i, at in enumerate(range(0, size, split_bytes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, i, start, end in zip(*(c.to_pylist() for c in b.columns)):
                own = _Range(file, start, end)
                for _ in own.records():
                    pass
                join = lambda p: None if p is None else f"{p[0]}:{p[1]}"
                yield pa.RecordBatch.from_pydict({"file": [file], "range": pa.array([i], pa.int32()), "first": pa.array([join(own.first)], pa.string()), "next": pa.array([join(own.next)], pa.string())})

    ranges = spark.createDataFrame(parts, "file string, range int, start long, end long").repartition(len(parts) or 1, "file", "range")
    found = ranges.mapInArrow(run, "file string, range int, first string, next string").where("first is not null")
    after = Window.partitionBy("file").orderBy("range")  # one row a range
    return found.withColumns({"next_range": F.lead("range").over(after), "begins": F.lead("first").over(after)}).where("begins is not null and begins <> next").select("file", "range", "next_range")


def tailed_reads(aligned: DataFrame, summary: DataFrame, check: bool = True) -> DataFrame:
    """Mapped primary records with a tail call whose file is in the summary; the first in the file of each read.  Raises if no record has the tag pa (``check``: a first look at the records)."""
    if check and not aligned.where("pa is not null").take(1):
        raise ValueError("no record has the tag pa: the basecaller must be told to estimate tails")
    good = aligned.where("pt is not null and (flag & 4) = 0 and (flag & 2304) = 0 and reference <> '*'")
    files = summary.select("read_id", "filename").dropDuplicates(["read_id"])
    rest = [c for c in good.columns if c != "read_id"]
    first = [c for c in ("file", "place", "pos", "flag", "sequence") if c in rest]
    one = good.groupBy("read_id").agg(F.min_by(F.struct(*rest), F.struct(*first)).alias("r")).select("read_id", "r.*")
    return one.join(files, "read_id")


def with_tail_columns(reads: DataFrame, end_by_cigar_text: bool = False) -> DataFrame:
    """The twelve columns of tailed reads: their place on the reference, and the five numbers of pa after the first, -1 where the tag is missing or isn't five numbers.

    ``end_by_cigar_text`` adds the length of the CIGAR's text to the start, as older tables have it, in place of the last aligned base."""
    whole = F.coalesce((F.size("pa") == 5) & ~F.exists("pa", lambda x: x.isNull()), F.lit(False))
    tail = {name: F.when(whole, F.col("pa")[i]).otherwise(-1) for i, name in enumerate(("poly_tail_start", "polya_end", "poly_tail2_start", "poly_tail2_end"), 1)}
    end = F.col("pos") + F.length("cigar") if end_by_cigar_text else F.col("ref_end")
    return reads.select("read_id", F.col("filename").alias("pod5_file"), "reference", F.col("pos").alias("ref_start"), end.alias("ref_end"), "mapq", F.col("pt").alias("poly_tail_length"), *(c.alias(n) for n, c in tail.items()), "sequence")


def split_by_reads(aligned: DataFrame, part: DataFrame) -> DataFrame:
    """The records whose read is in a part of the summary."""
    return aligned.join(part.select("read_id").distinct(), "read_id", "left_semi")
