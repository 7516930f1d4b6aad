"""Raw signals.  Parquet is the form to keep them in: read_id, signal array<int>, and what a reader adds.  POD5 and FAST5 files are
decoded by their own libraries (``pod5``, ``h5py``), which must be installed on the executors; without them the readers raise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POD5 = "read_id string, signal array<int>, calibration_offset double, calibration_scale double, sample_rate int, filename string"
FAST5 = "readname string, signal array<int>, moves array<int>, stride int, fast5_filename string"


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals by the path's suffix: Parquet, *.pod5 or *.fast5 (or a folder, read as Parquet)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return read_pod5(spark, path) if kind == "pod5" else read_fast5(spark, path) if kind == "fast5" else spark.read.parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "content")


def read_pod5(spark: SparkSession, path: str) -> DataFrame:
    try:
        import pod5  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading POD5 needs the library pod5; or give signals as Parquet") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tempfile

        import pod5

        for b in batches:
            for name, data in zip(b["filename"], b["content"]):
                with tempfile.NamedTemporaryFile(suffix=".pod5") as f:  # the library reads local files; the copy is this task's own
                    f.write(bytes(data))
                    f.flush()
                    with pod5.Reader(f.name) as reader:
                        for r in reader.reads():
                            row = (str(r.read_id), r.signal.astype("int32"), r.calibration.offset, r.calibration.scale, r.run_info.sample_rate, name)
                            yield pd.DataFrame([row], columns=[c.split()[0] for c in POD5.split(", ")])

    return _files(spark, path).mapInPandas(run, POD5)


def fast5_problem(names: list[str], basecall_group: str, experiment: str | None) -> str | None:
    """Why a file can't be used, by the names in its first read and its kind of experiment; None if it can."""
    if not names or not all(n.startswith("read_") for n in names):
        return "files must hold several reads each"
    if experiment is not None and experiment != "rna":
        return "reads must be of RNA"
    return None if basecall_group else "the group of the basecaller must be named"


def read_fast5(spark: SparkSession, path: str, basecall_group: str = "Basecall_1D_000") -> DataFrame:
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading FAST5 needs the library h5py; or give signals as Parquet") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import h5py

        for b in batches:
            for name, data in zip(b["filename"], b["content"]):
                with h5py.File(io.BytesIO(bytes(data)), "r") as f:
                    tags = f[next(iter(f))].get("context_tags") if len(f) else None
                    kind = None if tags is None else tags.attrs.get("experiment_type")
                    problem = fast5_problem(list(f), basecall_group, kind.decode() if isinstance(kind, bytes) else kind)
                    if problem:
                        raise ValueError(f"{name}: {problem}")
                    for key in f:
                        group = f[key]["Analyses"][basecall_group]
                        stride = int(group["Summary"]["basecall_1d_template"].attrs["block_stride"])
                        row = (key.removeprefix("read_"), f[key]["Raw"]["Signal"][:].astype("int32"), group["BaseCalled_template"]["Move"][:].astype("int32"), stride, name)
                        yield pd.DataFrame([row], columns=[c.split()[0] for c in FAST5.split(", ")])

    return _files(spark, path).mapInPandas(run, FAST5)


def file_of(files: DataFrame, filename: str) -> DataFrame:
    """The first file, by name, that has the wanted name in its own; of none, the first file."""
    return files.orderBy(~F.contains(F.col("filename"), F.lit(filename)), "filename").limit(1)


def one_signal(signals: DataFrame, read_id: str) -> DataFrame:
    """One read's samples with their place and time; the filter reaches the Parquet scan."""
    d = signals.where(F.col("read_id") == read_id)
    return d.select("*", F.posexplode("signal").alias("position", "sample")).drop("signal")
