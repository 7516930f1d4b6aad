"""Runs that go on where they ended: each stage's table is written once and listed in a manifest with what it was made of.

A stage is a folder of Parquet files under the run's folder and, once all is written, a manifest beside it.  A later run with the same inputs and parameters reads it; a
table without a manifest, left by a run that was killed, is made anew.  Outputs of several tables are published together.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from . import storage


def made_of(df: DataFrame) -> dict:
    """What a table is read from: its columns, and its files with their sizes and times.  A table without files is known by its columns and plan only."""
    files = df.inputFiles()
    own = {"columns": df.schema.simpleString(), "files": storage.described(df.sparkSession, files)}
    return own if files else {**own, "plan": df.semanticHash()}


class Run:
    """One run's folder with its stages and its log."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "", now: Callable[[], datetime] = datetime.now, say: Callable[[str, str], None] | None = None) -> None:
        """``say`` is called with each line of the log and its level."""
        self.spark, self.folder, self.now, self.say = spark, folder.rstrip("/"), now, say
        self.started = now()
        self.stamp = f"{self.started:%Y-%m-%d_%H-%M-%S}{'_' + prefix if prefix else ''}"
        self.lines: list[str] = []
        self.log(f"run {self.stamp}")

    def log(self, message: str, level: str = "INFO") -> None:
        """One line with its time; the log is a file of the run's folder, written whole each time."""
        for line in (x for x in message.splitlines() if x.strip()):
            self.lines.append(f"[{self.now():%Y-%m-%d %H:%M:%S}] {level}: {line}")
            if self.say is not None:
                self.say(line, level)
        storage.write_text(self.spark, f"{self.folder}/{self.stamp}.log", "\n".join(self.lines) + "\n")

    def stage(self, name: str, key: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made only where no table of this name and key is there yet."""
        known, manifest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest(), f"{self.folder}/{name}.json"
        if storage.exists(self.spark, manifest):
            found = json.loads(storage.read_text(self.spark, manifest))
            if found["key"] == known and storage.exists(self.spark, found["path"]):
                self.log(f"{name}: as before")
                return self.spark.read.parquet(found["path"])
            storage.remove(self.spark, found["path"])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        try:
            make().write.parquet(path)
        except Exception as e:
            self.log(f"{name}: {str(e).splitlines()[0][:300]}", "ERROR")
            storage.remove(self.spark, path)
            raise
        storage.write_text(self.spark, manifest, json.dumps({"key": known, "path": path, "made": str(self.now())}))
        self.log(f"{name}: written", "SUCCESS")
        return self.spark.read.parquet(path)

    def stages(self) -> list[str]:
        """Finished stages."""
        return [n.removesuffix(".json") for n in storage.names(self.spark, self.folder) if n.endswith(".json") and not n.endswith("_outputs.json")]

    def finish(self, tables: Mapping[str, DataFrame], clean: bool = False) -> dict[str, DataFrame]:
        """Publishes the tables together, logs how long the run took and, if asked, removes its stages; returns the published tables."""
        try:
            publish(self.spark, tables, self.folder, self.stamp)
        except Exception as e:
            self.log(f"outputs: {str(e).splitlines()[0][:300]}", "ERROR")
            raise
        out = published(self.spark, self.folder, self.stamp)
        if clean:
            self.log(f"{self.clean()} folders of stages removed")
        self.log(f"total runtime: {(self.now() - self.started).total_seconds() / 60:.2f} minutes", "SUCCESS")
        return out

    def clean(self) -> int:
        """Removes all stages, and tables that killed runs left; outputs and logs stay.  Returns how many folders went."""
        gone = 0
        for name in self.stages():
            found = json.loads(storage.read_text(self.spark, f"{self.folder}/{name}.json"))
            gone += storage.remove(self.spark, found["path"])
            storage.remove(self.spark, f"{self.folder}/{name}.json")
        left = [n for n in storage.names(self.spark, self.folder) if "." not in n and not n.endswith("_outputs") and len(n.rpartition("-")[2]) == 32]
        return gone + sum(storage.remove(self.spark, f"{self.folder}/{n}") for n in left)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, stamp: str) -> dict[str, str]:
    """Several tables, tab-separated, in one commit: they are written aside, moved together and listed in a manifest, the last thing written.  If one fails none is there."""
    target, manifest = f"{folder}/{stamp}_outputs", f"{folder}/{stamp}_outputs.json"
    if storage.exists(spark, manifest):
        raise FileExistsError(manifest)
    aside = f"{folder}/unpublished-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.option("sep", "\t").option("header", True).csv(f"{aside}/{name}.tsv")
        storage.remove(spark, target)  # of a run that was killed before its manifest
        storage.rename(spark, aside, target)
    except Exception:
        storage.remove(spark, aside)
        raise
    paths = {name: f"{target}/{name}.tsv" for name in tables}
    storage.write_text(spark, manifest, json.dumps({"tables": paths, "columns": {name: df.schema.json() for name, df in tables.items()}}))
    return paths


def published(spark: SparkSession, folder: str, stamp: str | None = None) -> dict[str, DataFrame]:
    """The tables of a published output, the latest by name unless one is named, with the columns they were written with."""
    from pyspark.sql.types import StructType

    found = [n for n in storage.names(spark, folder) if n.endswith("_outputs.json") and (stamp is None or n == f"{stamp}_outputs.json")]
    if not found:
        raise FileNotFoundError(f"no published tables in {folder}")
    known = json.loads(storage.read_text(spark, f"{folder}/{found[-1]}"))
    kinds = {name: StructType.fromJson(json.loads(text)) for name, text in known["columns"].items()}
    return {name: spark.read.schema(kinds[name]).option("sep", "\t").option("header", True).csv(path) for name, path in known["tables"].items()}
