"""A store of raw signals by read: Parquet in buckets of the read's id, each sorted by it.

Samples are dealt out once, when they are stored.  A join by read takes the buckets as they lie and moves only the other side; one read's signal comes from
one bucket's file and, as ids ascend there and row groups are small, from one row group.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as K
from ..operators.tables import require
from . import storage

#: Bytes of a row group: some hundreds of signals.
GROUP_BYTES = 16_000_000


def write_store(signals: DataFrame, path: str, buckets: int = 256, group_bytes: int = GROUP_BYTES, read: str = "read_id") -> None:
    """Stores read_id, signal and whatever else a table of signals has; a store is written once, other reads go to another."""
    require(signals, [read, "signal"])
    spark = signals.sparkSession
    if storage.exists(spark, f"{path}/store.json"):
        raise FileExistsError(path)
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = signals.repartition(buckets, read)
    dealt.write.format("parquet").option("path", f"{path}/signals").option("parquet.block.size", group_bytes).bucketBy(buckets, read).sortBy(read).saveAsTable(name)
    storage.write_text(spark, f"{path}/store.json", json.dumps({"buckets": buckets, "read": read, "schema": signals.schema.simpleString()}))


def _name(path: str) -> str:
    return f"signals_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored signals; Spark knows their buckets, also in a session that didn't write them."""
    known, name = json.loads(storage.read_text(spark, f"{path}/store.json")), _name(path)
    if not spark.catalog.tableExists(name):
        columns = known["schema"].removeprefix("struct<").removesuffix(">")
        parts, depth, now = [], 0, ""
        for c in columns + ",":  # commas inside a type don't end a column
            depth += (c == "<") - (c == ">") + (c == "(") - (c == ")")
            if c == "," and not depth:
                column, kind = now.split(":", 1)
                parts.append(f"`{column}` {kind}")
                now = ""
            else:
                now += c
        spark.sql(f"CREATE TABLE {name} ({', '.join(parts)}) USING parquet LOCATION '{path}/signals' CLUSTERED BY (`{known['read']}`) SORTED BY (`{known['read']}`) INTO {known['buckets']} BUCKETS")
    return spark.table(name)


def lookup(signals: DataFrame, read_id: str, read: str = "read_id") -> DataFrame:
    """One read's row: one bucket, and in it the row group whose ids enclose it."""
    return signals.where(F.col(read) == F.lit(read_id))


def full_signal(signals: DataFrame, read_id: str, winsorize: bool = True, read: str = "read_id") -> DataFrame:
    """One read's whole signal, clipped to its quantiles 0.2 % and 99.8 % if asked for, with what is needed to show it in picoampere and seconds."""
    signal = K.clipped(F.col("signal")) if winsorize else F.col("signal")
    extra = [c for c in ("calibration_offset", "calibration_scale", "sample_rate") if c in signals.columns]
    return lookup(signals, read_id, read).select(read, signal.alias("signal"), *extra)
