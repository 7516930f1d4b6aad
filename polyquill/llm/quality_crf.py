"""Document quality from line marginals of a conditional random field.

The score of a text is the mean of P(good line), by forward-backward, weighted with the lines' bytes.
Defined results: a text without words (null, empty or blank) scores the share of good texts among those learned from;
a table without labels of both kinds scores every text with lines by the untrained chain; a row with a null doc_id isn't held out;
repeated rows score alike, and equal scores are equally predicted (0.7 itself is 1); texts of any length are scored whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linecrf import Crf, features, read_lines, train
from .shared import shipped
from .textkit import Hasher, slices


def scores(docs: DataFrame, crf: Crf, threshold: float = 0.7) -> DataFrame:
    """doc_id, n_lines, score, predicted for every row of docs (doc_id, text)."""
    model = shipped(docs.sparkSession, crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, crf = Hasher(), model()
        for whole in batches:
            for batch in slices(whole):
                x = read_lines(batch.column("text"), hasher)
                p, _, _ = crf.marginals(crf.emissions(features(x)), x.first)
                size = (x.end - x.begin).astype(float)
                n = batch.num_rows
                total = np.bincount(x.doc, size, n)
                good = np.bincount(x.doc, size * p[:, 1], n)
                score = np.clip(np.where(total > 0, good / np.maximum(total, 1), crf.prior), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(x.first), pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "n_lines", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_lines long, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that learned from those not held out (crc32 of the id modulo 4 is not 2)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    crf = train(docs, labels.where(~held), "quality")
    return scores(docs, crf).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted", "n_lines")
