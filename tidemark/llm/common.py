"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import checkpoint, written  # noqa: F401  used by the operators

#: Bytes of Arrow data of which Python objects are made at once; very long texts then come in small batches.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of at most ``limit`` bytes or one row, so that what a worker holds as Python
    objects depends neither on the length of texts nor on the session's batch size."""
    for batch in batches:
        left = [batch]
        while left:
            part = left.pop()
            if part.nbytes > limit and part.num_rows > 1:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(mod))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
