"""Shared pieces of the training-data operators: scratch tables, readers, text conventions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import cut, scratch_dir  # noqa: F401

#: The separators of every contract: space and 0x09-0x0D.
WS = " \t\n\x0b\f\r"
WS_BYTES = WS.encode()
#: The same class for Java regular expressions.
WS_RUN = "[ \\t-\\r]+"
#: Rows of a Python batch: a batch of long texts then stays in the tens of MB.
BATCH_ROWS = 512


def python_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, col: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(df[col], F.lit(""))


def ascii_lower_bytes(text: str) -> bytes:
    """UTF-8 with only A-Z lower-cased (bytes.lower leaves other bytes alone)."""
    return text.encode("utf-8", "surrogatepass").lower()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (as bytes.split() finds them) with A-Z
    lower-cased. Words are hashed each time: that is faster than looking them up, and holds nothing."""
    words = ascii_lower_bytes(text).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
