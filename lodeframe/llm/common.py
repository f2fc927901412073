"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as Spark and DuckDB patterns write it.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master, which has but one
    machine, gets a folder of its own; a cluster is refused."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/lodeframe-shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A table that `written` made, to be broadcast in a join if it has at most so many (short) rows; else it is
    shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(df: DataFrame) -> None:
    """Deletes a table that `written` made and that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null. Trimmed first, so that no split part is empty."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20, rows: int = 2_048) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work that holds several times a batch's size: about `size` bytes of the
    text or binary `column` each, but one row at least."""
    for b in batches:
        n = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, i = np.cumsum(n, dtype=np.int64), 0
        while i < b.num_rows:
            j = int(np.searchsorted(ends, ends[i] - n[i] + size, "right"))
            j = min(max(i + 1, j), i + rows, b.num_rows)
            yield b.slice(i, j - i)
            i = j
