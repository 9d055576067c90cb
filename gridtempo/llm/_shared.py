"""What the operators of this subpackage share: the checkpoint folder, row keys and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and separator pattern of all text contracts: everything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WINDOW_BYTES = 4 << 20
#: For the steps of the pipeline, whose Python workers all stay beside a full heap: one keeps what its largest window took.
LEAN_BYTES = 1 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, local runs) is a folder beside the warehouse used, which executors share as well.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint whose size estimate starts anew, for loops.

    A checkpoint keeps the estimate of the plan that made it, and a join's is the product of its sides', so that in a loop of joins its digits grow exponentially until planning itself
    takes minutes and gigabytes. Rows pass through their public form, which is cheap for narrow ones.
    """
    spark, kept = df.sparkSession, checkpoint(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def narrow(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """In as many partitions as at most ``rows`` narrow rows need: of many short steps, a file for each of many empty partitions adds up."""
    return df.coalesce(max(1, min(partitions(df), 1 + rows // each)))


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's content: rows that share it are interchangeable, so it survives recomputation, repeated ids and null ids."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in cols])


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about ``limit`` text bytes, so that memory doesn't depend on the batch size."""
    texts = batch.column(batch.schema.get_field_index(column))
    if len(texts) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = WINDOW_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
