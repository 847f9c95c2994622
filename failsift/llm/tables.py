"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failsift.session import work_dir

# Rows that go to a Python worker at once. Texts can be long, so the default of 10,000
# rows would not fit beside the executor's heap.
ROWS_PER_ARROW_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a scan and a Python worker hold of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_ARROW_BATCH))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from that table.

    The tables hold hashes and digests for the most part, which take less room with zstd.
    """
    spark = df.sparkSession
    folder = work_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size, numbers without nulls."""
    found = df.toArrow()
    return {name: found.column(name).to_numpy() for name in df.columns}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a document without id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
