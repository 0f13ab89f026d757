"""What all operators share: reading tables, the shared folder, and batch outputs."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns of the documents table.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where the setting is missing, a local session gets a folder of this machine; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="eventloom-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: cuts the lineage so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text only: other columns, whatever their names, never meet the operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_1, name_2, … that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if c.lower() not in taken)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not in the one column of `gone`; null ids stay, and columns keep any names they have."""
    key = fresh(docs, "gone_id")
    return docs.join(gone.toDF(key).distinct(), F.col("doc_id") == F.col(key), "left_anti")


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, most: int = 500) -> DataFrame:
    """Inner join on `key` with `right`, which has a key once and counts left's rows with it as `n`.

    Keys of over a 500th of left's `total` rows, 500 at most, are joined by broadcast, so that no task
    gets all rows of one; others meet in a shuffle. `n` is dropped.
    """
    limit = max(64, total // most)
    few = F.broadcast(right.where(F.col("n") > limit).drop("n"))
    rest = left.join(few.select(key), key, "left_anti").join(right.where(F.col("n") <= limit).drop("n"), key)
    return left.join(few, key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of a key as text, modulo; null counts as the empty string."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
