"""Helpers the text operators share: words, folders and column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def words(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lowered, cut at the blanks 0x20 and 0x09-0x0D, which is what bytes.split does."""
    return data.lower().split()


def utf8(column: str | Column) -> Column:
    """A text column as its bytes, null as empty: Python tasks need no decoding then."""
    col = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def pick(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{column}`")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or the first of wanted_1, wanted_2 ... that no column has (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def run_folder(spark: SparkSession) -> str:
    """A new folder of this run in the one all machines share (spark.checkpoint.dir).

    Where the setting is absent, a temporary folder serves, but only if driver and executors are one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The frame written once and read again: lineage ends here, so lost executors cost no earlier work."""
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a task: free memory of Arrow and of the C library goes back to the machine, as Python workers live on
    for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_hash_share(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
