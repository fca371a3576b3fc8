"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, and of text that a Python step holds at once.
BATCH_BYTES = 8 << 20

#: White space of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"

#: UTF-8 bytes -> lower-case word bytes, everything that ends a word -> space.
#: The class is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: The same class as a regular expression, for JVM and DuckDB.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, UPPER, LOWER)


@cache
def _own_root() -> str:
    root = tempfile.mkdtemp(prefix="gaugeframe-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all machines share (spark.checkpoint.dir).

    Where the setting is missing, a session on one machine uses one temporary
    folder for all its tables; a cluster has none that all can see, so that
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/gaugeframe-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here."""
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in either case."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, since a text may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = df.columns
    if any("." in n for n in names):  # mapInArrow would take the dot for a field of a struct
        plain = df.toDF(*[f"c{i}" for i in range(len(names))])
        return plain.mapInArrow(lambda batches: step(b.rename_columns(names) for b in batches), schema)
    return df.mapInArrow(step, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the bytes of ``column`` pass ``limit``; a row stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def utf8(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is empty."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]
