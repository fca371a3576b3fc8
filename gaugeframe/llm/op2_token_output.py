"""Token-ID output: documents as token ids in range-coded shard files.

Every text (null: empty) is encoded by the tokenizers library; the id
``end_id`` closes each document.  Documents are dealt in ranges of ascending
doc_id, sorted in each range (ties by text, null ids first), and each task
writes its range as shards of about ``SHARD_IDS`` ids in whole documents.
Shards go through Spark's writer into the shared folder, so any store works
and a lost executor's shards are written anew.

Repeated rows and doc_ids are documents of their own.  An empty table gives
no shards and no rows.  Only doc_id and text are read; other columns may be
there under any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, rans, vocab

SHARD_IDS = 1 << 21
END_ID = 1
SHARD_SCHEMA = "part int, shard int, first_id long, n_docs long, n_tokens long, ids array<long>, payload binary"
_CACHE: dict[str, vocab.LibraryChunks] = {}


def _chunks(path: str) -> vocab.LibraryChunks:
    if path not in _CACHE:
        _CACHE[path] = vocab.LibraryChunks(path)
    return _CACHE[path]


def _shard_writer(path: str, end_id: int, shard_ids: int):
    def write(batches):
        from pyspark import TaskContext

        part, shard, cache, end = TaskContext.get().partitionId(), 0, _chunks(path), vocab.pack([end_id])
        ids, held, have, first = [], [], 0, 0
        schema = pa.schema(
            [("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("payload", pa.binary())]
        )

        def close():
            nonlocal ids, held, have, first, shard
            payload = rans.encode(np.frombuffer(b"".join(held), "<u4"), [len(x) // 4 for x in held])
            row = pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((part, shard, first, len(held), have, ids, payload), schema.types, strict=True)], schema=schema
            )
            first, shard, ids, held, have = first + have, shard + 1, [], [], 0
            return row

        for batch in batches:
            cache.trim()
            doc_ids = batch.column(0).to_pylist()
            for doc_id, text in zip(doc_ids, common.utf8(batch.column(1)), strict=True):
                ids.append(doc_id)
                held.append(b"".join(map(cache.__getitem__, text.split())) + end)
                have += len(held[-1]) // 4
                if have >= shard_ids:
                    yield close()
        if held:
            yield close()

    return write


def write_shards(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes shards in ascending doc_id order to ``out``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    common.map_batches(ranged, _shard_writer(path or vocab.default_path(), end_id, shard_ids), SHARD_SCHEMA).write.parquet(out)


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            shard, at, rows, size = rans.Shard(row["payload"]), row["base"], [], 0
            for doc_id, ids in zip(row["ids"], shard.documents(), strict=True):
                raw = ids.astype("<u4").tobytes()
                rows.append((doc_id, at, len(ids), raw))
                at, size = at + len(ids), size + len(raw)
                if size > common.BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in _reader(batches):
        crc = pa.array([zlib.crc32(x) for x in batch.column(3).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], schema=schema)


def _placed(spark: SparkSession, out: str) -> DataFrame:
    """Shards with the number of ids before them; one row per task is summed, not one per document."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(out)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return shards.join(before, "part").select((F.col("before") + F.col("first_id")).alias("base"), "ids", "payload")


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (packed) of every document in the shards."""
    return common.map_batches(_placed(spark, out), _reader, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as shards, reads them back, and gives their digests."""
    out = common.shared_dir(spark)
    write_shards(common.table(spark, sf_dir, "documents"), out)
    return common.map_batches(_placed(spark, out), _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
