"""Token-id store: one zstandard frame per document, with a shared dictionary.

Format. A store is a folder of two Parquet tables that Spark writes and reads,
so that it may lie in any file system Spark knows.

* ``dictionary``: one row ``dict_hash, id_bytes, dictionary``. The dictionary
  is trained on serialised id arrays.
* ``shards``: rows ``part, shard, local_start, n_tokens, dict_hash, first_id,
  last_id, index, data``. ``data`` holds the documents' frames one after
  another; each is compressed alone with the shared dictionary. ``index``
  holds for each document five little-endian signed 64-bit numbers: doc_id,
  whether it is null, frame offset, frame length, ids. ``local_start`` counts
  the ids before the shard in its part. Parts, shards and documents ascend by
  doc_id (nulls first).

A short document is read by its own: ``first_id``/``last_id`` choose the
shard by Parquet statistics, the index gives the frame, and only that is
decompressed.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, unit_hash
from .tokens import encoder

SHARD_SCHEMA = "part long, shard long, local_start long, n_tokens long, dict_hash string, first_id long, last_id long, index binary, data binary"
READ_SCHEMA = "part long, doc_id long, local_start long, n_tokens long, ids binary"
#: Compressed bytes after which a shard is closed.
SHARD_BYTES = 4 << 20
#: Documents, and characters of each, that the dictionary is trained on at most.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2_000, 4_000, 64 << 10
INDEX = "<qqqqq"


def serialised(ids: bytes, id_bytes: int) -> bytes:
    return ids if id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def parsed(data: bytes, id_bytes: int) -> bytes:
    return data if id_bytes == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_bytes: int, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> bytes:
    """A dictionary from a bounded sample: `about ``sample_docs`` texts of at most ``sample_chars`` characters.

    The dictionary serves short documents, so it is trained on such. It only
    sets the compression ratio. Fewer than 50 texts, or too little content to
    train on, give an empty dictionary.
    """
    share = sample_docs / max(1, docs.count())
    picked = docs.where((unit_hash("doc_id", "text") < share) & F.length("text").between(1, sample_chars)).select("text").dropDuplicates().limit(2 * sample_docs)
    enc = encoder(tokenizer_path)
    samples = [serialised(ids, id_bytes) for ids in enc.encode_all(picked.toArrow().column("text").combine_chunks())]
    if len(samples) < 50:
        return b""
    size = min(dict_bytes, max(1024, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, level: int = 3, shard_bytes: int = SHARD_BYTES, sample_docs: int = SAMPLE_DOCS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are left out) and write a store to ``path``.

    Null texts count as empty; every document gets ``end_id``. Documents with a
    null doc_id come first; equal doc_ids stand in no fixed order. The rows are
    dealt by ranges of doc_id, so that no task sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    id_bytes = 2 if max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(rows, tokenizer_path, id_bytes, sample_docs)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, id_bytes, bytearray(dictionary))], "dict_hash string, id_bytes int, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    end = np.uint32(end_id).tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        index, frames, size, tokens = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            ids = [e[0] for e in index if not e[1]]
            row = [part, shard, before, tokens, dict_hash, ids[0] if ids else None, ids[-1] if ids else None, b"".join(struct.pack(INDEX, *e) for e in index), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SHARD_TYPES, strict=True)], names=SHARD_NAMES)

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                ids += end
                frame = packer.compress(serialised(ids, id_bytes))
                index.append((doc_id or 0, doc_id is None, size, len(frame), len(ids) // 4))
                frames.append(frame)
                size, tokens = size + len(frame), tokens + len(ids) // 4
                if size >= shard_bytes:
                    yield closed()
                    before, shard = before + tokens, shard + 1
                    index, frames, size, tokens = [], [], 0, 0
        if index:
            yield closed()

    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ranged.mapInArrow(shards, SHARD_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(f"{path}/shards")


SHARD_NAMES = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
SHARD_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _dictionary(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary of {path} does not match its hash")
    return row["dict_hash"], row["id_bytes"], data


def _decode(shards: DataFrame, path: str, wanted: frozenset[int] | None = None) -> DataFrame:
    spark = shards.sparkSession
    dict_hash, id_bytes, dictionary = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(dictionary)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            if row["dict_hash"] != dict_hash:
                raise ValueError("a shard was written with another dictionary")
            start, out = row["local_start"], []
            for doc_id, missing, offset, length, n in struct.iter_unpack(INDEX, row["index"]):
                if wanted is None or (not missing and doc_id in wanted):
                    ids = parsed(opener.decompress(row["data"][offset : offset + length]), id_bytes)
                    out.append((row["part"], None if missing else doc_id, start, n, ids))
                start += n
                if len(out) == 512:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return shards.select("part", "local_start", "dict_hash", "index", "data").mapInArrow(frames, READ_SCHEMA)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", "doc_id", "local_start", "n_tokens", "ids"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    # one row per range partition; the running sum over those few rows gives each partition's first id
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    return _decode(shards, path).join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Some documents of a store by id: doc_id, n_tokens, ids. Opens only shards whose id range holds one of them."""
    wanted = frozenset(map(int, doc_ids))
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    hit = F.lit(False)
    for i in wanted:
        hit = hit | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    return _decode(shards.where(hit), path, wanted).select("doc_id", "n_tokens", "ids")





