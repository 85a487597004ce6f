"""Token-id files with random access (directly addressable codes).

A store is a Parquet folder. Each row is one segment: documents in ascending
order of their id, the ids of their tokens as one DAC blob, and for each
document its place in the segment. Parquet gives atomic commits, retries and
any store that Spark writes to; the blob gives access to any token.

Columns: part, segment (order), doc_ids, starts (in the segment), counts,
n_tokens, dac.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dac
from .common import as_bytes, blocks, bound_batches, records
from .wordcodes import default_tokenizer, encoder

#: Tokens after which a segment ends (at the end of a document).
SEGMENT_TOKENS = 1 << 20

#: Pieces in one generation of a worker's dictionary while a store is written.
CACHE_PIECES = 450_000

STORE_SCHEMA = "part int, segment int, doc_ids array<bigint>, starts array<bigint>, counts array<bigint>, n_tokens bigint, dac binary"


def _segments(tokenizer: str, end_id: int, segment_tokens: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, segment = encoder(tokenizer, CACHE_PIECES), None, 0
        docs: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, held, segment
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = np.cumsum(counts) - counts
            blob = dac.encode(np.frombuffer(b"".join(ids), "<u4"))
            out = records(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([int(counts.sum())], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "segment", "doc_ids", "starts", "counts", "n_tokens", "dac"],
            )
            docs, ids, held, segment = [], [], 0, segment + 1
            return out

        for whole in batches:
            for batch in blocks(whole, "text", 4 << 20):
                part = batch.column("part")[0].as_py()
                for doc, found in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
                    docs.append(doc)
                    ids.append(found + tail)
                    held += len(found) // 4 + 1
                    if held >= segment_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments of all documents in ascending id order, ready to be written.

    A null text counts as empty and still gets its end id. Documents with a
    null id come first. Rows that share an id stay separate documents, in any
    order among themselves. An empty table gives no segment. Other columns
    are ignored.
    """
    bound_batches(docs.sparkSession)
    order = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_bytes(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = order.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    order = order.withColumn("part", F.spark_partition_id())
    return order.mapInArrow(_segments(tokenizer or default_tokenizer(), end_id, segment_tokens), STORE_SCHEMA)


def segment_offsets(store: DataFrame) -> DataFrame:
    """The number of tokens before each segment: part, segment, before.

    Rows here are segments (a million tokens each), so the ordered sum over
    parts is of one row a part, and the sum within a part is dealt by part.
    """
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    return store.select("part", "segment", inside.alias("inside")).join(parts, "part").select("part", "segment", (F.col("part_before") + F.col("inside")).alias("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment = dac.Segment(row["dac"])
            crcs = [zlib.crc32(segment.slice(s, n).tobytes()) for s, n in zip(row["starts"], row["counts"])]
            k = len(crcs)
            yield records(
                [pa.array([row["part"]] * k, pa.int32()), pa.array([row["segment"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["starts"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_digests(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored segments."""
    found = store.select("part", "segment", "doc_ids", "starts", "counts", "dac").mapInArrow(_digests, "part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(segment_offsets(store), ["part", "segment"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment = dac.Segment(row["dac"])
            ids = [segment.slice(s, n) for s, n in zip(row["starts"], row["counts"])]
            yield records([pa.array(row["doc_ids"], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])


def read_ids(store: DataFrame) -> DataFrame:
    """doc_id and the ids of every document, end id included."""
    return store.select("doc_ids", "starts", "counts", "dac").mapInArrow(_texts, "doc_id bigint, ids array<bigint>")
