"""Token files: ids of all documents in ascending id order, as patched frame-of-reference blocks.

A segment is a self-contained byte string of about ``SEGMENT_IDS`` ids, kept as one row of a Parquet file
beside the ids and lengths of its documents, so writing, committing and reading stay Spark's. Layout,
little-endian:

    magic ``MPF1``, u32 ids per block, u64 ids, u32 blocks, then u32 block starts (bytes, from the first block)
    each block: u32 minimum, u8 width, u16 exceptions, packed (id - minimum) in ``width`` bits each,
    then u16 places and u32 values of the exceptions

The width holds ``PERCENTILE`` of a block's ids; the rest are exceptions.

Nulls: a null text is an empty document (end id only); null ids sort first. A very long text is encoded and written as
one document, in a segment of its own; its ids are held with it. Repeated rows and equal ids
are documents of their own. An empty table gives no segments and an empty result. Other columns are not
read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .tokens import encoder, slices, vocabulary_path, with_end

BLOCK = 1024
SEGMENT_IDS = 1 << 20
PERCENTILE = 0.95
END_ID = 2
_HEAD = struct.Struct("<4sIQI")
_BLOCK_HEAD = struct.Struct("<IBH")


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    kth = max(0, int(np.ceil(len(rest) * percentile)) - 1)
    width = int(np.partition(rest, kth)[kth]).bit_length()
    odd = np.flatnonzero(rest >= (1 << width)) if width < 32 else np.zeros(0, np.int64)
    values = rest[odd].astype("<u4")
    rest = rest.copy()
    rest[odd] = 0
    return _BLOCK_HEAD.pack(low, width, len(odd)) + _pack(rest, width) + odd.astype("<u2").tobytes() + values.tobytes()


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = [encode_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4") if blocks else np.zeros(0, "<u4")
    return _HEAD.pack(b"MPF1", block, len(ids), len(blocks)) + starts.tobytes() + b"".join(blocks)


def decode_segment(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """The ids at ``first`` and after; only the blocks that hold them are decoded, found by the index."""
    magic, block, n, n_blocks = _HEAD.unpack_from(data)
    if magic != b"MPF1":
        raise ValueError("not a token segment")
    count = n - first if count is None else min(count, n - first)
    if count <= 0:
        return np.zeros(0, np.uint32)
    base = _HEAD.size + 4 * n_blocks
    starts = np.frombuffer(data, "<u4", n_blocks, _HEAD.size)
    out = []
    for b in range(first // block, (first + count - 1) // block + 1):
        at = base + int(starts[b])
        low, width, n_odd = _BLOCK_HEAD.unpack_from(data, at)
        size = min(block, n - b * block)
        at += _BLOCK_HEAD.size
        packed = (size * width + 7) // 8
        ids = _unpack(data[at : at + packed], size, width)
        if n_odd:
            at += packed
            ids[np.frombuffer(data, "<u2", n_odd, at)] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
        out.append(ids + np.uint32(low))
    return np.concatenate(out)[first % block : first % block + count]


SEGMENT_SCHEMA = "part int, segment int, n_docs int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, blob binary"
_ARROW_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blob", pa.binary())])


def _segments(path: str, end_id: int, segment_ids: int, block: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        keys: list = []
        lengths: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate(held)
            row = [[part], [number], [len(keys)], [len(ids)], [keys[:]], [lengths[:]], [encode_segment(ids, block, percentile)]]
            number += 1
            keys.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ARROW_SEGMENT)], schema=_ARROW_SEGMENT)

        for batch in batches:
            for piece in slices(batch, most=4 << 20):
                ids, counts = with_end(*enc.encode(piece.column("text")), end_id)
                keys += piece.column("doc_id").to_pylist()
                lengths += counts.tolist()
                held.append(ids)
                if sum(map(len, held)) >= segment_ids:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_files(docs: DataFrame, scratch: Scratch, path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """Encode and write; returns the written segments. One range shuffle puts documents in id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(rows.mapInArrow(_segments(path or vocabulary_path(), end_id, segment_ids, block, percentile), SEGMENT_SCHEMA), "token-files")


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, segment, first): ids before each segment; totals per part first, so that no window holds all segments."""
    sizes = segments.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return inner.join(parts, "part").select("part", "segment", (F.col("_base") + F.col("_in")).alias("first"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, segment, keys, lengths, blob in zip(*(batch.column(c) for c in ("part", "segment", "doc_ids", "lengths", "blob"))):
            ids = decode_segment(blob.as_py()).astype("<u4")
            n = np.asarray(lengths.values.to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(n)
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * len(n), pa.int32()), pa.array([segment.as_py()] * len(n), pa.int32()), keys.values, pa.array(ends - n), pa.array(n), pa.array(sums, pa.int64())],
                ["part", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded files."""
    rows = segments.select("part", "segment", "doc_ids", "lengths", "blob").mapInArrow(_digests, "part int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(segments), ["part", "segment"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
