"""Best-fit packing by minimum bin slack.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. How many pieces have each
length is a table of at most ``capacity`` rows whatever the corpus, and packing works on it: each bin takes
the longest piece left and then the fullest feasible combination of lengths, found by subset-sum dynamic
programming over bitsets. The combination is repeated as often as the counts allow, so there are about as
many patterns as lengths. Pieces then find their bin by their rank among pieces of their length.

Nulls: a null text is empty (its end id only). Equal ids and repeated rows are documents of their own.
Very long texts are cut into as many pieces as needed. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch
from .tokens import encoder, slices, vocabulary_path, with_end

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many of each length fill ``room`` best; ``lengths`` descend. Bit s of a set: sum s can be reached."""
    mask = (1 << (room + 1)) - 1
    sums, layers = 1, []
    for n in lengths:
        most = min(counts[n], room // n)
        if most <= 0:
            continue
        layers.append((n, most, sums))
        step, left = 1, most
        while left:
            step = min(step, left)
            sums |= (sums << (n * step)) & mask
            left -= step
            step *= 2
        if sums >> room & 1:
            break
    best, out = sums.bit_length() - 1, {}
    for n, most, before in reversed(layers):
        k = next(k for k in range(most + 1) if best >= n * k and before >> (best - n * k) & 1)
        if k:
            out[n] = k
            best -= n * k
    return out


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, pieces of each length in such a bin), until no piece is left."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    lengths = sorted(counts, reverse=True)
    while counts:
        lengths = [n for n in lengths if n in counts]
        top = lengths[0]
        counts[top] -= 1
        room = capacity - top
        bin_ = Counter(fullest(room, [n for n in lengths if n <= room], counts)) + Counter({top: 1})
        counts[top] += 1
        times = min(counts[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((times, dict(bin_)))
    return out


def slots(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, bins, first bin, offset), sorted: where pieces of a length and rank go."""
    rows, used, first_bin = [], Counter(), 0
    for times, bin_ in plan:
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, used[n], times, first_bin, offset))
            used[n] += times * bin_[n]
            offset += n * bin_[n]
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch):
                ids, counts = with_end(*enc.encode(part.column("text")), end_id)
                first = np.cumsum(counts) - counts
                per_doc = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), per_doc)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = first[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sizes, begins, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(begins, many) + np.repeat([seen[n] for n in sizes.tolist()], many)
                seen.update(dict(zip(sizes.tolist(), many.tolist())))
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
                if with_ids:
                    ends = np.concatenate([at, [len(ids)]]).astype(np.int32) if len(at) else np.zeros(1, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    return run


def _places(table: np.ndarray):
    key = (table[:, 0] << 44) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
            t = rank - row[:, 1]
            keep = [c for c in batch.schema.names if c not in ("rank",)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(row[:, 3] + t % row[:, 2]), pa.array(row[:, 4] + t // row[:, 2] * length)],
                [*keep, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, scratch: Scratch, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Pieces are ranked within their length without gathering a length: by a count inside each task, written
    with the piece, plus the counts of the tasks before, so a length that a third of all pieces share is
    no hot key.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.save(rows.mapInArrow(_pieces(path or vocabulary_path(), capacity, end_id, with_ids), schema), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("_base")).drop("nth", "task", "_base")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_places(slots(patterns(counts, capacity))), out)
