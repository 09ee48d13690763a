"""Best-fit packing of documents into training sequences, by hierarchical residual packing.

Each partition packs its own items best-fit (largest first). Bins filled to FULL of the capacity are final; the
others go on as single items of their fill to the next round, where 1/FAN_IN as many partitions pack them again. The
last round is one partition; what reaches it is a few underfull bins of each partition of the round before.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .runtime import cut
from .textkit import pieces

CAPACITY, FULL, FAN_IN = 2048, 0.98, 8

PART = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("words", T.IntegerType())])
BINS = T.StructType([T.StructField("fill", T.IntegerType()), T.StructField("parts", T.ArrayType(PART))])
_PART = pa.struct([("doc_id", pa.int64()), ("chunk", pa.int32()), ("begin", pa.int64()), ("words", pa.int32())])
_BINS = pa.schema([("fill", pa.int32()), ("parts", pa.list_(_PART))])


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """For items in the order given, the bin of each: of the bins with room, the fullest; of those, the latest made."""
    room: list[int] = []  # distinct rooms left, in order
    stacks: dict[int, list[int]] = {}
    bins, out = 0, []
    for size in sizes:
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            stack = stacks[left]
            at = stack.pop()
            if not stack:
                del stacks[left]
                room.pop(k)
        else:
            left, at = capacity, bins
            bins += 1
        out.append(at)
        left -= size
        if left:
            if left not in stacks:
                insort(room, left)
                stacks[left] = []
            stacks[left].append(at)
    return out


def _chunks(capacity: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            p.words()
            n = np.diff(p.first)
            null = ~p.rows.column(1).is_valid().to_numpy(zero_copy_only=False)
            many = np.where(null, 0, np.maximum(1, -(-n // capacity)))
            row = np.repeat(np.arange(len(n)), many)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = chunk * capacity
            words = np.minimum(n[row] - begin, capacity)
            ids = p.rows.column(0).take(pa.array(row))
            parts = pa.StructArray.from_arrays([ids, pa.array(chunk, pa.int32()), pa.array(begin, pa.int64()), pa.array(words, pa.int32())], fields=list(_PART))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1), pa.int32()), parts)], schema=_BINS)

    return cut_up


def _pack(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=_BINS)
        if not table.num_rows:
            return
        lists = table.column(1).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        fill = table.column(0).to_numpy()
        flat, counts = lists.flatten(), np.diff(np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4))
        head = np.cumsum(counts) - counts
        ids, chunk = flat.field(0).fill_null(np.iinfo(np.int64).min).to_numpy(), flat.field(1).to_numpy()
        lead = ids[head]
        order = np.lexsort((chunk[head], lead, -fill))  # ties by id: the same bins whatever order rows come in
        bins = np.array(best_fit(fill[order].tolist(), capacity))
        by = np.argsort(bins, kind="stable")
        taken = order[by]
        n_parts = counts[taken]
        total = np.bincount(bins, weights=fill[order]).astype(np.int32)
        per_bin = np.bincount(bins[by], weights=n_parts).astype(np.int64)
        at = np.repeat(head[taken] - (np.cumsum(n_parts) - n_parts), n_parts) + np.arange(int(n_parts.sum()))
        offsets = np.concatenate([[0], np.cumsum(per_bin)])
        out = pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(at)))], schema=_BINS)
        for k in range(0, out.num_rows, 5000):
            yield out.slice(k, 5000)

    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, full: float = FULL, fan_in: int = FAN_IN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bin, fill, slot, doc_id, chunk, begin, words): where each chunk of each document goes; fill <= capacity words.

    A document of more than `capacity` words is cut into whole chunks and a rest. bin is a string that names the
    bin by its first chunk and the round that closed it. Documents of no words take up 0 words of some bin, null texts are
    left out, null ids stay null, ids are cast to long, repeated rows are separate items, and no rows give no bins.
    """
    if capacity < 1 or fan_in < 2:
        raise ValueError("capacity must be at least 1 and fan_in at least 2")
    spark = docs.sparkSession
    items = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_chunks(capacity), BINS)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done, round_no = [], 0
    least = int(np.ceil(full * capacity))
    first = F.xxhash64(F.col("parts")[0]["doc_id"], F.col("parts")[0]["chunk"])
    bins = items.repartition(width, first).mapInArrow(_pack(capacity), BINS)
    while True:
        # a bin is told apart by where it was closed: two bins may begin with like items where rows are repeated
        bins = cut(bins.select("*", F.monotonically_increasing_id().alias("at")))
        name = F.concat_ws("-", F.lit(f"r{round_no}"), F.col("at").cast("string"))
        if width == 1:
            done.append(bins.select(name.alias("bin"), "fill", "parts"))
            break
        done.append(bins.where(F.col("fill") >= least).select(name.alias("bin"), "fill", "parts"))
        width, round_no = max(1, width // fan_in), round_no + 1
        rest = bins.where(F.col("fill") < least).drop("at")
        bins = rest.repartition(width, first).mapInArrow(_pack(capacity), BINS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("bin", "fill", F.posexplode("parts").alias("slot", "part")).select("bin", "fill", "slot", "part.*")
