"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition hashes its texts, sorts the hashes and sends every owner (a range of the hash space) the
   Golomb-Rice code of the gaps between its hashes in that range: about log2(range / count) + 1.5 bits each.
2. Owners decode, find hashes that occur more than once, and return to each sender a bitmap over its sorted hashes.
3. Senders turn bitmaps into suspect hashes; only rows with such a hash are shuffled, and grouped by their very bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import cut

SUSPECTS = "_tessella_hash"


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Golomb-Rice code (parameter 2**shift) of the gaps of sorted uint64 values: quotients in unary, remainders in binary."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient = (gaps >> np.uint64(shift)).astype(np.int64)
    at = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint8)
    unary[at] = 1
    low = gaps & np.uint64((1 << shift) - 1)
    bits = ((low[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def golomb_decode(code: bytes, count: int, shift: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    at = np.flatnonzero(bits)[:count] if count else np.zeros(0, np.int64)
    quotient = np.diff(at, prepend=-1) - 1
    begin = (int(at[-1]) // 8 + 1) * 8 if count else 0
    low = bits[begin : begin + count * shift].reshape(count, shift).astype(np.uint64)
    low = (low << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if shift else np.zeros(count, np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(shift)) + low, dtype=np.uint64)


def _send(owners: int):
    width = -(-(1 << 64) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not parts:
            return
        hashes = np.sort(np.concatenate(parts).view(np.uint64))
        edges = np.array([k * width for k in range(1, owners)], np.uint64)
        cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
        rows = []
        for owner in range(owners):
            own = hashes[cuts[owner] : cuts[owner + 1]]
            if len(own):
                own = own - np.uint64(owner * width)
                shift = max(0, int(width // len(own)).bit_length() - 1)
                rows.append((owner, int(hashes[0] >> np.uint64(1)), len(own), shift, golomb_encode(own, shift)))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["owner", "sender", "n", "shift", "code"]), schema=_SENT, preserve_index=False)

    return send


_SENT = pa.schema([("owner", pa.int32()), ("sender", pa.int64()), ("n", pa.int32()), ("shift", pa.int32()), ("code", pa.binary())])


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """The owner's part: a bitmap for each message, set where the hash occurs more than once over all messages."""
    decoded = [golomb_decode(c, n, s) for c, n, s in zip(messages["code"], messages["n"], messages["shift"])]
    every = np.concatenate(decoded)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    twice = (counts > 1)[inverse]
    maps = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum(messages["n"].to_numpy())[:-1])]
    return messages.assign(bitmap=maps)[["owner", "sender", "n", "shift", "code", "bitmap"]]


def _suspects(owners: int):
    width = -(-(1 << 64) // owners)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                flags = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[: row["n"]].astype(bool)
                if flags.any():
                    found.append(golomb_decode(row["code"], row["n"], row["shift"])[flags] + np.uint64(row["owner"] * width))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], [SUSPECTS])

    return read


def suspect_hashes(docs: DataFrame, text: str = "text", owners: int | None = None) -> DataFrame:
    """Hashes (column SUSPECTS) that more than one row of docs has, by the fingerprint exchange; each comes once."""
    owners = owners or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("h"))
    sent = hashes.mapInArrow(_send(owners), "owner int, sender long, n int, shift int, code binary")
    back = sent.groupBy("owner").applyInPandas(_answer, "owner int, sender long, n int, shift int, code binary, bitmap binary")
    return back.mapInArrow(_suspects(owners), f"{SUSPECTS} long").distinct()


def duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """(doc_id, keeper_id, n_copies) of every row whose text another row has too.

    keeper_id is the least non-null id of the group. Null texts are equal to nothing; the empty text is a text like
    others; a null id is kept as null; a repeated row counts as often as it comes; no rows give no rows.
    """
    suspects = cut(suspect_hashes(docs, text, owners))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias(SUSPECTS)).where(F.col("text").isNotNull())
    rows = rows.join(suspects, SUSPECTS, "left_semi")
    groups = rows.groupBy("text").agg(F.min("doc_id").alias("keeper_id"), F.count(F.lit(1)).alias("n_copies"))
    # joined by the very text, where a text that many rows have is split as a skewed partition
    return rows.join(groups.where("n_copies > 1"), "text").select("doc_id", "keeper_id", "n_copies")


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """docs with one row of each text: that of the least id (nulls last). Rows with null text all stay; columns are kept."""
    suspects = cut(suspect_hashes(docs, text, owners))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(text)).alias(SUSPECTS))
    alone = whole.where(F.col(f"row.{text}").isNull()).unionByName(whole.where(F.col(f"row.{text}").isNotNull()).join(suspects, SUSPECTS, "left_anti"))
    several = whole.where(F.col(f"row.{text}").isNotNull()).join(suspects, SUSPECTS, "left_semi")
    kept = several.groupBy(F.col(f"row.{text}").alias("t")).agg(F.min_by("row", F.struct(F.col(f"row.{id}").isNull(), F.col(f"row.{id}"))).alias("row"))
    return alone.select("row.*").unionByName(kept.select("row.*"))
