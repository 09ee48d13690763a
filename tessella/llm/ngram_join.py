"""N-gram Jaccard self-join as a blocked sparse matrix product.

The matrix has a row for each distinct text and a column for each n-gram of words. Its product with its transpose
holds the overlaps; only blocks that can hold a pair of Jaccard >= threshold are multiplied:

1. Each task sends its incidences to the owners of ranges of columns as compressed blocks: columns in order, as gaps, and the rows as numbers
   in a list that the block carries. An owner knows how many rows each of its columns has, and passes on those that have two.
2. A row with fewer of these columns than a partner must share (threshold * its size) has no partner and is discarded. In order of
   frequency, a pair must meet in the columns of both up to the one by which the bound leaves no room: the prefix.
3. Rows that meet in a prefix column and whose sizes fit each other are linked in order of size; connected
   components of these links are the diagonal blocks.
4. Within a component, rows in order of size form tiles; each pair of tiles whose sizes fit is multiplied over all columns, the overlaps are
   accumulated, and pairs below (threshold / (1 + threshold)) * (sum of sizes) are dropped.

All columns and all rows take part, nothing is sampled: no pair is lost. Columns are told apart by 48 bits of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .graph import components
from .runtime import cut
from .textkit import Piece, gram_hashes, mix64, pieces, signed, spans_hash

N, THRESHOLD, TILE, COLUMNS = 5, 0.4, 1024, 4096
#: Bits of a column's hash, and incidences that a task gathers before it sends them.
BITS, GATHERED = 48, 1 << 22


def row_grams(p: Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes and their rows, in order of row. A row of 1 to n-1 words has one gram, of all its words."""
    p.words()
    h = p.word_hashes()
    grams = gram_hashes(h, n)
    row = p.row[: len(grams)]
    inside = np.flatnonzero(row == p.row[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    count = np.diff(p.first)
    short = np.flatnonzero((count > 0) & (count < n))
    grams = np.concatenate([grams[inside], spans_hash(h, p.first[short], p.first[short + 1])])
    row = np.concatenate([row[inside], short])
    _, at = np.unique(grams ^ mix64(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    at = at[np.argsort(row[at], kind="stable")]
    return grams[at], row[at]


def _send(n: int, owners: int):
    """(owner, n, rows, code): the incidences of some texts with an owner's columns."""
    width = -(-(1 << BITS) // owners)

    def blocks(contents: list, sizes: list, grams: list, rows: list) -> Iterator[pa.RecordBatch]:
        content, size = np.concatenate(contents), np.concatenate(sizes)
        gram, row = np.concatenate(grams), np.concatenate(rows)
        order = np.argsort(gram, kind="stable")
        gram, row = gram[order], row[order]
        edges = np.searchsorted(gram, np.arange(owners + 1, dtype=np.uint64) * np.uint64(width))
        out = []
        for owner in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[owner], edges[owner + 1])
            own, inside = np.unique(row[part], return_inverse=True)
            gaps = np.diff(gram[part], prepend=np.uint64(owner * width))
            # as planes of bytes, the high ones of which are nearly all alike
            planes = np.concatenate([gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.ravel(), inside.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()])
            named = np.concatenate([content[own].view(np.uint8), size[own].astype(np.int64).view(np.uint8)]).tobytes()
            out.append((owner, len(gaps), len(own), named, bytes(pa.compress(planes.tobytes(), "zstd", asbytes=True))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _SENT.types)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        rows = count = 0
        for p in pieces(batches):
            gram, row = row_grams(p, n)
            for x, v in zip(held, (p.rows.column(0).to_numpy(), np.bincount(row, minlength=p.rows.num_rows), gram >> np.uint64(64 - BITS), row + rows)):
                x.append(v)
            rows += p.rows.num_rows
            count += len(gram)
            if count > GATHERED:
                yield from blocks(*held)
                held, rows, count = ([], [], [], []), 0, 0
        if count:
            yield from blocks(*held)

    return run


_SENT = pa.schema([("owner", pa.int32()), ("n", pa.int32()), ("rows", pa.int32()), ("named", pa.binary()), ("code", pa.binary())])


def _share(owners: int):
    """(content, gram, seen) of the columns that several texts have: seen is the number of texts, and the row's size in its low half."""
    width = -(-(1 << BITS) // owners)

    def shared(owner: int, parts: list) -> Iterator[pa.RecordBatch]:
        gram, content, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((content, gram))
        gram, content, size = gram[order], content[order], size[order]
        once = np.ones(len(gram), bool)
        once[1:] = (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])
        gram, content, size = gram[once], content[once], size[once]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        at = np.flatnonzero(new)
        df = np.diff(np.append(at, len(gram)))
        seen = np.repeat(df, df)
        keep = seen > 1
        gram, content, seen = signed(gram[keep]), content[keep], seen[keep] << 32 | size[keep]
        for k in range(0, len(gram), 1 << 18):
            part = slice(k, k + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (content, gram, seen)], ["content", "gram", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            for owner, n, rows, named, code in zip(*(c.to_pylist() for c in batch.columns)):
                if owner != last and parts:
                    yield from shared(last, parts)
                    parts = []
                last = owner
                planes = np.frombuffer(pa.decompress(code, 10 * n, "zstd"), np.uint8)
                gaps = np.zeros((n, 8), np.uint8)
                gaps[:, :6] = planes[: 6 * n].reshape(6, n).T
                inside = np.ascontiguousarray(planes[6 * n :].reshape(4, n).T).view(np.uint32).ravel()
                names = np.frombuffer(named, np.int64)
                parts.append((np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(owner * width), names[:rows][inside], names[rows:][inside]))
        if parts:
            yield from shared(last, parts)

    return run


def _rows(threshold: float):
    """(content, size, prefix, grams) of the texts that can have a partner. Rows come in order of content, seen and gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []

        def out(content, gram, seen) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(np.append(True, content[1:] != content[:-1]))
            met, size = np.diff(np.append(at, len(content))), seen[at] & 0xFFFFFFFF
            need = np.maximum(np.ceil(threshold * size - 1e-9), 1).astype(np.int64)
            found = [(content[at[k]], size[k], met[k] - need[k] + 1, gram[at[k] : at[k] + met[k]].tobytes()) for k in np.flatnonzero(met >= need).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["content", "size", "prefix", "grams"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append([c.to_numpy() for c in batch.columns])
            content = rest[-1][0]
            last = int(np.searchsorted(content, content[-1]))  # the last text may go on
            if last or len(rest) > 1 and rest[-2][0][-1] != content[0]:
                whole = [np.concatenate(x) for x in zip(*rest[:-1], [c[:last] for c in rest[-1]])]
                rest = [[c[last:] for c in rest[-1]]]
                if len(whole[0]):
                    yield from out(*whole)
        if rest:
            yield from out(*(np.concatenate(x) for x in zip(*rest)))

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        content, size, prefix = (b.column(k).to_numpy() for k in range(3))
        grams = [np.frombuffer(x, np.int64)[:n] for x, n in zip(b.column(3).to_pylist(), prefix.tolist())]
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.repeat(content, prefix)), pa.array(np.repeat(size, prefix))], ["gram", "content", "size"])


class _Tile:
    """Rows of one task, as they come in."""

    def __init__(self, key: tuple):
        self.key, self.content, self.side, self.size, self.grams = key, [], [], [], []

    def overlaps(self, threshold: float):
        """(contents, sizes, left, right, overlap): rows on either side and the overlaps of those above the bound, otherwise 0."""
        order = np.lexsort((self.content, self.size))
        content, side, size = (np.array(x)[order] for x in (self.content, self.side, self.size))
        diagonal = self.key[1] == self.key[2]
        left = np.arange(len(content)) if diagonal else np.flatnonzero(side == self.key[1])
        right = left if diagonal else np.flatnonzero(side == self.key[2])
        overlap = np.zeros((len(left), len(right)), np.float32)
        if not overlap.size:
            return content, size, left, right, overlap
        gram = np.concatenate([self.grams[k] for k in order])
        row = np.repeat(np.arange(len(content)), [len(self.grams[k]) for k in order])
        by = np.argsort(gram, kind="stable")
        gram, row = gram[by], row[by]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        column = np.cumsum(new) - 1
        several = np.bincount(column)[column] > 1
        row, column = row[several], column[several]
        column = np.unique(column, return_inverse=True)[1]
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            block = np.zeros((len(content), COLUMNS), np.float32)
            block[row[a:b], column[a:b] - k * COLUMNS] = 1
            overlap += block[left] @ block[right].T
        overlap[overlap * (1 + threshold) < threshold * (size[left][:, None] + size[right][None, :]) - 1e-3] = 0
        if diagonal:
            np.fill_diagonal(overlap, 0)
        return content, size, left, right, overlap

    def pairs(self, threshold: float) -> list[tuple]:
        """(content, content, size, size, overlap), each once."""
        content, size, left, right, overlap = self.overlaps(threshold)
        i, j = np.nonzero(overlap)
        if left is right:
            i, j = i[i < j], j[i < j]
        return list(zip(content[left[i]].tolist(), content[right[j]].tolist(), size[left[i]].tolist(), size[right[j]].tolist(), overlap[i, j].astype(np.int64).tolist()))

    def classes(self, threshold: float) -> list[tuple]:
        """(content, content that it is connected with, number of partners) of every row that has a partner here."""
        content, _, left, right, overlap = self.overlaps(threshold)
        hit = overlap > 0
        count = np.zeros(len(content), np.int64)
        count[left] += hit.sum(axis=1)
        if left is not right:
            count[right] += hit.sum(axis=0)
        label = np.arange(len(content))
        i, j = np.nonzero(hit)
        i, j = left[i], right[j]
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
        some = np.flatnonzero(count)
        return list(zip(content[some].tolist(), content[label[some]].tolist(), count[some].tolist()))


def _multiply(threshold: float, pairs: bool):
    names = ["a", "b", "a_size", "b_size", "overlap"] if pairs else ["content", "to", "links"]

    def out(tile: _Tile | None) -> Iterator[pa.RecordBatch]:
        found = (tile.pairs if pairs else tile.classes)(threshold) if tile and len(tile.content) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("component", "i", "j", "side", "content", "size", "grams")]
            for *key, side, content, size, grams in zip(*columns):
                if tile is None or tile.key != tuple(key):
                    yield from out(tile)
                    tile = _Tile(tuple(key))
                tile.content.append(content)
                tile.side.append(side)
                tile.size.append(size)
                tile.grams.append(np.frombuffer(grams, np.int64))
        yield from out(tile)

    return run


def _products(docs: DataFrame, n: int, threshold: float, text: str, pairs: bool) -> DataFrame:
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_send(n, owners), "owner int, n int, rows int, named binary, code binary").repartition(owners, "owner").sortWithinPartitions("owner")
    shared = sent.mapInArrow(_share(owners), "content long, gram long, seen long")
    laid = shared.repartition("content").sortWithinPartitions("content", "seen", "gram")
    rows = cut(laid.mapInArrow(_rows(threshold), "content long, size long, prefix int, grams binary"))
    seen = rows.mapInArrow(_prefixes, "gram long, content long, size long")
    order = W.partitionBy("gram").orderBy("size", "content")
    linked = seen.select("content", "size", F.lag("content").over(order).alias("a"), F.lag("size").over(order).alias("a_size"))
    links = linked.where(F.col("a_size") >= threshold * F.col("size") - 1e-9).select("a", F.col("content").alias("b")).distinct()
    found = components(links).withColumnRenamed("id", "content").join(rows.select("content", "size"), "content")
    by = W.partitionBy("component")
    place = found.select("*", F.floor((F.row_number().over(by.orderBy("size", "content")) - 1) / TILE).cast("int").alias("side"))
    place = cut(place)
    # tiles are met only by those whose sizes fit
    tiles = place.groupBy("component", "side").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    other = tiles.select(F.col("component").alias("c"), F.col("side").alias("j"), F.col("least").alias("least_j"))
    met = tiles.join(other, (F.col("component") == F.col("c")) & (F.col("side") <= F.col("j")) & (F.col("most") >= threshold * F.col("least_j") - 1e-9)).select("component", F.col("side").alias("i"), "j")
    both = met.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    tasks = place.select("component", "side", "content").join(both, ["component", "side"])
    laid = rows.select("content", "size", "grams").join(tasks, "content").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return laid.mapInArrow(_multiply(threshold, pairs), "a long, b long, a_size long, b_size long, overlap long" if pairs else "content long, to long, links long")


def _worded(column) -> F.Column:
    return F.coalesce(column.rlike(r"[^\t\n\x0B\f\r ]"), F.lit(False))


def _rows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.where(_worded(F.col(text))).select(F.xxhash64(F.col(text)).alias("content"), F.col(id).alias("doc_id"))


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all similar pairs of different texts, each text under its least id.

    These grow with the square of a group of edited copies; similar_documents has a row for each document instead. Null texts and
    texts without words have no partner. Null ids come last and stay null.
    """
    pairs = _products(docs, n, threshold, text, True)
    first = _rows_of(docs, id, text).groupBy("content").agg(F.min("doc_id").alias("name"))
    a = first.select(F.col("content").alias("a"), F.col("name").alias("_a"))
    b = first.select(F.col("content").alias("b"), F.col("name").alias("_b"))
    return pairs.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b"), (F.col("overlap") / (F.col("a_size") + F.col("b_size") - F.col("overlap"))).alias("jaccard"))


def _classes(docs: DataFrame, n: int, threshold: float, text: str) -> tuple[DataFrame, DataFrame]:
    """(content, links) and (id, component) of the texts that have partners."""
    found = cut(_products(docs, n, threshold, text, False))
    links = found.groupBy("content").agg(F.sum("links").cast("int").alias("n_links"))
    return links, components(found.where("content <> to").select("content", "to").distinct(), "content", "to")


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each document that has a copy or a similar text, whose n-gram sets' Jaccard is >= threshold.

    n_links is the number of other texts that are similar, all of them counted; n_copies that of the rows of this very text; class_id the
    least id of those that are connected by copies and links. Null texts and texts without words have no partner and no row, as have
    those that are alone. Null ids come last and stay null; a repeated row is a copy of itself; texts of fewer than n words have one gram, of all; very
    long texts are taken whole; extra columns don't matter; no rows give no rows.
    """
    links, groups = _classes(docs, n, threshold, text)
    rows = _rows_of(docs, id, text)
    texts = rows.groupBy("content").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).cast("int").alias("n_copies"))
    texts = texts.join(links, "content", "left").where("n_links > 0 or n_copies > 1").join(groups.withColumnRenamed("id", "content"), "content", "left")
    texts = texts.withColumn("component", F.coalesce("component", "content"))
    first = texts.groupBy("component").agg(F.min("name").alias("class_id"))
    texts = texts.join(first, "component").select("content", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows.join(texts, "content").select("doc_id", "class_id", "n_links", "n_copies")


def drop_similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group, a connected component of similar pairs or equal texts: that of the least id.

    Null ids come last; rows of null text or of a text without words all stay, no rows give none. Columns are kept, whatever their
    names. Of a repeated row one stays.
    """
    _, groups = _classes(docs, n, threshold, text)
    groups = groups.select(F.col("id").alias("_content"), F.col("component").alias("_group"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(text)).alias("_content"))
    worded = _worded(F.col(f"row.`{text}`"))
    key = F.struct(F.col(f"row.{id}").isNull().alias("n"), F.col(f"row.{id}").alias("i"), F.col("_content").alias("c"))
    # who stays is found from ids and hashes alone; texts are read again for those
    slim = whole.where(worded).select(key.alias("key"), "_content").join(groups, "_content", "left").groupBy(F.coalesce("_group", "_content").alias("_g")).agg(F.min("key").alias("key"))
    stay = slim.select(F.col("key.c").alias("_content"), F.col("key.i").alias("_id"))
    kept = whole.where(worded).join(stay, (whole["_content"] == stay["_content"]) & F.col(f"row.{id}").eqNullSafe(F.col("_id")))
    kept = kept.select("row").withColumn("k", F.row_number().over(W.partitionBy(F.xxhash64(F.col(f"row.{text}")), F.col(f"row.{id}")).orderBy(F.lit(1)))).where("k = 1")
    return kept.select("row.*").unionByName(whole.where(~worded).select("row.*"))
