"""Passages that occur again, word for word, by a distributed merge sort of suffixes.

A passage is LENGTH words. Every window of LENGTH words has an anchor, the position in its first half with the least
hash of the REACH words from there, so equal windows have their anchors at the same place. Only suffixes at anchors
whose REACH words occur again anywhere are sorted:

1. Each partition sorts its suffixes (LENGTH words at most) and sends each owner (a range of the hashes of their first
   REACH words) a front-coded run: of each suffix the length of the prefix it shares with the one before, and the rest.
2. Owners merge the runs with a loser tree whose players carry the known common prefix with the last winner: unequal
   ones decide a match, and only bytes beyond are ever compared. The merge yields the LCP array.
3. Suffixes with r common words and LENGTH - r equal words to their left share a window; windows of a document are joined to passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .runtime import cut
from .textkit import Piece, mix64, pieces, signed, spans_hasher, window_min

LENGTH = 50


def _reach(length: int) -> int:
    return length // 2 + 1


def _anchors(length: int):
    reach = _reach(length)
    width = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            p.words()
            content = p.rows.column(0).to_numpy()
            n = len(p.starts)
            at = np.zeros(0, np.int64)
            if n >= length:
                begin = np.arange(n - reach + 1)
                h = spans_hasher(p.word_hashes())(begin, begin + reach) | np.uint64(1)
                least = window_min(h, width)
                least[p.row[: n - length + 1] != p.row[length - 1 :]] = 0
                around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
                around[width - 1 : width - 1 + len(least)] = least
                at = np.flatnonzero(window_min(around, width, np.maximum, 0) == h)
            rows, hashes, place = p.row[at], h[at] if n >= length else np.zeros(0, np.uint64), at - p.first[p.row[at]] if n >= length else at
            count = np.diff(p.first)
            long_enough = np.flatnonzero(count >= length)
            # a document's own row: its hash twice means copies; its place holds its number of words
            rows = np.concatenate([rows, long_enough])
            hashes = np.concatenate([hashes, mix64(content[long_enough].view(np.uint64) + np.uint64(length))])
            place = np.concatenate([place, -count[long_enough]])
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(content[rows]), pa.array(place, pa.int32())], ["h", "content", "place"])

    return run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which known bytes are known to be equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, lcp with the one before) over all strings of sorted runs with their LCP arrays, in order.

    A loser tree: an inner node holds the loser of its match and the prefix that it shares with the winner of that
    match. A new player and every loser on its path were last compared with the same string, so unequal LCPs decide.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    strings = [r[0] for r in runs] + [[]] * (size - count)
    lcps = [r[1] for r in runs] + [[]] * (size - count)
    index = [0] * size
    loser, shared = [0] * size, [0] * size
    ends = [len(s) for s in strings]

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner, its LCP with the last overall winner, loser, its LCP with this match's winner."""
        if index[a] >= ends[a]:
            return b, lb, a, 0
        if index[b] >= ends[b]:
            return a, la, b, 0
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = strings[a][index[a]], strings[b][index[b]]
        l = common_prefix(x, y, la)
        if l == len(x) and (l < len(y) or a < b) or l < len(x) and l < len(y) and x[l] < y[l]:
            return a, la, b, l
        return b, lb, a, l

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, loser[node], shared[node] = play(a, la, b, lb)
        return w, lw

    winner, lcp = build(1) if size > 1 else (0, 0)
    total = sum(ends)
    for _ in range(total):
        yield winner, index[winner], lcp
        index[winner] += 1
        k = index[winner]
        player, l = winner, lcps[winner][k] if k < ends[winner] else 0
        node = (winner + size) >> 1
        while node:
            player, l, loser[node], shared[node] = play(player, l, loser[node], shared[node])
            node >>= 1
        winner, lcp = player, l


def front_code(strings: list[bytes]) -> tuple[list[int], bytes]:
    """LCP with the string before of each sorted string, and what follows it, end to end."""
    lcps = [0] * len(strings)
    for k in range(1, len(strings)):
        lcps[k] = common_prefix(strings[k - 1], strings[k], 0)
    return lcps, b"".join(s[l:] for s, l in zip(strings, lcps))


def front_decode(lcps: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for l, size in zip(lcps, sizes):
        last = last[:l] + rest[at : at + size - l]
        at += size - l
        out.append(last)
    return out


_RUN = [("owner", pa.int32()), ("n", pa.int32()), ("lcps", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary()), ("left", pa.binary()), ("left_n", pa.binary()), ("content", pa.binary()), ("place", pa.binary())]
_RUN_SQL = "owner int, n int, lcps binary, sizes binary, rest binary, left binary, left_n binary, content binary, place binary"


def _runs(length: int, owners: int):
    back = length - _reach(length)

    def message(owner: int, items: list[tuple]) -> tuple:
        items.sort(key=lambda x: x[0])
        strings = [x[0] for x in items]
        lcps, rest = front_code(strings)
        pack = lambda k, t: np.array([x[k] for x in items], t).tobytes()
        small = lambda x: zlib.compress(x, 1)
        return owner, len(items), small(np.array(lcps, np.int32).tobytes()), small(np.array([len(s) for s in strings], np.int32).tobytes()), small(rest), small(b"".join(x[1] for x in items)), pack(2, np.uint8 if back < 256 else np.int32), pack(3, np.int64), pack(4, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        held = 0

        def flush():
            rows = [message(o, x) for o, x in by.items()]
            by.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RUN)], [n for n, _ in _RUN])

        for p in pieces(batches):
            places = p.rows.column(p.rows.schema.get_field_index("places"))
            owned = p.rows.column(p.rows.schema.get_field_index("hashes"))
            content = p.rows.column(p.rows.schema.get_field_index("content")).to_pylist()
            for k in range(p.rows.num_rows):
                words = p.text(k).split()
                flat = b" ".join(words) + b" "
                at = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
                for place, h in zip(places[k].as_py(), owned[k].as_py()):
                    stop, start = min(place + length, len(words)), max(0, place - back)
                    by.setdefault(((h % (1 << 64)) >> 20) % owners, []).append((flat[at[place] : at[stop]], flat[at[start] : at[place]], place - start, content[k], place))
                    held += at[stop] - at[start]
            if held > 48 << 20:  # a run is what fits in memory; more runs are merged all the same
                yield from flush()
                held = 0
        yield from flush()

    return run


def _word_hashes(text: bytes) -> np.ndarray:
    p = Piece(None, pa.array([text], pa.large_binary()).cast(pa.large_string()))
    p.words()
    return p.word_hashes()


def _owner(length: int):
    reach = _reach(length)
    back = length - reach

    def run(messages: pd.DataFrame) -> pd.DataFrame:
        runs, left, left_n, content, place = [], [], [], [], []
        un = zlib.decompress
        for m in messages.itertuples():
            lcps = np.frombuffer(un(m.lcps), np.int32).tolist()
            runs.append((front_decode(lcps, np.frombuffer(un(m.sizes), np.int32).tolist(), un(m.rest)), lcps))
            left.append(un(m.left))
            left_n.append(np.frombuffer(m.left_n, np.uint8 if back < 256 else np.int32).astype(np.int64))
            content.append(np.frombuffer(m.content, np.int64))
            place.append(np.frombuffer(m.place, np.int32).astype(np.int64))
        base = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        order, lcp = np.empty(base[-1], np.int64), np.empty(base[-1], np.int64)
        for k, (r, i, l) in enumerate(merge_runs(runs)):
            order[k] = base[r] + i
            lcp[k] = runs[r][0][i].count(b" ", 0, l)  # whole words in common with the one before
        left_n, content, place = (np.concatenate(x)[order] for x in (left_n, content, place))
        # a message at a time: the hashes take several times their text's memory
        h = np.concatenate([_word_hashes(x) for x in left])
        counts = np.concatenate([np.frombuffer(m.left_n, np.uint8 if back < 256 else np.int32).astype(np.int64) for m in messages.itertuples()])
        stop = np.cumsum(counts)[order]
        hasher = spans_hasher(h)
        found_content, found_start = [], []
        for r in range(length, reach - 1, -1):
            need = length - r
            group = np.cumsum(lcp < r)
            same = np.empty(len(group), bool)
            same[1:] = group[1:] == group[:-1]
            same[:1] = False
            near = same.copy()
            near[:-1] |= same[1:]
            use = np.flatnonzero(near & (left_n >= need))
            if not len(use):
                continue
            key = group[use].astype(np.uint64)
            if need:
                key = mix64(key) ^ hasher(stop[use] - need, stop[use])
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            twice = use[times[inverse] > 1]
            found_content.append(content[twice])
            found_start.append(place[twice] - need)
        if not found_content:
            return pd.DataFrame({"content": np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "stop": np.zeros(0, np.int32)})
        c, s = np.concatenate(found_content), np.concatenate(found_start)
        by = np.lexsort((s, c))
        c, s = c[by], s[by]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] > s[:-1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(c)) - 1
        return pd.DataFrame({"content": c[first], "start": s[first].astype(np.int32), "stop": (s[last] + length).astype(np.int32)})

    return run


def join_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans [start, stop) joined where they overlap or touch."""
    order = W.partitionBy(*by).orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select(*by, "start", "stop", F.when(F.col("start") <= reached, 0).otherwise(1).alias("new"))
    numbered = marked.select(*by, "start", "stop", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("island"))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def repeated_passages(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words): the words of each document that lie in a passage of `length` words (white space
    aside) which occurs twice, in two documents or in one, as joined passages.

    Null and shorter texts have none. A repeated row repeats its whole text. Null ids stay null, columns besides these
    two don't matter.
    """
    if length < 2:
        raise ValueError("a passage has at least 2 words")
    owners = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))
    marks = texts.mapInArrow(_anchors(length), "h long, content long, place int")
    by = W.partitionBy("h")
    again = marks.select("*", F.count(F.lit(1)).over(by).alias("k"), (F.min("content").over(by) != F.max("content").over(by)).alias("x"), (F.min("place").over(by) != F.max("place").over(by)).alias("y"))
    again = cut(again.where("x or y or (k > 1 and place < 0)").select("h", "content", "place").distinct())
    places = again.where("place >= 0").groupBy("content").agg(F.sort_array(F.collect_list(F.struct("place", "h"))).alias("p")).select("content", F.col("p.place").alias("places"), F.col("p.h").alias("hashes"))
    held = texts.join(places, "content").dropDuplicates(["content"])
    runs = held.mapInArrow(_runs(length, owners), _RUN_SQL)
    spans = runs.groupBy("owner").applyInPandas(_owner(length), "content long, start int, stop int")
    copies = again.where("place < 0").select("content", F.lit(0).alias("start"), (-F.col("place")).alias("stop"))
    joined = join_spans(spans.unionByName(copies), ["content"])
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("content"), F.col(id).alias("doc_id"))
    return rows.join(joined, "content").select("doc_id", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"))
