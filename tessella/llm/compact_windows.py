"""Near-duplicate passages by compact windows.

Tokens are word SHINGLE-grams. For each of K hash functions the Cartesian tree over the tokens' hashes gives, for each
position c, the widest span [l, r] in which c has the least hash: all passages [i, j] with l <= i <= c <= j <= r have
the same min-hash, so the window (l, c, r) stands for all of them. Only windows as wide as a passage are kept, about
2 / (least tokens + 1) of the positions.

1. Windows of equal min-hash are grouped. In a group of up to HOT texts all pairs are joined; for each pair of texts, ENOUGH
   such windows at least must overlap by a passage, one the next, and what they span in both is a candidate.
2. A group of more texts sends the tokens around the min-hash, once for each text. They are clustered in order of the texts' least
   ids: a row is compared with all that are in no class yet, those that share passages with it join its class and are compared with the
   rest in turn. No member is left out, and no two members of one class need be compared.
3. Candidates are cut to runs of tokens that the other side has too, and verified: Jaccard of the tokens >= SIMILAR.

A min-hash that is common in one piece of a map task's input is seen to be so there: its windows are spread by text, and only a
mark goes to the group, so no task gets all windows of a sentence that a third of the rows have.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import components
from .runtime import cut
from .suffix_dedup import join_spans
from .textkit import gram_hashes, mix64, pieces, signed, window_min

LENGTH, SHINGLE, K, ENOUGH, SIMILAR, GAP = 50, 5, 5, 2, 0.6, 16
#: Members up to which a group is joined pair by pair, and tokens on either side of a min-hash that a larger group compares.
HOT, REACH = 24, 64
#: Pairs in one batch, and bytes of excerpts.
PAIRS, EXCERPTS = 1 << 17, 1 << 24
#: A window's bounds as distances from its min-hash are at most this: a passage that reaches further is found in parts.
FAR = (1 << 16) - 1
#: Spans that aren't windows: this one marks a group as large; from WHOLE on they give a whole text's words.
MARK, WHOLE = -1, -(1 << 62)


def _span(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For positions at: the first and last position of the widest span in which h[at] is least (leftmost of equals).

    h begins and ends with 0 and has 0 between documents. By binary lifting over minima of spans of 2**k.
    """
    tables = [h]
    walls = np.flatnonzero(h == 0)
    widest = int(np.diff(walls).max()) if len(walls) > 1 else 1
    while 1 << len(tables) <= widest:
        last, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    own = h[at]
    left, right = at.copy(), at.copy()
    for k in range(len(tables) - 1, -1, -1):
        step, table = 1 << k, tables[k]
        if not len(table):
            continue
        to = left - step
        fits = (to >= 0) & (table[np.clip(to, 0, len(table) - 1)] > own)
        left[fits] = to[fits]
        to = right + 1
        fits = (to < len(table)) & (table[np.clip(to, 0, len(table) - 1)] >= own)
        right[fits] += step
    return left, right


def compact_windows(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the windows of at least `least` tokens; h as for _span."""
    m = window_min(h, least)
    if not len(m):
        return (np.zeros(0, np.int64),) * 3
    around = np.zeros(len(m) + 2 * (least - 1), h.dtype)
    around[least - 1 : least - 1 + len(m)] = m
    at = np.flatnonzero((window_min(around, least, np.maximum, 0) == h) & (h > 0))
    left, right = _span(h, at)
    wide = right - left + 1 >= least
    return left[wide], at[wide], right[wide]


def _tokens(p, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with a 0 before each document and at the end, the row of each, and where each row's tokens begin."""
    p.words()
    grams = gram_hashes(p.word_hashes(), shingle)
    row = p.row[: len(grams)]
    inside = np.flatnonzero(row == p.row[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    count = np.maximum(np.diff(p.first) - shingle + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count + 1)]) + 1
    h = np.zeros(begin[-1], np.uint64)
    h[inside - p.first[row[inside]] + begin[row[inside]]] = grams[inside] | np.uint64(1)
    return h, np.repeat(np.arange(len(count)), count + 1), begin


def _packed(l: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """c, c - l and r - c in one number, not negative."""
    return c << 32 | np.minimum(c - l, FAR) << 16 | np.minimum(r - c, FAR)


def _unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = span >> 32
    return c - (span >> 16 & FAR), c, c + (span & FAR)


def _windows(length: int, shingle: int, k: int, hot: int):
    """(h, content, span): the windows; those that more than `hot` texts of a piece share have a span below MARK, and a mark each."""
    least = length - shingle + 1

    def batch(h: np.ndarray, content: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(content), pa.array(span)], ["h", "content", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            content = p.rows.column(0).to_numpy()
            h, row, begin = _tokens(p, shingle)
            for f in range(k):
                own = mix64(h + np.uint64((2 * f + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) | np.uint64(1)
                own[h == 0] = 0
                l, c, r = compact_windows(own, least)
                rows = row[c - 1] if len(c) else c
                at = begin[rows]
                value, whose, span = own[c], content[rows], _packed(l - at, c - at, r - at)
                # texts of each min-hash within the piece; a text's windows come one after another
                order = np.lexsort((whose, value))
                v, w = value[order], whose[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                first = np.ones(len(v), bool)
                first[1:] = v[1:] != v[:-1]
                group = np.cumsum(first) - 1
                many = np.bincount(group[new], minlength=int(group[-1]) + 1 if len(group) else 0) > hot
                common = np.zeros(len(v), bool)
                common[order] = many[group]
                yield batch(value, whose, np.where(common, -2 - span, span))
                marked = v[first][many]
                if len(marked):
                    yield batch(marked, np.zeros(len(marked), np.int64), np.full(len(marked), MARK))
            count = np.diff(begin) - 1
            whole = np.flatnonzero(count >= least)
            mark = mix64(content[whole].view(np.uint64) + np.uint64(length))
            yield batch(mark, content[whole], WHOLE + count[whole] + shingle - 1)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns, in pieces that end where the first `keys` columns change. Rows come in order of these."""
    rest: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(k).to_numpy() for k in range(b.num_columns)]
        new = np.zeros(b.num_rows, bool)
        for x in now[:keys]:
            new[1:] |= x[1:] != x[:-1]
        if rest:
            new[0] = any(x[0] != y[-1] for x, y in zip(now[:keys], rest[-1]))
        at = np.flatnonzero(new)
        if not len(at):
            rest.append(now)
            continue
        if rest or at[-1]:
            yield [np.concatenate(x) for x in zip(*rest, [x[: at[-1]] for x in now])]
        rest = [[x[at[-1] :] for x in now]]
    if rest:
        yield [np.concatenate(x) for x in zip(*rest)]


def _meet(batches: Iterator[pa.RecordBatch], hot: int, reach: int) -> Iterator[pa.RecordBatch]:
    """What windows in order of h give: (null, a, b, spans) of pairs, (h, a, null, span, first and last min-hash) of the members of large groups, and
    (null, a, null, words) of texts that come more than once.
    """

    def batch(h, a, b, *spans) -> pa.RecordBatch:
        n = len(a)
        arrays = [pa.nulls(n, pa.int64()) if h is None else pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64())]
        arrays += [pa.array(s, pa.int32()) if k < len(spans) else pa.nulls(n, pa.int32()) for k, s in enumerate([*spans, *[None] * (4 - len(spans))])]
        return pa.RecordBatch.from_arrays(arrays, schema=_MET)

    def starts(*keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys[0]), bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    for h, content, span in _groups(batches, 1):
        alike = np.zeros(len(h), bool)
        alike[1:] = h[1:] == h[:-1]
        alike[:-1] |= alike[1:]
        alike |= span < MARK  # a spread window's group is elsewhere
        h, content, span = h[alike], content[alike], span[alike]
        words = span < WHOLE // 2
        if words.any():
            at = starts(h[words])
            several = np.diff(np.append(at, words.sum())) > 1
            at = at[several]
            if len(at):
                yield batch(None, content[words][at], None, (span[words][at] - WHOLE).astype(np.int32))
            h, content, span = h[~words], content[~words], span[~words]
        if not len(h):
            continue
        order = np.lexsort((np.where(span < MARK, -2 - span, span), content, h))
        h, content, span = h[order], content[order], span[order]
        mark, spread = span == MARK, span < MARK
        group = starts(h)
        size = np.diff(np.append(group, len(h)))
        large = np.repeat(np.logical_or.reduceat(mark, group), size) | spread
        h, content, span, large = (x[~mark] for x in (h, content, np.where(spread, -2 - span, span), large))
        if not len(h):
            continue
        member = starts(h, content)
        of = starts(h[member])
        m = np.diff(np.append(of, len(member)))
        large |= np.repeat(np.repeat(m > hot, m), np.diff(np.append(member, len(h))))
        l, c, r = _unpacked(span)
        # members of large groups: what is around their min-hashes, joined where it overlaps
        k = np.flatnonzero(large)
        if len(k):
            lo, hi = np.maximum(l[k], c[k] - reach), np.minimum(r[k], c[k] + reach)
            new = np.zeros(len(k), bool)
            new[starts(h[k], content[k])] = True
            far = np.cumsum(new) << 32
            reached = np.maximum.accumulate(far + hi)
            new[1:] |= (far + lo)[1:] > reached[:-1]
            at = np.flatnonzero(new)
            yield batch(h[k][at], content[k][at], None, *(f.reduceat(v, at).astype(np.int32) for f, v in ((np.minimum, lo), (np.maximum, hi), (np.minimum, c[k]), (np.maximum, c[k]))))
        # all pairs of the others
        k = np.flatnonzero(~large)
        if not len(k):
            continue
        at = starts(h[k], content[k])
        h, content, l, r = h[k][at], content[k][at], np.minimum.reduceat(l[k], at).astype(np.int32), np.maximum.reduceat(r[k], at).astype(np.int32)
        ends = np.append(starts(h)[1:], len(h))
        later = ends[np.searchsorted(ends, np.arange(len(h)), "right")] - np.arange(len(h)) - 1
        total = np.cumsum(later)
        start = 0
        while start < len(h):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
            n = later[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            start = stop
            if len(i):
                yield batch(None, content[i], content[j], l[i], r[i], l[j], r[j])


_MET = pa.schema([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), *((x, pa.int32()) for x in ("l1", "r1", "l2", "r2"))])


def _candidates(enough: int, least: int):
    """Spans (first and last token in a, in b) of `enough` windows at least that overlap by `least` tokens in a, one the next.

    Rows come in order of a, b and l1. For each a: a row of what is asked of itself, and one for each span of a partner.
    """

    def batch(g, content, l, r, x, x2) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (g, content, l, r, x, x2)], ["g", "content", "l", "r", "x", "x2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, l1, r1, l2, r2 in _groups(batches, 1):
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            far = np.cumsum(first) << 32
            reached = np.maximum.accumulate(far + r1)
            first[1:] |= far[1:] + l1[1:] + least - 1 > reached[:-1]
            at = np.flatnonzero(first)
            x, x2, y, y2 = np.minimum.reduceat(l1, at), np.maximum.reduceat(r1, at), np.minimum.reduceat(l2, at), np.maximum.reduceat(r2, at)
            fits = np.diff(np.append(at, len(a))) >= enough
            a, b, x, x2, y, y2 = (v[fits] for v in (a[at], b[at], x, x2, y, y2))
            if not len(a):
                continue
            yield batch(a, b, y, y2, x, x2)
            at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            lo, hi = np.minimum.reduceat(x, at), np.maximum.reduceat(x2, at)
            yield batch(a[at], a[at], lo, hi, lo, hi)

    return run


def _excerpts(shingle: int, name: pa.DataType):
    schema = pa.schema([("pair", pa.bool_()), ("g", pa.int64()), ("name", name), ("content", pa.int64()), *((c, pa.int32()) for c in ("l", "x", "x2")), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            h, _, begin = _tokens(p, shingle)
            h = mix64(h).astype(np.uint32)
            column = lambda c: p.rows.column(p.rows.schema.get_field_index(c))
            asked, content, names = column("asked"), column("content").to_numpy(), column("name")
            offsets, items = asked.offsets.to_numpy(), asked.flatten()
            row = np.repeat(np.arange(len(asked)), np.diff(offsets))
            l, r = (items.field(c).to_numpy() for c in ("l", "r"))
            start = 0
            size = np.cumsum(4 * (r - l + 1) + 64)
            while start < len(row):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + EXCERPTS, "right")))
                part = slice(start, stop)
                start = stop
                at = begin[row[part]]
                tokens = [h[x:y].tobytes() for x, y in zip((at + l[part]).tolist(), (at + r[part] + 1).tolist())]
                yield pa.RecordBatch.from_arrays([items.field("pair")[part], items.field("g")[part], names.take(pa.array(row[part])), pa.array(content[row[part]]), *(items.field(c)[part] for c in ("l", "x", "x2")), pa.array(tokens, pa.binary())], schema=schema)

    return run


def _need(least: int, similar: float) -> int:
    """Tokens that two passages of `least` different ones must share."""
    return int(np.ceil(2 * least * similar / (1 + similar) - 1e-9))


def _runs(hit: np.ndarray, gap: int, least: int, need: int) -> list[tuple[int, int]]:
    """First and last of the runs of true in which no more than gap follow one another that are false: those of
    `least` places and `need` true ones at least.
    """
    at = np.flatnonzero(hit)
    if len(at) < need:
        return []
    cuts = np.flatnonzero(at[1:] - at[:-1] > gap + 1)
    if not len(cuts):
        return [(int(at[0]), int(at[-1]))] if at[-1] - at[0] + 1 >= least else []
    first, last = np.append(0, cuts + 1), np.append(cuts, len(at) - 1)
    fits = (at[last] - at[first] + 1 >= least) & (last - first + 1 >= need)
    return list(zip(at[first[fits]].tolist(), at[last[fits]].tolist()))


def _dense(at: np.ndarray, of: np.ndarray, least: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index into at of the pieces made of windows of `least` places that have `need` of at's; of parts at."""
    k = np.flatnonzero((at[need - 1 :] - at[: len(at) - need + 1] < least) & (of[need - 1 :] == of[: len(of) - need + 1])) if len(at) >= need else np.zeros(0, np.int64)
    if not len(k):
        return k, k
    cuts = np.flatnonzero((k[1:] > k[:-1] + need - 1) | (of[k[1:]] != of[k[:-1]]))
    return k[np.append(0, cuts + 1)], k[np.append(cuts, len(k) - 1)] + need - 1


def _widened(a, b, least: int, n):
    """The span as wide as a passage, if it was less, within n tokens."""
    a = np.maximum(np.minimum(a, b - least + 1), 0)
    return a, np.minimum(np.maximum(b, a + least - 1), n - 1)


def verify(x: np.ndarray, y: np.ndarray, least: int, similar: float, gap: int = GAP) -> list[tuple[int, int, int, int, float]]:
    """(first, last in x, first, last in y, Jaccard) of the passages of at least `least` tokens that x and y share nearly.

    Runs of tokens of x that y has, cut where more than gap others follow one another; against each, y's likewise, all of
    them. Each pair of runs is cut further by what the other has, until nothing more is cut off on either side. Of one that
    has too little Jaccard then, the pieces remain that are made of windows of `least` tokens with as many shared ones as two
    passages of that Jaccard have; their Jaccard is given as `similar`. Shared tokens are counted by place, and a run has that many too.
    """
    need = _need(least, similar)
    values, token = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = token[: len(x)], token[len(x) :]
    mine, theirs = np.zeros(len(values), bool), np.zeros(len(values), bool)

    def jaccard(a: int, b: int, c: int, d: int) -> float:
        mine[x[a : b + 1]] = theirs[y[c : d + 1]] = True
        likeness = np.count_nonzero(mine & theirs) / np.count_nonzero(mine | theirs)
        mine[x[a : b + 1]] = theirs[y[c : d + 1]] = False
        return likeness

    def within(a: int, b: int, c: int, d: int, gap: int) -> list[tuple[int, int, int, int]]:
        """Runs of x[a..b] that y[c..d] has, each with the runs of y[c..d] that it has."""
        found = []
        other = y[c : d + 1]
        theirs[other] = True
        hit = theirs[x[a : b + 1]]
        theirs[other] = False
        for p, q in _runs(hit, gap, least, need):
            own = x[a + p : a + q + 1]
            mine[own] = True
            hit = mine[other]
            mine[own] = False
            found += [(a + p, a + q, c + s, c + t) for s, t in _runs(hit, gap, least, need)]
        return found

    def cut_down(whole: tuple[int, int, int, int]) -> list[tuple[int, int, int, int, float]]:
        parts = within(*whole, gap)
        out = [v for part in parts if part != whole for v in cut_down(part)]
        if out:
            return out
        if (j := jaccard(*whole)) >= similar:
            return [(*whole, j)]
        return dense(*whole)

    def pieces_of(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
        theirs[other] = True
        at = np.flatnonzero(theirs[own])
        theirs[other] = False
        first, last = _dense(at, np.zeros(len(at), np.int64), least, need)
        return list(zip(at[first].tolist(), at[last].tolist()))

    def dense(a: int, b: int, c: int, d: int) -> list[tuple[int, int, int, int, float]]:
        found = []
        for p, q in pieces_of(x[a : b + 1], y[c : d + 1]):
            for s, t in pieces_of(y[c : d + 1], x[a + p : a + q + 1]):
                found.append((*_widened(a + p, a + q, least, len(x)), *_widened(c + s, c + t, least, len(y)), similar))
        return found

    return sorted({v for part in within(0, len(x) - 1, 0, len(y) - 1, gap) for v in cut_down(part)})


def _classes(content: np.ndarray, core: np.ndarray, tokens: list[np.ndarray], least: int, similar: float, gap: int = GAP) -> list[tuple]:
    """(i, j, first, last in i, first, last in j, Jaccard) of rows of a group such that rows that share passages are connected.

    core has the places of a row's first and last min-hash, and passages that hold one of these count here: the others have groups of their
    own. The first row begins a class. Each row of a class, the first ones first, is compared with all that are in no class yet,
    and those that share a passage with it join. When none is left that joins, the next row begins a class. Rows that share too few tokens with other
    texts for any passage are dropped first; tokens are counted by place, as in verify.
    """
    need = _need(least, similar)
    size = np.array([len(t) for t in tokens])
    begin = np.concatenate([[0], np.cumsum(size)])
    values, every = np.unique(np.concatenate(tokens), return_inverse=True)
    row = np.repeat(np.arange(len(tokens)), size)
    place, token = np.arange(len(row)) - begin[row], every
    free = np.ones(len(tokens), bool)
    done = False
    while not done:
        # a token counts if rows of two texts have it
        by = np.lexsort((content[row], token))
        t, c = token[by], content[row[by]]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        shared = np.bincount(t[new], minlength=len(values))[token] > 1
        count = np.bincount(row[shared], minlength=len(free))
        done = not (free & (count < need)).any()
        free &= count >= need
        row, place, token = (x[shared & free[row]] for x in (row, place, token))
    where, found, held = np.full(len(values), -1), [], int(free.sum())

    def by_token() -> tuple[np.ndarray, np.ndarray]:
        return np.argsort(token, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(values)))])

    entry, index = by_token()
    for first in range(len(tokens)):
        if not free[first]:
            continue
        free[first] = False
        held -= 1
        queue = [first]
        while queue:
            i = heapq.heappop(queue)
            own = every[begin[i] : begin[i + 1]]
            where[own] = np.arange(len(own))
            # the places of its tokens in others: by the index of tokens, or of all places if they are many
            n = index[own + 1] - index[own]
            if n.sum() * 8 < len(row):
                at = np.sort(entry[np.repeat(index[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                at = at[free[row[at]]]
            else:
                at = np.flatnonzero((where[token] >= 0) & free[row])
            r, x, y = row[at], where[token[at]], place[at]
            where[own] = -1
            joined = []
            # runs of tokens that row i has too; those of too little Jaccard give their dense pieces, as in verify
            run = np.cumsum(np.append(True, (r[1:] != r[:-1]) | (y[1:] - y[:-1] > gap + 1))) if len(r) else r
            for close in (True, False):
                if not len(r):
                    break
                if close:
                    s = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
                    end = np.append(s[1:], len(r)) - 1
                else:
                    s, end = _dense(y, run, least, need)
                    if not len(s):
                        break
                j, y1, y2 = r[s], y[s], y[end]
                # reduceat's slices begin at s and end at the next end
                ends = np.ravel(np.column_stack([s, end + 1]))[: None if end[-1] + 1 < len(r) else -1]
                x1, x2 = np.minimum.reduceat(x, ends)[::2], np.maximum.reduceat(x, ends)[::2]
                n = end - s + 1
                fits = (n >= need) & (content[j] != content[i]) & ((y1 <= core[j, 0]) & (core[j, 0] <= y2) | (y1 <= core[j, 1]) & (core[j, 1] <= y2))
                if close:
                    fits &= (y2 - y1 + 1 >= least)
                    likeness = np.minimum(n / np.maximum((y2 - y1 + 1) + (x2 - x1 + 1) - n, 1), 1.0)
                    good = fits & (x2 - x1 + 1 >= least) & (likeness >= similar)
                else:
                    likeness = np.full(len(s), similar)
                    good = fits & (x2 - x1 < 2 * least + (y2 - y1))
                    y1, y2 = _widened(y1, y2, least, size[j])
                    x1, x2 = _widened(x1, x2, least, len(own))
                if good.any():
                    for j_, a, b, c_, d, v in zip(*(v[good].tolist() for v in (j, x1, x2, y1, y2, likeness))):
                        found.append((i, j_, a, b, c_, d, v) if i < j_ else (j_, i, c_, d, a, b, v))
                    joined += j[good].tolist()
                if close:
                    again = np.repeat(fits & ~good, n)
                    r, x, y, run = r[again], x[again], y[again], run[again]
            if len(joined):
                free[joined] = False
                for j in set(joined):
                    heapq.heappush(queue, j)
                left = int(free.sum())
                if left * 2 < held or not left:
                    held = left
                    row, place, token = (v[free[row]] for v in (row, place, token))
                    entry, index = by_token()
            if not held:
                return found
    return found


def _links(shingle: int, least: int, similar: float):
    """Verified links from rows in order of pair, g and name."""

    def compare(pair: bool, g: int, rows: list[tuple]) -> list[tuple]:
        tokens = [np.frombuffer(r[4], np.uint32) for r in rows]
        if pair:
            # the text that all others are compared with, where the two meet
            own = next((k for k, r in enumerate(rows) if r[0] == g), None)
            found = []
            for k, (content, _, x, x2, _) in enumerate(rows):
                if content != g and own is not None:
                    at = rows[own][1]
                    for a, b, c, d, likeness in verify(tokens[own][x - at : x2 - at + 1], tokens[k], least, similar):
                        one, two = (own, a + x - at, b + x - at), (k, c, d)
                        (i, a, b), (j, c, d) = (one, two) if own < k else (two, one)
                        found.append((i, j, a, b, c, d, likeness))
        else:
            found = _classes(np.array([r[0] for r in rows]), np.array([(r[2] - r[1], r[3] - r[1]) for r in rows]), tokens, least, similar)
        return [(rows[i][0], rows[j][0], rows[i][1] + a, rows[i][1] + b + shingle, rows[j][1] + c, rows[j][1] + d + shingle, likeness) for i, j, a, b, c, d, likeness in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def finish() -> None:
            once = list(dict.fromkeys(rows))  # a repeated row of documents gives a row again
            if len(once) > 1:
                out.extend(compare(*key, once))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pair", "g", "content", "l", "x", "x2", "tokens")]
            for pair, g, *r in zip(*columns):
                if key != (pair, g):
                    finish()
                    key, rows = (pair, g), []
                rows.append(tuple(r))
            if len(out) > PAIRS:
                yield _linked(out)
                out = []
        finish()
        if out:
            yield _linked(out)

    return run


def _linked(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["a", "b", "a_start", "a_stop", "b_start", "b_stop", "jaccard"])


def near_passages(docs: DataFrame, id: str, text: str, length: int = LENGTH, shingle: int = SHINGLE, k: int = K, enough: int = ENOUGH, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verified links (a, b, their spans in words, jaccard) of different texts, a that of the lesser name; (content, words) of
    texts that come more than once; and (content, name, n_copies), the least id of each text.
    """
    least = length - shingle + 1
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("content"), F.col(id).alias("name"), F.col(text).alias("text"))
    names = rows.groupBy("content").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n_copies"))
    windows = rows.select("content", "text").mapInArrow(_windows(length, shingle, k, HOT), "h long, content long, span long")
    spread = (F.col("span") < MARK) & (F.col("span") > WHOLE // 2)
    laid = windows.repartition(F.when(spread, F.xxhash64("content", "h")).otherwise(F.col("h"))).sortWithinPartitions("h")
    met = cut(laid.mapInArrow(lambda batches: _meet(batches, HOT, REACH), "h long, a long, b long, l1 int, r1 int, l2 int, r2 int"))
    copies = met.where("h is null and b is null").select(F.col("a").alias("content"), F.col("l1").alias("words")).distinct()
    pairs = met.where("b is not null").drop("h").repartition("a").sortWithinPartitions("a", "b", "l1")
    near = pairs.mapInArrow(_candidates(enough, least), "g long, content long, l int, r int, x int, x2 int").select(F.lit(True).alias("pair"), "*")
    large = met.where("h is not null").select(F.lit(False).alias("pair"), F.col("h").alias("g"), F.col("a").alias("content"), F.col("l1").alias("l"), F.col("r1").alias("r"), F.col("l2").alias("x"), F.col("r2").alias("x2"))
    asked = near.unionByName(large).groupBy("content").agg(F.collect_list(F.struct("pair", "g", "l", "r", "x", "x2")).alias("asked"))
    asked = asked.join(names.select("content", "name"), "content").withColumnRenamed("name", "_name")
    cited = rows.join(asked, "content").where(F.col("name").eqNullSafe(F.col("_name"))).drop("_name")
    kind = cited.schema["name"].dataType
    excerpts = cited.mapInArrow(_excerpts(shingle, to_arrow_type(kind)), f"pair boolean, g long, name {kind.simpleString()}, content long, l int, x int, x2 int, tokens binary")
    laid = excerpts.repartition("pair", "g").sortWithinPartitions("pair", "g", F.col("name").asc_nulls_last(), "content", "l")
    links = laid.drop("name").mapInArrow(_links(shingle, least, similar), "a long, b long, a_start int, a_stop int, b_start int, b_stop int, jaccard double")
    return cut(links), copies, names


def near_duplicate_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, start_word, n_words, class_id, n_links, n_copies): the passages of `length` words at least that another text
    has nearly, or that are the whole of a text which comes again.

    A document's passages that overlap or touch are one. n_links counts a passage's verified links to other texts' passages: all in
    groups of up to HOT texts, in larger ones those by which it joined its class and others joined by it. class_id is the least id that links lead to, so that
    linked passages have the same class; n_copies counts the rows of this very text, each of which has rows here. Null and shorter
    texts have no passages; null ids come last in order and stay null, a repeated row is a copy; extra columns don't matter; very long
    texts are taken whole; no rows give no rows. `how`: length, shingle, k, enough, similar, as the constants above.
    """
    links, copies, names = near_passages(docs, id, text, **how)
    numbered = links.select("*", F.xxhash64("a", "b", "a_start", "b_start", "a_stop", "b_stop").alias("link")).dropDuplicates(["link"])
    ends = numbered.select(F.explode(F.array(*[F.struct(F.col(s).alias("content"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_stop").alias("stop"), "link") for s in "ab"])).alias("e")).select("e.*")
    ends = ends.unionByName(copies.select("content", F.lit(0).alias("start"), F.col("words").alias("stop"), F.lit(None).cast("long").alias("link")))
    order = W.partitionBy("content").orderBy("start", "stop", "link")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("*", F.when(F.coalesce(F.col("start") > before, F.lit(True)), F.col("start")).alias("new"))
    ends = ends.select("*", F.last("new", True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("at")).withColumn("node", F.xxhash64("content", "at"))
    ends = cut(ends.select("content", "start", "stop", "link", "node"))
    nodes = ends.groupBy("node").agg(F.first("content").alias("content"), F.min("start").alias("start_word"), (F.max("stop") - F.min("start")).alias("n_words"), F.count("link").cast("int").alias("n_links"))
    edges = ends.where("link is not null").groupBy("link").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b").distinct()
    found = components(edges)
    nodes = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select("*", F.coalesce("component", "node").alias("class")).join(names, "content")
    first = nodes.groupBy("class").agg(F.min("name").alias("class_id"))
    nodes = nodes.join(first, "class").select("content", "start_word", "n_words", "class_id", "n_links", F.col("n_copies").cast("int").alias("n_copies"))
    ids = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("content"), F.col(id).alias("doc_id"))
    return ids.join(nodes, "content").select("doc_id", "start_word", "n_words", "class_id", "n_links", "n_copies")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches):
        p.words()
        texts = []
        for k, spans in enumerate(p.rows.column(2).to_pylist()):
            raw, at = p.text(k), p.offsets[k]
            starts, n = p.starts[p.first[k] : p.first[k + 1]] - at, p.first[k + 1] - p.first[k]
            out, last = [], 0
            for s in sorted(spans, key=lambda x: x["start"]):
                out.append(raw[last : starts[s["start"]]])
                last = int(starts[s["stop"]]) if s["stop"] < n else len(raw)
            texts.append(b"".join([*out, raw[last:]]).decode())
        yield pa.RecordBatch.from_arrays([p.rows.column(0), pa.array(texts, pa.string())], ["row", "text"])


def cut_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", size: str = "n_chars", **how) -> DataFrame:
    """docs with each near-duplicate passage left only in the document of least id that was found to have it.

    Every row stays; texts without such passages are unchanged, others lose the passages' words with the white space after
    them, and `size`, if there is such a column, is set to their new length. Of equal texts of a passage's length at least, all but that of the least
    id lose the whole; a repeated row keeps its text. Null texts and shorter ones stay as they are, null ids come last, no rows give none;
    extra columns are kept, whatever their names; very long texts are cut like others.
    """
    links, copies, names = near_passages(docs, id, text, **how)
    spans = join_spans(links.select(F.col("b").alias("content"), F.col("b_start").alias("start"), F.col("b_stop").alias("stop")).distinct(), ["content"])
    spans = spans.groupBy("content").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(copies, "content", "full").join(names, "content")
    spans = cut(spans.select(F.col("content").alias("_content"), F.col("name").alias("_name"), "spans", "words"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    here = (F.xxhash64(F.col(f"row.`{text}`")) == F.col("_content")) & F.col(f"row.`{text}`").isNotNull() & (F.col("spans").isNotNull() | ~F.col(f"row.`{id}`").eqNullSafe(F.col("_name")))
    every = F.when(F.col(f"row.`{id}`").eqNullSafe(F.col("_name")), F.col("spans")).otherwise(F.coalesce(F.when(F.col("words").isNotNull(), F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("stop")))), F.col("spans")))
    hit = whole.join(spans, here).select("row", F.col(f"row.`{text}`").alias("text"), every.alias("spans"))
    less = hit.mapInArrow(_cut_out, f"row {whole.schema['row'].dataType.simpleString()}, text string")
    columns = [F.col("text").alias(c) if c == text else (F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == size else F.col(f"row.`{c}`").alias(c)) for c in docs.columns]
    return whole.join(spans, here, "left_anti").select("row.*").unionByName(less.select(*columns))
