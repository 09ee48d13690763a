"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the words in it and their beginnings; the document's
is their noisy-or, 1 - prod(1 - p). Only documents are labelled: the gradient of the bag's likelihood flows to the
sentences through the noisy-or, so the model also tells which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import Piece, gram_hashes, mix64, pieces, spans_hasher

MAX_TRAIN, MIN_DOCS, MIN_Z, TABLE_BITS = 5_000, 5, 4.0, 18
#: Lengths in bytes of the beginnings of words that are features beside the whole word (0): inflected words share them.
KINDS = (0, 4, 5, 6, 7, 8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentence_words(p: Piece, kinds: tuple[int, ...] = KINDS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of each word, a list by kinds with 0 for words too short (ASCII letters lowered, punctuation at its edges off), its sentence, and each sentence's first word.

    A sentence ends with a word that ends in one of . ! ? or before a line break or the document's end.
    """
    p.words()
    n = len(p.starts)
    if not n:
        return [np.zeros(0, np.uint64)] * len(kinds), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[p.data]
    s, e = p.starts.copy(), p.ends.copy()
    # the first byte from each place on, and the last up to it, that isn't such punctuation
    inner, places = ~_EDGE[data], np.arange(len(data))
    s = np.minimum(np.minimum.accumulate(np.where(inner, places, len(data))[::-1])[::-1][s], e)
    e = np.maximum(np.maximum.accumulate(np.where(inner, places, -1))[e - 1] + 1, s)
    breaks = np.concatenate([[0], np.cumsum(p.data == 10)])
    new = np.ones(n, bool)
    new[1:] = _STOP[p.data[p.ends[:-1] - 1]] | (p.row[1:] != p.row[:-1]) | (breaks[p.starts[1:]] > breaks[p.ends[:-1]])
    hasher = spans_hasher(data)
    hashes = []
    for k in kinds:
        if not k:
            hashes.append(hasher(s, e))
            continue
        own = np.zeros(n, np.uint64)
        long_enough = np.flatnonzero(e - s >= k)
        own[long_enough] = mix64(hasher(s[long_enough], s[long_enough] + k) + np.uint64(k))
        hashes.append(own)
    return hashes, np.cumsum(new) - 1, np.flatnonzero(new)


class Model:
    """Weights of words by hash, in an open table of fixed size that is shipped with the tasks."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, cut: float):
        size = 1 << TABLE_BITS
        self.keys, self.weights, self.bias, self.cut = np.zeros(size, np.uint64), np.zeros(size, np.float32), bias, cut
        self.reach = 0
        if 2 * len(hashes) > size:
            raise ValueError("too many words for the table")
        for h, w in zip(hashes.tolist(), weights.tolist()):
            at, moved = h & (size - 1), 0
            while self.keys[at]:
                at, moved = (at + 1) & (size - 1), moved + 1
            self.keys[at], self.weights[at], self.reach = h, w, max(self.reach, moved)

    def score(self, words: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(words[0]))
        for own in words:
            at, rest = (own & np.uint64(len(self.keys) - 1)).astype(np.int64), np.flatnonzero(own)
            for moved in range(self.reach + 1):
                place = (at[rest] + moved) & (len(self.keys) - 1)
                held = self.keys[place]
                hit = held == own[rest]
                total[rest[hit]] += self.weights[place[hit]]
                rest = rest[~hit & (held > 0)]
        return total


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, steps: int = 300) -> Model:
    """Fits the model to whole documents with 0/1 labels, each as often as its weight says.

    Words enter if they are in min_docs documents at least and their documents' rate of label 1 exceeds the overall
    rate by min_z standard errors. Of near copies (a common min-hash of word 5-grams) only the first counts, lest a text
    that is often copied makes all its words look telling.
    """
    labels = np.asarray(labels, float)
    weights = np.ones(len(labels)) if weights is None else np.asarray(weights, float)
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0, 0.5)  # nothing to learn from: nothing is toxic
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    kept, sentence, doc = [], [], []
    seen_sketch: set[tuple[int, int]] = set()
    base = at = 0
    for p in pieces(iter([batch])):
        (hashes,), own, first = sentence_words(p, (0,))
        grams = gram_hashes(hashes, 5)
        fresh = np.zeros(p.rows.num_rows, bool)
        for k in range(p.rows.num_rows):
            inside = grams[p.first[k] : max(p.first[k] + 1, p.first[k + 1] - 4)]
            sketch = {(j, int((inside * np.uint64(2 * j + 3)).min())) for j in range(4)} if len(inside) else {(9, p.text(k))}
            if not sketch & seen_sketch:
                seen_sketch |= sketch
                fresh[k] = True
        kept.append(fresh)
        sentence.append((own[fresh[p.row]] + base).astype(np.int32))
        doc.append((p.row[first] + at).astype(np.int32))
        at += p.rows.num_rows
        base += len(first)
    sentence, doc, kept = np.concatenate(sentence), np.concatenate(doc), np.concatenate(kept)
    rate = labels[kept].mean()
    row, column, vocabulary = [], [], []
    size = 0
    for kind in KINDS:  # a kind at a time, so that the driver holds one array of hashes
        own, n = [], 0
        for p in pieces(iter([batch])):
            (h,), _, _ = sentence_words(p, (kind,))
            own.append(h[kept[n : n + p.rows.num_rows][p.row]])
            n += p.rows.num_rows
        own = np.concatenate(own)
        # once a document: then a word's documents are counted by its runs
        order = np.lexsort((doc[sentence], own))
        h, d = own[order], doc[sentence[order]]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        values, begin, seen = np.unique(h[once], return_index=True, return_counts=True)
        toxic = np.add.reduceat(labels[d[once]], begin) if len(values) else np.zeros(0)
        del order, h, d, once
        z = (toxic - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
        used = values[(seen >= min_docs) & (z >= min_z) & (values > 0)]
        if len(used):
            place = np.searchsorted(used, own)
            hit = np.flatnonzero(used[np.minimum(place, len(used) - 1)] == own)
            row.append(sentence[hit])
            column.append(place[hit] + size)
        vocabulary.append(used)
        size += len(used)
        del own
    used = np.concatenate(vocabulary)
    row, column = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, column))
    n_doc = len(labels)
    live = weights[doc] * kept[doc] / (weights * kept).sum()
    w, b = np.zeros(len(used)), -4.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)

    def bags(x):
        return 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(_sigmoid(x), 1 - 1e-9)), minlength=n_doc))

    for k in range(1, steps + 1):
        x = b + np.bincount(row, weights=w[column], minlength=base)
        p, bag = _sigmoid(x), np.clip(bags(x), 1e-9, 1 - 1e-9)
        # d(-log likelihood)/dx of a sentence: p for a clean bag; -p * (1 - bag) / bag for a toxic one
        g = np.where(labels[doc] > 0, -p * (1 - bag[doc]) / bag[doc], p) * live
        grad = np.append(np.bincount(column, weights=g[row], minlength=len(used)) + 2e-5 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    bag = bags(b + np.bincount(row, weights=w[column], minlength=base))
    heavy = weights * kept
    grid = np.linspace(0.2, 0.8, 25)
    f = [2 * (heavy * (bag >= c) * labels).sum() / max(1e-9, (heavy * (bag >= c)).sum() + (heavy * labels).sum()) for c in grid]
    best = np.flatnonzero(np.array(f) >= max(f) - 1e-12)
    return Model(used, w, float(b), float(grid[best[len(best) // 2]]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Trains on max_train labelled documents at most, half of them toxic if there are so many: of each label those of
    least id hash, a fixed sample, bounded whatever the input's size. Weights give the labels their true shares again.

    Rows of null id, text or label are left out; of an id's labels the largest counts and of its texts the least; without rows or with one
    label only, nothing is toxic. Extra columns don't matter; long texts are taken whole.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_label"))
    known = known.join(docs.where(F.col(text).isNotNull()).select(F.col(id).alias("_id")).distinct(), "_id", "left_semi")
    shares = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    pick = lambda y: known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_train // 2)
    chosen = pick(0).unionByName(pick(1))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    # one text an id, so that repeated ids don't add to what the driver gets
    table = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_id", "_label", "_text").orderBy("_id").toArrow()
    y = table["_label"].to_numpy()
    weights = np.array([shares.get(int(k), 0) / max(1, (y == k).sum()) for k in y])
    return train(table["_text"].to_pylist(), y, weights)


def _score(model: Model, sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            word, sentence, first = sentence_words(p)
            n_rows = p.rows.num_rows
            x = np.full(len(first), model.bias) + np.bincount(sentence, weights=model.score(word), minlength=len(first))
            prob = _sigmoid(x)
            doc = p.row[first] if len(first) else np.zeros(0, np.int64)
            bag = 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(prob, 1 - 1e-9)), minlength=n_rows))
            if not sentences:
                yield pa.RecordBatch.from_arrays([p.rows.column(0), pa.array(bag), pa.array(bag >= model.cut)], ["row", "score", "toxic"])
                continue
            top = np.zeros(n_rows)
            np.maximum.at(top, doc, prob)
            show = np.flatnonzero((bag[doc] >= model.cut) & ((prob >= 0.5) | (prob == top[doc])))
            last = np.append(first[1:], len(sentence))[show] - 1
            number = show - np.searchsorted(doc, doc[show])
            said = [p.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(p.starts[first[show]], p.ends[last])]
            yield pa.RecordBatch.from_arrays(
                [p.rows.column(0).take(pa.array(doc[show])), pa.array(bag[doc[show]]), pa.array(number, pa.int32()), pa.array(prob[show]), pa.array(said, pa.string())], ["doc_id", "doc_score", "sentence_no", "score", "sentence"]
            )

    return run


def offending_sentences(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_score, sentence_no, score, sentence): for each document the model finds toxic, its sentences of score
    0.5 at least, and in any case its highest (all, if several tie). Null, empty and clean documents give no row; a
    repeated row is scored each time; null ids stay null; ids are cast to long, and one that can't be is an error of the cast. Long texts are scored
    whole, extra columns don't matter, no rows give no rows."""
    return docs.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score(model, True), "doc_id long, doc_score double, sentence_no int, score double, sentence string")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those that the model finds toxic; rows of null or empty text stay, and so do all columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    kind = whole.schema["row"].dataType
    scored = whole.mapInArrow(_score(model, False), f"row {kind.simpleString()}, score double, toxic boolean")
    return scored.where(~F.col("toxic")).select("row.*")
